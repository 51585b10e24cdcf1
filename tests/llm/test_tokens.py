"""Token store, byte-level BPE, packing: against the libraries and by round trip."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import bpe, packing, queries, token_store
from cohortlens.llm.common import new_path
from cohortlens.llm.encoder import TextEncoder, text_encoder
from cohortlens.llm.units import PATTERN, matches, matches_of
from helpers import SF, no_docs, odd_docs, odd_texts, rows_of, tuples

FILE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = st.text(alphabet=st.sampled_from(list("ab'sl d1,.\n\t\r\x00\x1c\x85  é東\U0001f600|<")), max_size=40)


def test_pattern_is_the_public_one():
    assert PATTERN == P.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(FILE) if not hasattr(test_encoder_equals_the_library, "t") else test_encoder_equals_the_library.t
    test_encoder_equals_the_library.t = t
    t.encode_special_tokens = True
    values, counts = text_encoder(FILE).run(pa.array(texts))
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in expected]
    assert values.tolist() == [i for x in expected for i in x]


def test_encoder_with_a_full_memo(library):
    from cohortlens.llm.encoder import TextEncoder
    texts = [t or "" for _, t in rows_of()][:60]
    small = TextEncoder(FILE, max_kept=50)
    for _ in range(2):
        assert small.run(pa.array(texts))[0].tolist() == [i for x in library(texts) for i in x]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_matches_of_a_unit(text):
    assert matches_of(text) == matches(text)


def test_merge_equals_the_library(ranked):
    ranks = bpe.read_ranks(RANKS)
    for word in (" thethere", "a" * 5000, "東京", " été", "xyzzyq" * 50):
        assert bpe.merge(word.encode(), ranks) == ranked._encode_single_piece(word)


def stored_rows(docs, library):
    rows, start = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library([t or ""])[0] + [0]
        rows.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return sorted(rows, key=repr)


def test_store_of_all_documents(spark, library):
    assert tuples(queries.op6_token_store(spark, SF)) == stored_rows(rows_of(), library)


def test_store_of_odd_documents_and_random_access(spark, library):
    folder = new_path(spark, "store")
    token_store.write_tokens(odd_docs(spark), folder, FILE, shards=3)
    got = tuples(token_store.digest(token_store.read_tokens(spark, folder)))
    assert got == stored_rows(odd_texts(), library)
    some = token_store.read_documents(spark, folder, [5, 9, 77])
    assert [r[0] for r in tuples(some, "doc_id")] == [5, 9]
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    name, data = token_store.stored_dictionary(spark, folder)
    assert {b.dictionary for b in blocks} == {name} == {hashlib.sha256(data).hexdigest()}
    assert all(len(b.offsets) == len(b.doc_ids) + 1 and b.offsets[-1] == len(b.payload) for b in blocks)


def test_store_of_an_empty_table(spark):
    folder = new_path(spark, "store")
    token_store.write_tokens(no_docs(spark), folder, FILE, shards=2)
    assert token_store.read_tokens(spark, folder).count() == 0


def test_another_dictionary_is_refused(spark):
    from pyspark.errors import PythonException
    folder, other = new_path(spark, "store"), new_path(spark, "store")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_store.write_tokens(docs, folder, FILE, shards=2)
    token_store.write_tokens(docs.where("doc_id < 60"), other, FILE, shards=2)
    with pytest.raises(PythonException, match="another dictionary"):
        token_store.read_tokens(spark, other, spark.read.parquet(f"{folder}/blocks")).count()


def bpe_rows(docs, ranked):
    rows = []
    for i, t in docs:
        ids = ranked.encode_ordinary(t or "")
        rows.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(rows, key=repr)


def test_bpe_of_all_documents(spark, ranked):
    assert tuples(queries.op8_byte_bpe(spark, SF)) == bpe_rows(rows_of(), ranked)


def test_bpe_in_small_blocks(spark, ranked):
    for docs, expected in ((odd_docs(spark), odd_texts()), (spark.read.parquet(f"{SF}/documents.parquet"), rows_of())):
        got = bpe.decode(bpe.encode(docs, RANKS, buckets=8, block_bytes=3000), RANKS)
        assert tuples(bpe.digest(got)) == bpe_rows(expected, ranked)


def test_bpe_of_equal_blocks(spark, ranked, tmp_path):
    """Rows twice in one table, and a table of two equal files: blocks of the same name."""
    texts = [(i, t) for i, t in rows_of()][:60]
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").coalesce(1)
    for _ in range(2):
        docs.write.mode("append").parquet(f"file://{tmp_path}/docs")
    stored = spark.read.parquet(f"file://{tmp_path}/docs")
    expected = bpe_rows(texts + texts, ranked)
    for table in (stored, docs.union(docs)):
        assert tuples(bpe.digest(bpe.decode(bpe.encode(table, RANKS, block_bytes=20_000), RANKS))) == expected


def test_bpe_with_a_full_memo(spark, ranked, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    texts = [(i, t) for i, t in rows_of()][:40]
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    assert tuples(bpe.digest(bpe.decode(bpe.encode(docs, RANKS), RANKS))) == bpe_rows(texts, ranked)


def test_bpe_of_nothing(spark):
    assert bpe.encode(no_docs(spark), RANKS, buckets=4).count() == 0
    only_empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id LONG, text STRING")
    assert tuples(bpe.encode(only_empty, RANKS, buckets=4)) == [(1, []), (2, [])]


def check_packed(rows, docs, library, capacity=1024):
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for i, t in docs:
        ids = library([t or ""])[0] + [2]
        n = len(ids)
        end = n % capacity or capacity if n > capacity else n
        begin, piece = 0, 0
        while begin < n:
            expected.append((i, piece, begin, end - begin, crc(ids[begin:end])))
            begin, end, piece = end, end + capacity, piece + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_all_documents(spark, library):
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    n, least = check_packed(rows, rows_of(), library)
    assert n <= 1.02 * least + 1


def test_packing_of_odd_documents(spark, library):
    check_packed(packing.pack_documents(odd_docs(spark), FILE).collect(), odd_texts(), library)
    assert packing.pack_documents(no_docs(spark), FILE).count() == 0


def test_sequences_hold_the_ids(spark, library):
    cut = packing.pieces(odd_docs(spark), FILE)
    whole = packing.sequences(cut, packing.assign(cut)).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(library([t or ""])[0]) + 1 for _, t in odd_texts())
    assert all(r.n_tokens <= 1024 and len(r.ids) == 4 * r.n_tokens for r in whole)


def test_the_fullest_of_too_many_bins_closes():
    bins = packing.BestFit(10, max_open=2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(5) == (2, 0)  # bin 1 (3 free) closes
    assert bins.place(3) == (0, 6)  # bin 0 has 4 free, bin 2 has 5
    assert bins.place(5) == (2, 5)
    assert bins.n_open == 1 and bins.bits == 1 << 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_never_overfills(lengths, max_open):
    bins, used = packing.BestFit(20, max_open), {}
    for n in lengths:
        at, offset = bins.place(n)
        assert used.get(at, 0) == offset
        used[at] = offset + n
        assert used[at] <= 20 and bins.n_open <= max_open


def test_units_that_come_again_are_not_merged_again():
    """Texts of more than 100,000 different units: the second time the memo has them all."""
    encoder = TextEncoder(FILE)
    texts = pa.array([" ".join(f"w{i:x}q" for i in range(k, k + 1000)) for k in range(0, 150_000, 1000)])
    first = [x.tolist() for x in encoder.run(texts)]
    expanded = []
    original = encoder.memo.expand
    encoder.memo.expand = lambda keys: expanded.extend(keys) or original(keys)
    assert [x.tolist() for x in encoder.run(texts)] == first and expanded == []

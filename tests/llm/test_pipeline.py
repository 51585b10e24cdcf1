"""The corpus pipeline: each stage against a brute-force version, and the guard of the entry point."""

import os
import subprocess
import sys

import corpus_pipeline
from cohortlens.llm import langid, pii
from cohortlens.llm.common import stored
from helpers import SF, no_docs, rows_of, tuples, words
from test_simhash import brute as brute_simhash
from test_substring import brute_left

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in langid.identify(source).collect() if r.lang_pred != "und" and r.score >= 0.4}
    docs = [(i, t) for i, t in sorted(rows_of()) if i in known]
    docs = [(i, t) for i, t in docs if i in {c for _, _, c in brute_simhash(docs)}]
    left = []
    for (i, t), kept in zip(docs, brute_left(docs)):
        if len(kept) == len(words(t)):
            left.append((i, t))
        elif kept:
            left.append((i, " ".join(kept)))
    expected = [(i, pii.masked(t)) for i, t in left]
    stage = source
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = stored(f(spark, stage, SF), name)
        assert stage.columns == COLUMNS
    assert tuples(stage, "doc_id", "text") == sorted(expected, key=repr)
    assert all(r.n_chars == len(r.text) for r in stage.collect())
    from test_tokens import FILE, check_packed
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    library = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    n, least = check_packed(corpus_pipeline.run(spark, SF).collect(), expected, library)
    assert n <= 1.02 * least + 1


def test_stages_of_an_empty_table(spark):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, no_docs(spark), SF).count() == 0, name


def test_only_the_result_is_left(spark):
    """Tables of the stages go; what remains in the shared folder is the last stage's result (and Spark's checkpoints)."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    result = corpus_pipeline.run(spark, SF)
    left = {n for n in set(os.listdir(folder)) - before if n.startswith(("run-", *(s for s, _ in corpus_pipeline.STAGES)))}
    assert len(left) == 1 and left.pop().startswith(corpus_pipeline.STAGES[-1][0]) and result.count() > 0


def test_entry_registers_all(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage():
    code = (
        "import sys; sys.modules['cohortlens.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); e.oracle_sql()\n"
        "assert 'funnel_by_channel' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1')]"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0

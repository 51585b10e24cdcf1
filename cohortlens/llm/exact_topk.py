"""Exact top-k by inner product over integer vectors.

Candidates lie in bands of ``BAND`` vectors by descending length, queries in tiles of ``TILE``; every
tile meets every band that can still matter (a stated query set against all rows, in blocks).

1. The band of the longest vectors gives each query a first threshold: its k-th best score there.
2. Bands are numbered by descending length, so those that the tile's longest query can reach at its lowest
   threshold come first: a tile is copied to these only, told by the lengths of at most ``MARKS`` bands.
3. Within a (tile, band) vectors come by descending length, some at a time. A rotation by the right
   singular vectors of a bounded sample moves most of the length into the first coordinates. Partial sums grow by
   an eighth of the coordinates at a time; each plus the product of the two residual lengths bounds the score
   (Cauchy-Schwarz), and pairs whose bound lies below the threshold are dropped after each. What is left in the
   end is scored exactly, and the thresholds rise. Equal scores are kept for the tie rule.
4. One window over what is left of each query.

The rotation only sets how early a pair is dropped, never which: it may come from any sample.

Vectors null, empty or with null or non-finite components, and null ids, take no part. Components are
whole numbers within +-2**62 (clipped); scores beyond a long are clipped to it. Vectors of unequal
width: missing components are zero. Repeated rows (same id and vector) count once; a query is no
candidate of its own id. Fewer candidates than k: all. Empty table: no row. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, stored
from .vectors import MATRIX, best_of, matrix_of, matrix_values, prefixed, same_width, unpack_lists, widen

TILE, BAND, STEP = 1024, 4096, 1024
PARTS = 8  # partial sums
MARKS = 1 << 16  # lengths of bands that a task knows
EXACT = float(1 << 53)


def rotation(vectors: DataFrame, sample: int) -> np.ndarray:
    """Right singular vectors of the ``sample`` vectors with the smallest hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
    m = unpack_lists(rows.column("vec").combine_chunks())
    if not m.size:
        return np.zeros((0, 0))
    scale = np.abs(m).max() or 1.0
    return np.linalg.svd(m / scale, full_matrices=True)[2].T


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block long, longest double, n, dim, ids, matrix) of the rows in their order; repeated
    neighbours once. block: partition number and place in it."""

    def build(batches):
        part, made, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            ids, m = batch.column("vec_id").to_numpy(), unpack_lists(batch.column("vec"))
            if last is not None:
                both, m2 = same_width(last[1], m)
                ids, m = np.concatenate([last[0], ids]), np.concatenate([both, m2])
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (m[1:] != m[:-1]).any(axis=1)])
            ids, m = ids[new], m[new]
            while len(ids) > size:
                yield row(part, made, ids[:size], m[:size])
                ids, m, made = ids[size:], m[size:], made + 1
            last = ids, m
        if last is not None and len(last[0]):
            yield row(part, made, *last)

    def row(part, made, ids, m):
        values = [(part << 32) + made, float(np.sqrt((m * m).sum(axis=1)).max()), *matrix_values(ids, m)]
        types = pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "longest", "n", "dim", "ids", "matrix"])

    return rows.select("vec_id", "vec").mapInArrow(build, f"block long, longest double, {MATRIX}")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, exact: in doubles where no sum can pass 2**53, else in Python's integers."""
    if not a.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a * b).sum(axis=1).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = (whole(a) * whole(b)).sum(axis=1)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in sums], np.int64)


def search(q_ids, q, x_ids, x, turn, limit, k):
    """((query row, score, candidate row) of what can be among the k best, the risen thresholds, number of pairs scored
    exactly), given thresholds ``limit`` (-inf: none yet). x by descending length."""
    dim = max(q.shape[1], x.shape[1], turn.shape[0])
    q, x = widen(q, dim), widen(x, dim)
    if turn.shape[0] < dim:  # coordinates that the sample doesn't have stay as they are
        full = np.eye(dim)
        full[: turn.shape[0], : turn.shape[0]] = turn
        turn = full
    cuts = sorted({dim * c // PARTS for c in range(PARTS + 1)})
    qr, xr = q @ turn, x @ turn
    q_len, x_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    # lengths of what each partial sum leaves out
    q_rest, x_rest = (np.sqrt(np.stack([(m[:, c:] ** 2).sum(axis=1) for c in cuts], axis=1)) for m in (qr, xr))
    kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit, scored = limit.copy(), 0
    for begin in range(0, len(x), STEP):
        end = min(begin + STEP, len(x))
        slack = 1e-9 * q_len * x_len[begin] + 1e-9  # of rounding in the rotation
        i = np.flatnonzero(q_len * x_len[begin] + slack >= limit)  # the longest that is left
        if not len(i):
            break
        j = np.arange(begin, end)
        sums, left = np.zeros((len(i), len(j))), np.ones((len(i), len(j)), bool)
        for c in range(1, len(cuts)):
            sums += qr[i, cuts[c - 1] : cuts[c]] @ xr[j, cuts[c - 1] : cuts[c]].T
            left &= sums + q_rest[i, c, None] * x_rest[None, j, c] + slack[i, None] >= limit[i, None]
            rows, columns = left.any(axis=1), left.any(axis=0)
            if not rows.all() or not columns.all():  # queries and candidates without a pair left
                grid = np.ix_(rows, columns)
                i, j, sums, left = i[rows], j[columns], sums[grid], left[grid]
        at = np.nonzero(left)
        i, j = i[at[0]], j[at[1]]
        scored += len(i)
        scores = np.concatenate([_product(q[i[a : a + 100_000]], x[j[a : a + 100_000]]) for a in range(0, len(i), 100_000)] or [kept[1]])
        good = (scores >= limit[i]) & (q_ids[i] != x_ids[j])
        i, j, scores = (np.concatenate([old, new[good]]) for old, new in zip((kept[0], kept[2], kept[1]), (i, j, scores)))
        best = best_of(i, ~scores, x_ids[j], k)  # ~s falls as s rises, without overflow
        kept = i[best], scores[best], j[best]
        n = np.bincount(kept[0], minlength=len(q))
        full = np.flatnonzero(n >= k)
        lowest = np.cumsum(n)[full] - 1
        limit[full] = np.maximum(limit[full], kept[1][lowest])
    return kept, limit, scored


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int, sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score; both tables: (vec_id long, vec array<double> of whole numbers)."""
    spark = candidates.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = rotation(candidates, sample)
    length = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    by = [F.col("len").desc(), F.col("vec_id"), F.col("vec")]
    by_length = candidates.withColumn("len", length).repartitionByRange(parts, *by[:2]).sortWithinPartitions(*by)
    bands = stored(blocks(by_length, BAND), "bands")
    # a number for each band: one row of a few bytes each
    numbers = bands.select("block").withColumn("band", F.row_number().over(Window.orderBy("block")) - 1)
    n_bands = numbers.count()
    every = max(1, -(-n_bands // MARKS))
    bands = bands.join(numbers, "block")
    # the longest vector of each of at most MARKS bands, of the first of every so many
    marks = bands.where(F.col("band") % every == 0).select("band", "longest").toArrow().sort_by("band").column("longest").to_numpy()
    bands = bands.select("band", "longest", *(F.col(c).alias(a) for a, c in prefixed(MATRIX, "x_")))
    some = queries.repartition(max(1, parts // 4), "vec_id").sortWithinPartitions("vec_id", "vec")
    tiles = blocks(some, TILE).withColumnRenamed("block", "tile").withColumnRenamed("longest", "q_longest")
    pair_types = [pa.int64(), pa.int64(), pa.int64()]

    # the band of the longest vectors: one row of at most BAND vectors
    top = bands.where(F.col("band") == 0).select(*(F.col(c) for c, _ in prefixed(MATRIX, "x_"))).toArrow().to_batches()
    longest = matrix_of(top[0], 0, "x_") if top and top[0].num_rows else (np.zeros(0, np.int64), np.zeros((0, 1)))

    def first(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q = matrix_of(batch, r)
                _, limit, _ = search(q_ids, q, *longest, turn, np.full(len(q), -np.inf), k)
                columns = [batch.column(c).slice(r, 1) for c in ("tile", "q_longest", "n", "dim", "ids", "matrix")]
                reached = int((batch.column("q_longest")[r].as_py() * marks * (1 + 1e-9) + 1 >= limit.min()).sum())
                low = pa.array([min(n_bands, reached * every)]), pa.array([limit.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, *low], ["tile", "q_longest", "n", "dim", "ids", "matrix", "reached", "limits"])

    def rest(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q = matrix_of(batch, r)
                x_ids, x = matrix_of(batch, r, "x_")
                limit = np.frombuffer(batch.column("limits")[r].as_py(), np.float64)
                (i, scores, j), _, _ = search(q_ids, q, x_ids, x, turn, limit, k)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((q_ids[i], x_ids[j], scores), pair_types)], ["query_id", "vec_id", "score"])

    seeded = stored(tiles.mapInArrow(first, f"tile long, q_longest double, {MATRIX}, reached long, limits binary"), "tiles")
    reached = seeded.where(F.col("reached") > 0).withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reached") - 1)))
    found = reached.join(bands.hint("merge"), "band").mapInArrow(rest, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """floor(scale * x) of every component, within +-2**62."""
    top = float(1 << 62)
    return finite_vectors(vectors, "vec_id", "embedding").withColumn(
        "vec", F.transform("vec", lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(F.least(F.lit(top), F.greatest(F.lit(-top), x * scale))).cast("double"))))
    )

"""Approximate nearest neighbours by a hierarchical k-means tree.

* The upper tree is fitted on a bounded sample (the ``sample`` rows with the smallest hash of vec_id); every
  row is led down it to a cell. In each cell a lower tree is fitted on a bounded sample of the cell's rows, all
  cells at once, and leads them on to leaves of about ``leaf_rows``. Leaves keep that size while the cells are not far larger
  than the sample (some tens of millions of vectors); beyond, they grow with the cells.
* Rows of a cell are stored in blocks, each row with its leaf; a cell with more rows than a few blocks is dealt to
  several tasks by a hash.
* A query takes nodes from a priority queue, the one with the nearest centre first; an inner node puts
  its children in, a leaf is visited: best bin first, in the upper tree for cells, in each of these for leaves.
* How far: ``calibration`` rows are searched exactly in all rows. The number of cells is widened until they hold all
  but a third of the neighbours that may be missed, and the reach (centre's distance against the query's k-th distance in its
  first leaves) until the visited leaves hold the share ``recall``. A query goes on to more cells while its
  cells hold fewer than k rows besides its own.
* Queries of a cell are put together, joined to its tree and then to its blocks, and measured on the original
  vectors: first in the best leaves of their first cells, which gives the k-th distance, then in the others
  within reach, where only rows within that distance come out. One window keeps the k nearest.

Vectors null, empty, all zero or with null or non-finite components, and null ids, take no part.
Vectors of unequal width: missing components are zero. Repeated rows (same id and vector) count once; a
query is no neighbour of its own id. Fewer candidates than k: all of them. Empty table: no row. Other
columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, stored
from .vectors import MATRIX, best_of, matrix_of, matrix_values, prefixed, same_width, unpack_lists, widen

BLOCK_ROWS, PACK_ROWS, SALT_ROWS, FIRST_CELLS = 2048, 256, 8192, 2
MEASURED = "query_id long, vec_id long, score double"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, by products."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = squared(x, centres).argmin(axis=1)
        used = np.unique(at)
        centres = np.stack([x[at == c].mean(axis=0) for c in used])
    return centres, squared(x, centres).argmin(axis=1)


class Tree:
    """Nodes by number, the root first: ``centres``, ``children`` (none: a leaf)."""

    def __init__(self, x: np.ndarray, leaf_rows: float, branches: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.rows = [x.mean(axis=0)], [[]], [len(x)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows or len(np.unique(x[rows], axis=0)) <= branches:
                continue
            centres, at = k_means(x[rows], branches, rng)
            if len(np.unique(at)) < 2:
                continue
            for c in np.unique(at):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), rows[at == c]))
                self.centres.append(centres[c])
                self.children.append([])
                self.rows.append(len(todo[-1][1]))
        self.centres = np.stack(self.centres)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf (number of its node) of each row."""
        x, centres = same_width(x, self.centres)
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = self.children[node]
            if not own or not len(rows):
                out[rows] = node
                continue
            at = squared(x[rows], centres[own]).argmin(axis=1)
            todo += [(child, rows[at == c]) for c, child in enumerate(own)]
        return out

    def visits(self, q: np.ndarray):
        """(leaf, distance a query must reach to get there) in the order of best bin first."""
        q, centres = same_width(q[None, :], self.centres)
        far = np.sqrt(((centres - q[0]) ** 2).sum(axis=1)).tolist()
        queue, reach = [(0.0, 0)], 0.0
        while queue:
            key, node = heapq.heappop(queue)
            reach = max(reach, key)
            if not self.children[node]:
                yield node, reach
            for child in self.children[node]:
                heapq.heappush(queue, (far[child], child))


def nearest(q_ids, q, x_ids, x, k, limits=None, allowed=None):
    """(query row, distance, candidate row) of the k nearest candidates of each query, none beyond its limit and only
    allowed ones. Distances are sums in the order of the components, so equal vectors have equal distances wherever they lie."""
    q, x = same_width(q, x)
    found = []
    for i in range(len(q)):
        j = np.flatnonzero(x_ids != q_ids[i] if allowed is None else (x_ids != q_ids[i]) & allowed[i])
        gap = x[j] - q[i]
        far = np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])
        if limits is not None:
            j, far = j[far <= limits[i]], far[far <= limits[i]]
        if len(j) > k:
            near = far <= np.partition(far, k - 1)[k - 1]
            j, far = j[near], far[near]
        found.append((np.full(len(j), i), far, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    rows, far, j = (np.concatenate(c) for c in zip(*found))
    best = best_of(rows, far, x_ids[j], k)
    return rows[best], far[best], j[best]


def _measured(q_ids, x_ids, found, **more) -> pa.RecordBatch:
    i, far, j = found
    columns = [pa.array(q_ids[i], pa.int64()), pa.array(x_ids[j], pa.int64()), pa.array(far, pa.float64())]
    columns += [pa.array(v, pa.int64()) for v in more.values()]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", *more])


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _bounded(vectors: DataFrame, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The n vectors with the smallest hash of vec_id."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(n).toArrow()
    return rows.column("vec_id").to_numpy(), unpack_lists(rows.column("vec").combine_chunks())


def lead(vectors: DataFrame, tree: Tree) -> DataFrame:
    """(vec_id, vec, cell), stored."""

    def down(batches):
        for batch in batches:
            cell = tree.leaves_of(unpack_lists(batch.column("vec"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "vec", "cell"])

    return stored(vectors.mapInArrow(down, "vec_id long, vec array<double>, cell long"), "cells")


def lower_trees(rows: DataFrame, sizes: dict[int, int], sample: int, leaf_rows: int) -> DataFrame:
    """(cell, tree binary), stored: each fitted on about ``sample`` rows of its cell, told by a hash."""
    spark = rows.sparkSession
    shares = spark.createDataFrame([(cell, min(1.0, sample / n)) for cell, n in sizes.items()], "cell long, share double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.pmod(F.xxhash64("vec_id", "vec", F.lit(5)), F.lit(1 << 30))
    picked = rows.join(F.broadcast(shares), "cell").where(hashed < F.col("share") * (1 << 30))  # one row a cell: bounded by the sample
    picked = picked.repartition(parts, "cell").sortWithinPartitions("cell", "vec_id", "vec")

    def fit(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell, (_, x) = batch.column("cell")[r].as_py(), matrix_of(batch, r, "x_")
                tree = Tree(x, max(leaf_rows, leaf_rows * len(x) / sizes[cell]), seed=cell)
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], ["cell", "tree"])

    return stored(_runs(picked, 1 << 30, "x_").mapInArrow(fit, "cell long, tree binary"), "trees")


def _tree(batch: pa.RecordBatch, row: int) -> Tree:
    """A cell that gave no row to the sample is one leaf."""
    data = batch.column("tree")[row].as_py()
    return Tree(np.zeros((1, 1)), 1) if data is None else pickle.loads(data)


def cell_blocks(rows: DataFrame, sizes: dict[int, int], trees: DataFrame) -> DataFrame:
    """(cell, x_n, x_dim, x_ids, x_matrix, x_leaves), stored."""
    spark = rows.sparkSession
    salts = spark.createDataFrame([(cell, 1 + n // SALT_ROWS) for cell, n in sizes.items()], "cell long, salts long")
    dealt = rows.join(F.broadcast(salts), "cell")  # one row a cell of the upper tree, and those are bounded by the sample
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.col("salts"))).select("cell", "salt", "vec_id", "vec")
    dealt = dealt.repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", "vec_id")
    blocks = _runs(dealt, BLOCK_ROWS, "x_").join(trees, "cell", "left")
    names = ["cell", *(p for p, _ in prefixed(MATRIX, "x_"))]

    def down(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                leaves = _tree(batch, r).leaves_of(matrix_of(batch, r, "x_")[1]).astype("<i4").tobytes()
                columns = [*(batch.column(c).slice(r, 1) for c in names), pa.array([leaves], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "x_leaves"])

    return stored(blocks.mapInArrow(down, f"cell long, {_schema('x_')}, x_leaves binary"), "blocks")


def _schema(prefix: str) -> str:
    return ", ".join(f"{p} {f.split()[1]}" for (p, _), f in zip(prefixed(MATRIX, prefix), MATRIX.split(", ")))


def _runs(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of one cell that follow each other, in blocks of at most ``size``."""
    names = [p for p, _ in prefixed(MATRIX, prefix)]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def row(cell, ids, m):
        values = [pa.array([cell], pa.int64()), *(pa.array([v], t) for v, t in zip(matrix_values(ids, m), types))]
        return pa.RecordBatch.from_arrays(values, ["cell", *names])

    def build(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids, m = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), unpack_lists(batch.column("vec"))
            if held is not None:
                a, b = same_width(held[2], m)
                cell, ids, m = np.concatenate([held[0], cell]), np.concatenate([held[1], ids]), np.concatenate([a, b])
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                last = b == len(cell)  # the run may go on in the next batch
                while b - a > (size if last else 0):
                    end = min(a + size, b)
                    yield row(int(cell[a]), ids[a:end], m[a:end])
                    a = end
                held = cell[a:b], ids[a:b], m[a:b]
        if held is not None and len(held[0]):
            yield row(int(held[0][0]), held[1], held[2])

    return rows.select("cell", "vec_id", "vec").mapInArrow(build, f"cell long, {_schema(prefix)}")


class Index(NamedTuple):
    tree: Tree  # the upper one
    ids: dict[int, int]  # distinct ids of each cell
    trees: DataFrame
    blocks: DataFrame
    cells: int  # to visit
    reach: float  # how far leaves may be, against the k-th distance so far


def _chosen_cells(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(vec_id, vec, cell, first): a row for each query and cell that it visits, best bin first."""
    tree, ids, cells = index.tree, index.ids, index.cells

    def choose(batches):
        for batch in batches:
            m, out = unpack_lists(batch.column("vec")), []
            for r in range(batch.num_rows):
                held, chosen = 0, []
                for turn, (cell, _) in enumerate(tree.visits(m[r])):
                    if turn >= cells and held > k:
                        break
                    if cell in ids:
                        held += ids[cell]
                        chosen.append(cell)
                out.append(chosen)
            columns = [*batch.columns, pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "cells"])

    asked = queries.select("vec_id", "vec").dropDuplicates().mapInArrow(choose, "vec_id long, vec array<double>, cells array<long>")
    asked = stored(asked, "visits").select("vec_id", "vec", F.posexplode("cells").alias("turn", "cell"))
    return asked.select("vec_id", "vec", "cell", (F.col("turn") < FIRST_CELLS).alias("first"))


def chosen_leaves(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """asked (cell, vec_id, vec, first, limit; null: no limit yet) in packs of one cell with the leaves that each
    query visits, as bits by node: without a limit the best ones with 4 k rows of the tree's sample, else all within reach but those."""
    reach = max(index.reach, 1e-9)
    names = ["cell", *(p for p, _ in prefixed(MATRIX, "q_"))]

    def choose(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tree, (_, q) = _tree(batch, r), matrix_of(batch, r, "q_")
                bits = np.zeros((len(q), len(tree.children)), bool)
                for i, (limit, first, *v) in enumerate(q.tolist()):
                    held = 0
                    for leaf, need in tree.visits(np.array(v)):
                        best = first and held < 4 * k
                        held += tree.rows[leaf]
                        if not best and (limit < 0 or need > reach * limit):  # below zero: no limit yet
                            break
                        bits[i, leaf] = best == (limit < 0)
                columns = [*(batch.column(c).slice(r, 1) for c in names), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "leaves"])

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_front = F.array(F.coalesce("limit", F.lit(-1.0)), F.col("first").cast("double"))  # both go along in front
    rows = asked.withColumn("vec", F.concat(in_front, "vec")).repartition(parts, "cell").sortWithinPartitions("cell", "vec_id")
    packs = _runs(rows, PACK_ROWS, "q_").join(index.trees, "cell", "left")
    return packs.mapInArrow(choose, f"cell long, {_schema('q_')}, leaves binary")


def allowed(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Which rows of the block lie in leaves that each query of the pack visits."""
    leaves = np.frombuffer(batch.column("x_leaves")[row].as_buffer(), "<i4")
    bits = np.frombuffer(batch.column("leaves")[row].as_buffer(), np.uint8).reshape(batch.column("q_n")[row].as_py(), -1)
    return np.unpackbits(bits, axis=1)[:, leaves].astype(bool)


def _measure(packs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Packs joined to their cell's blocks and measured."""

    def measure(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q = matrix_of(batch, r, "q_")
                x_ids, x = matrix_of(batch, r, "x_")
                limits = np.where(q[:, 0] < 0, np.inf, q[:, 0])
                yield _measured(q_ids, x_ids, nearest(q_ids, q[:, 2:], x_ids, x, k, limits, allowed(batch, r)))

    return packs.join(blocks, "cell").mapInArrow(measure, MEASURED)


def _first_found(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """The k nearest in the best leaves of each query's first cells, stored."""
    first = asked.where("first").withColumn("limit", F.lit(None).cast("double"))
    return stored(_best(_measure(chosen_leaves(first, index, k), index.blocks, k), k), "first")


def within_reach(asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """asked with each query's limit: its k-th distance so far, without end where it has fewer."""
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    return asked.join(limits, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))


def calibrate(rows: DataFrame, index: Index, k: int, n: int, recall: float) -> Index:
    """n rows are searched in all rows; cells, then the reach, widen until their recall is reached."""
    q_ids, q = _bounded(rows.select("vec_id", "vec"), n, salt=11)

    def exact(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x_ids, x = matrix_of(batch, r, "x_")
                leaves = np.frombuffer(batch.column("x_leaves")[r].as_buffer(), "<i4")
                found = nearest(q_ids, q, x_ids, x, k)
                cell = np.full(len(found[2]), batch.column("cell")[r].as_py())
                yield _measured(q_ids, x_ids, found, cell=cell, leaf=leaves[found[2]])

    true = _best(index.blocks.mapInArrow(exact, f"{MEASURED}, cell long, leaf long"), k).toPandas()  # n * k rows
    if true.empty:
        return index
    row_of = {int(i): r for r, i in enumerate(q_ids)}
    turns = {i: {cell: t for t, (cell, _) in enumerate(index.tree.visits(q[r]), 1)} for i, r in row_of.items()}
    turn = np.array([turns[i][cell] for i, cell in zip(true["query_id"], true["cell"])])
    index = index._replace(cells=int(_least(turn, 1 - (1 - recall) / 3)))

    spark = rows.sparkSession
    asked = spark.createDataFrame([(int(i), v) for i, v in zip(q_ids, q.tolist())], "vec_id long, vec array<double>")
    first = _first_found(_chosen_cells(asked, index, k), index, k).toPandas()  # n * k rows
    seen = set(zip(first["query_id"], first["vec_id"]))
    limit = dict(zip(first["query_id"][first["rank"] == k], first["score"][first["rank"] == k]))

    def needed(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tree, pairs = _tree(batch, r), batch.column("pairs")[r].as_py()
                need = {i: dict(tree.visits(q[row_of[i]])) for i in {p["query_id"] for p in pairs}}
                out = [(p["query_id"], p["leaf"], need[p["query_id"]][p["leaf"]]) for p in pairs]
                columns = [pa.array([batch.column("cell")[r].as_py()] * len(out), pa.int64())]
                columns += [pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "query_id", "leaf", "need"])

    pairs = spark.createDataFrame(true[["cell", "query_id", "leaf"]].drop_duplicates())
    pairs = pairs.groupBy("cell").agg(F.collect_list(F.struct("query_id", "leaf")).alias("pairs"))  # n * k at most
    pairs = pairs.join(index.trees, "cell", "left").mapInArrow(needed, "cell long, query_id long, leaf long, need double")
    need = {(p["cell"], p["query_id"], p["leaf"]): p["need"] for p in pairs.collect()}  # the same
    ratios = []
    for t, p in zip(turn, true.itertuples()):
        far, so_far = need[p.cell, p.query_id, p.leaf], limit.get(p.query_id, np.inf)
        found = (p.query_id, p.vec_id) in seen
        ratios.append(0.0 if found else np.inf if t > index.cells or not so_far else far / so_far)
    return index._replace(reach=float(_least(ratios, recall)))


def _least(values, share: float):
    """The least value that the given share of the values doesn't pass."""
    return np.sort(values)[min(len(values), int(np.ceil(share * len(values)))) - 1]


def build(candidates: DataFrame, k: int, recall: float, sample: int, cell_rows: int, leaf_rows: int, calibration: int) -> Index | None:
    """The calibrated index of all candidates; None: there are none."""
    candidates = candidates.dropDuplicates(["vec_id", "vec"])
    n = candidates.count()
    _, x = _bounded(candidates, sample, salt=3)
    if not len(x):
        return None
    tree = Tree(x, max(16.0, cell_rows * len(x) / n))
    rows = lead(candidates, tree)
    counted = rows.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).collect()  # a row a cell
    sizes = {r["cell"]: r["n"] for r in counted}
    trees = lower_trees(rows, sizes, sample, leaf_rows)
    index = Index(tree, {r["cell"]: r["ids"] for r in counted}, trees, cell_blocks(rows, sizes, trees), 1, np.inf)
    return calibrate(rows, index, k, calibration, recall)


def nearest_neighbours(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    recall: float = 0.95,
    sample: int = 20_000,
    cell_rows: int = 1024,
    leaf_rows: int = 16,
    calibration: int = 100,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); both tables: (vec_id long, vec array<double>)."""
    index = build(candidates, k, recall, sample, cell_rows, leaf_rows, calibration)
    if index is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _chosen_cells(queries, index, k)
    first = _first_found(asked, index, k)
    rest = chosen_leaves(within_reach(asked, first, k), index, k)
    found = _measure(rest, index.blocks, k).unionByName(first.select("query_id", "vec_id", "score"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def searchable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of ``embedding`` without the vectors that take no part."""
    return finite_vectors(vectors, "vec_id", "embedding").where(F.exists("vec", lambda v: v != 0))

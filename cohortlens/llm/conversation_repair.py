"""Conversation structure repair: cost DP, then the least of the cheapest audits by prefix-doubling ranks.

A conversation's rows in the order of turn (null first), role and text are edited at least cost so that their role
initials read ``(s?(ua)+)?``: Keep, Rerole, Delete, Insert. An audit is the edits' initials; of equal costs the
ASCII-least audit is taken.

1. ``faults``: Spark sorts all rows by conversation and turn (range partitions, so a long conversation spreads over
   many tasks). Blank and truncated texts are told by expressions. For duplicates only (conversation, hash of role
   and text) are grouped; turns that repeat an earlier one's row send a small mark to its place in the order.
2. Nodes are (row, state of the role pattern). ``cost_to_go`` goes backwards, many conversations at a time. An arc is
   optimal if its cost and its end's cost to go make up the node's own. ``ranks`` orders all nodes by their least audits of
   1, 2, 4, 8 ... edits, each from two of half the length; ``least_arcs`` takes the arc of least letter and rank
   (a node's arcs differ in letters); ``paths`` reads the audit through pointers that double their reach.
3. A conversation that lies in one task and within ``CHUNK_ROWS`` rows and ``CHUNK_BYTES`` is finished there. Others
   leave their task in chunks: each with its costs from state to state; one pass over these small rows, last chunk
   first, gives each chunk the costs behind it; then chunks are solved apart, for every state they can
   begin in; a last pass in order follows the state, counts across borders and feeds the hash, holding one chunk at a time.
   (The hash and the audit of one conversation are one value each: their bytes pass one task.)

Null conv_id is a conversation of its own (null in the result). Null role or text is one space. Null turns come first
and count in no gap. Equal rows are duplicates of the first of them, also rows of one turn. Empty text is blank. A
conversation without rows left has zeros, an empty audit and the hash of nothing. Empty table: no row. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, ship, stored

CHUNK_ROWS, CHUNK_BYTES, ROWS_AT_ONCE = 2048, 2 << 20, 16_384
TASK_BYTES = 32 << 20
BLANKS = " \t\n\x0b\x0c\r"

# States of the role pattern: nothing yet, after s, after u, after a. States by state and initial (s, u, a, other).
START, SYSTEM, USER, REPLY = range(4)
GO = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, REPLY, -1], [-1, USER, -1, -1]])
NEXT = np.array([USER, USER, REPLY, USER])  # after an inserted or changed row
ROLE_OF = {USER: "user", REPLY: "assistant"}
LETTERS = "DIKR"  # in ASCII order: Delete, Insert, Keep, Rerole
DELETE, INSERT, KEEP, REROLE = range(4)
PRICE_DELETE, PRICE_INSERT, PRICE_REROLE, PRICE_LATE = 3, 2, 2, 1
AT_END, TAIL = np.array([0, 4, 2, 0]), ("", "II", "I", "")  # of a conversation that ends in a state
FAR = 1 << 50

SORTED = "conv long, turn long, role string, text string, kind int, fault int"
ROW, DROPPED, MARK = range(3)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
CHUNK = "part int, chunk int, turns long, low long, high long, ends string, steps binary, cls binary, faults binary, roles array<string>, texts array<string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, kind after the damage that each row's crc32 tells; dropped rows stay as DROPPED."""
    ship(conversations.sparkSession)
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), space)

    rows = conversations.select(
        conv.alias("conv"),
        turn.alias("turn"),
        text(F.col("role")).alias("role"),
        text(F.col("text")).alias("text"),
        (F.crc32(F.concat(text(conv), F.lit(":"), text(turn)).cast("binary")) % 20).cast("int").alias("code"),
    )
    code = F.col("code")
    return rows.select(
        "conv",
        "turn",
        F.when(code == 0, F.lit("")).when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code <= 1, F.lit("")).when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(ROW), F.lit(ROW))).when(code == 0, F.array(F.lit(DROPPED))).otherwise(F.array(F.lit(ROW)))).alias("kind"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, kind) sorted by conversation, turn, role and text, with ``fault`` (duplicates are
    not told yet) and, in front of the rows of one turn and role, a MARK whose text is the hash of a row that an earlier turn has."""
    body = F.trim(F.col("text"), F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    told = rows.withColumn("fault", F.when(F.col("kind") == ROW, fault).otherwise(FINE))
    # a beginning of role and text, so that rows of one turn can be split; consistent with their whole order
    head = F.when(F.length("role") <= 32, F.left("text", F.lit(32))).otherwise("")
    told = told.withColumns({"role_head": F.left("role", F.lit(32)), "head": head})
    keyed = told.where((F.col("kind") == ROW) & (F.col("fault") != BLANK)).select("conv", "turn", "role", "role_head", "head", same.alias("same"))
    first = keyed.groupBy("conv", "same").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_if(F.col("turn").isNull()).alias("nulls"))
    first = first.where((F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("nulls") > 0)))
    first = stored(first.withColumn("low", F.when(F.col("nulls") == 0, F.col("low"))).select("conv", "same", "low"), "repeated-turns")
    keys = keyed.distinct().alias("k").join(first.alias("f"), F.col("k.conv").eqNullSafe(F.col("f.conv")) & (F.col("k.same") == F.col("f.same")))
    later = keys.where(F.col("turn").isNotNull() & (F.col("low").isNull() | (F.col("turn") > F.col("low"))))
    marks = later.select("k.conv", "turn", "role", F.col("k.same").alias("text"), F.lit(MARK).alias("kind"), F.lit(FINE).alias("fault"), "role_head", "head")
    every = told.select(marks.columns).unionByName(stored(marks, "marks"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    dealt = every.repartitionByRange(parts_for(rows, TASK_BYTES), *order, F.col("role_head"), F.col("head"))
    front = F.when(F.col("kind") == MARK, 0).otherwise(1)
    return dealt.sortWithinPartitions(*order, "role", front, "text").select("conv", "turn", "role", "text", "kind", "fault")


def moves(after: np.ndarray, cls: np.ndarray, must: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go (row by state) of Delete, Keep and Rerole, from those behind the row."""
    go = GO[:, cls].T
    keep = np.where((go >= 0) & ~must[:, None], np.take_along_axis(after, np.maximum(go, 0), 1) + late[:, None], FAR)
    change = np.where(~must[:, None], after[:, NEXT] + PRICE_REROLE + late[:, None], FAR)
    return after + PRICE_DELETE, keep, change


def cost_to_go(cls: np.ndarray, fault: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to go of all nodes (place by state) of sequences of rows; each has one place more than rows, whose
    costs are ``ends``."""
    base = np.cumsum(sizes + 1) - (sizes + 1)
    cost = np.empty((int((sizes + 1).sum()), 4), np.int64)
    cost[base + sizes] = ends
    must, late = (fault == BLANK) | (fault == DUPLICATE), PRICE_LATE * (fault == TRUNCATED)
    by_size = np.argsort(-sizes, kind="stable")
    count = np.searchsorted(-sizes[by_size], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    for back, n in enumerate(count.tolist(), 1):
        own = by_size[:n]
        place = base[own] + sizes[own] - back
        row = place - own
        best = np.minimum.reduce(moves(cost[place + 1], cls[row], must[row], late[row]))
        for _ in range(3):  # inserts in front of the row
            best = np.minimum(best, PRICE_INSERT + best[:, NEXT])
        cost[place] = best
    return cost


def optimal_arcs(cls: np.ndarray, fault: np.ndarray, sizes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places that are no end, optimal (place, state, letter), end node of each arc); a node is 4 * place + state."""
    last = np.zeros(len(cost), bool)
    last[np.cumsum(sizes + 1) - 1] = True
    place = np.flatnonzero(~last)
    must, late = (fault == BLANK) | (fault == DUPLICATE), PRICE_LATE * (fault == TRUNCATED)
    delete, keep, change = moves(cost[place + 1], cls, must, late)
    here = cost[place]
    costs = np.stack([delete, PRICE_INSERT + here[:, NEXT], keep, change], axis=2)
    node, after = 4 * place[:, None], 4 * (place[:, None] + 1)
    end = np.stack([after + np.arange(4), np.broadcast_to(node + NEXT, here.shape), after + np.maximum(GO[:, cls].T, 0), np.broadcast_to(after + NEXT, here.shape)], axis=2)
    return place, costs == here[:, :, None], end


def least_arcs(optimal: np.ndarray, end: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter, end) of each node's optimal arc of least letter, then least rank of its end."""
    order = np.where(optimal, np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[end], FAR)
    letter = order.argmin(axis=2)
    return letter, np.take_along_axis(end, letter[:, :, None], 2)[:, :, 0]


def ranks(place: np.ndarray, letter: np.ndarray, end: np.ndarray, n_nodes: int) -> np.ndarray:
    """Order of all nodes by their least audits: by the first letter, then the first 2, 4, 8 ...; an audit that ends is
    less than one that goes on."""
    rank, pointer = np.zeros(n_nodes, np.int64), np.arange(n_nodes)
    nodes = (4 * place[:, None] + np.arange(4)).reshape(-1)
    rank[nodes], pointer[nodes] = letter.reshape(-1) + 1, end.reshape(-1)
    while True:
        both = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        new = np.unique(both, return_inverse=True)[1]
        further = pointer[pointer]
        if (further == pointer).all():
            return new
        rank, pointer = new, further


def paths(place: np.ndarray, end: np.ndarray, starts: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, node) along the least path of each start, without its end: pointers of reach 1, 2, 4 ..., then every
    place of the audit from the longest reach down."""
    pointer = np.arange(n_nodes)
    pointer[(4 * place[:, None] + np.arange(4)).reshape(-1)] = end.reshape(-1)
    inner = pointer != np.arange(n_nodes)
    reach = [pointer]
    while (further := reach[-1][reach[-1]]).tobytes() != reach[-1].tobytes():
        reach.append(further)
    seq, at, node = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts
    seq, at, node = seq[inner[node]], at[inner[node]], node[inner[node]]
    for k in range(len(reach) - 1, -1, -1):
        far = reach[k][node]
        go = inner[far]
        seq, at, node = np.concatenate([seq, seq[go]]), np.concatenate([at, at[go] + (1 << k)]), np.concatenate([node, far[go]])
    order = np.lexsort((at, seq))
    return seq[order], node[order]


def audits(cls: np.ndarray, fault: np.ndarray, sizes: np.ndarray, ends: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """(cost to go of each sequence's first place, audit for each of ``entries`` (sequence by state), state it ends in)."""
    cost = cost_to_go(cls, fault, sizes, ends)
    place, optimal, end = optimal_arcs(cls, fault, sizes, cost)
    letter, first = least_arcs(optimal, end, np.zeros(cost.size, np.int64))
    letter, end = least_arcs(optimal, end, ranks(place, letter, first, cost.size))
    base = np.cumsum(sizes + 1) - (sizes + 1)
    starts = (4 * base[:, None] + entries).reshape(-1)
    seq, node = paths(place, end, starts, cost.size)
    letter_of, end_of = np.zeros(cost.size, np.int64), np.arange(cost.size)
    nodes = (4 * place[:, None] + np.arange(4)).reshape(-1)
    letter_of[nodes], end_of[nodes] = letter.reshape(-1), end.reshape(-1)
    text = np.frombuffer(LETTERS.encode(), np.uint8)[letter_of[node]].tobytes().decode()
    edges = np.searchsorted(seq, np.arange(len(starts) + 1)).tolist()
    out = [text[a:b] for a, b in zip(edges, edges[1:])]
    last = starts.copy()
    filled = np.diff(edges) > 0
    last[filled] = end_of[node[np.array(edges[1:])[filled] - 1]]
    width = entries.shape[1]
    return cost[base], [out[i : i + width] for i in range(0, len(out), width)], (last % 4).reshape(-1, width)


def repaired(audit: str, state: int, cls: list[int], roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines ``role:text`` after the edits, from a state on."""
    row = 0
    for letter in audit:
        if letter == "I":
            state = int(NEXT[state])
            yield ROLE_OF[state] + ":"
            continue
        if letter == "K":
            state = int(GO[state, cls[row]])
            yield f"{roles[row]}:{texts[row]}"
        elif letter == "R":
            state = int(NEXT[state])
            yield f"{ROLE_OF[state]}:{texts[row]}"
        row += 1


class Rows:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, conv: int | None):
        self.conv, self.roles, self.texts, self.faults = conv, [], [], []
        self.turns = 0  # distinct, without null
        self.low = self.high = None
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(role) + len(text)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def classes(self) -> np.ndarray:
        return np.array(["sua".find(r[:1]) if r else -1 for r in self.roles], np.int64) % 4  # other: 3

    def ends(self) -> str:
        """Initials of the first and the last role; other initials and no initial: a point."""
        return "".join(r[:1] if r[:1] in ("s", "u", "a") else "." for r in (self.roles[0], self.roles[-1])) if self.roles else ""


def illegal(cls: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Adjacent pairs other than su, ua, au within each sequence."""
    good = ((cls[:-1] == 0) & (cls[1:] == 1)) | ((cls[:-1] == 1) & (cls[1:] == 2)) | ((cls[:-1] == 2) & (cls[1:] == 1))
    bad = np.concatenate([[0], np.cumsum(~good)])
    return np.where(np.diff(edges) > 1, bad[np.maximum(edges[1:] - 1, 0)] - bad[np.minimum(edges[:-1], len(bad) - 1)], 0)


def _flat(held: list[Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(h.roles) for h in held], np.int64)
    cls = np.concatenate([h.classes() for h in held] + [np.zeros(0, np.int64)])
    return cls, np.array([f for h in held for f in h.faults], np.int64), sizes


def finished(held: list[Rows]) -> pa.RecordBatch:
    """RESULT rows of whole conversations."""
    cls, fault, sizes = _flat(held)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    cost, audit, state = audits(cls, fault, sizes, np.tile(AT_END, (len(held), 1)), np.full((len(held), 1), START))
    bad = illegal(cls, edges)
    out = []
    for i, h in enumerate(held):
        found = audit[i][0] + TAIL[state[i, 0]]
        lines = "\n".join(repaired(found, START, cls[edges[i] : edges[i + 1]].tolist(), h.roles, h.texts))
        counts = [h.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        gaps = 0 if h.low is None else h.high - h.low + 1 - h.turns
        out.append((h.conv, gaps, *counts, int(bad[i]), int(cost[i, START]), found, hashlib.sha256(lines.encode()).hexdigest()))
    return _batch(RESULT, out)


def chunk_row(rows: Rows, part: int, chunk: int) -> tuple:
    """CHUNK columns of a part of a conversation; ``steps``: cost from each state to each, by the state behind it."""
    cls, fault, sizes = _flat([rows])
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    steps = np.stack([cost_to_go(cls, fault, sizes, unit[:, s][None, :])[0] for s in range(4)], axis=1)
    faults, small = fault.astype(np.uint8), cls.astype(np.uint8)
    return part, chunk, rows.turns, rows.low, rows.high, rows.ends(), steps.astype("<i8").tobytes(), small.tobytes(), faults.tobytes(), rows.roles, rows.texts


TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def solve_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SORTED rows of one task -> RESULT rows of the conversations that lie within it, CHUNK rows of the others."""
    part, n_chunks = TaskContext.get().partitionId(), 0
    schema, blank = f"{RESULT}, {CHUNK}", (None,) * (1 + len(COUNTS) + 2)
    whole: list[Rows] = []
    waiting = 0
    current: Rows | None = None
    broken = True  # the first conversation may have begun in the task before
    seen = (None, None, None)  # turn, role, text of the row before
    marks: set[str] = set()
    marked = None

    def chunk(rows: Rows) -> pa.RecordBatch:
        nonlocal n_chunks
        n_chunks += 1
        return _batch(schema, [(rows.conv, *blank[1:], *chunk_row(rows, part, n_chunks))])

    def done() -> pa.RecordBatch:
        found = finished(whole)
        empty = [pa.nulls(found.num_rows, TYPES[f.split()[1]]) for f in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([*found.columns, *empty], [f.split()[0] for f in schema.split(", ")])

    for batch in batches:
        for conv, turn, role, text, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != current.conv:
                if current is not None:
                    if broken:
                        yield chunk(current)
                    else:
                        whole.append(current)
                        waiting += len(current.roles) + 1
                    broken = False
                current = Rows(conv)
                seen, marked = (None, None, None), None
            if kind == DROPPED:
                continue
            if kind == MARK:
                if marked != (turn, role):
                    marks, marked = set(), (turn, role)
                marks.add(text)
                continue
            if fault != BLANK:
                if seen == (turn, role, text):
                    fault = DUPLICATE
                elif marked == (turn, role) and hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest() in marks:
                    fault = DUPLICATE
                seen = turn, role, text
            if current.roles and (len(current.roles) >= CHUNK_ROWS or current.size + len(text) > CHUNK_BYTES):
                yield chunk(current)
                current, broken = Rows(conv), True
            current.add(turn, role, text, fault)
        if waiting >= ROWS_AT_ONCE:
            yield done()
            whole, waiting = [], 0
    if whole:
        yield done()
    if current is not None:
        yield chunk(current)


BEHIND = "part int, chunk int, behind array<long>"
SOLVED = "conv long, part int, chunk int, turns long, low long, high long, ends string, cost long, cls binary, faults binary, roles array<string>, texts array<string>, audits array<string>, states array<int>"


def costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, chunk, steps), a conversation's last chunk first -> costs to go behind each chunk."""
    at, behind = None, AT_END
    for batch in batches:
        out = []
        for conv, part, chunk, steps in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (conv,):
                at, behind = (conv,), AT_END
            out.append((part, chunk, behind.tolist()))
            behind = np.minimum((np.frombuffer(steps, "<i8").reshape(4, 4) + behind[None, :]).min(axis=1), FAR)
        yield _batch(BEHIND, out)


def solve_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the costs behind them -> their audits and last states for every first state."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            cls, fault = (np.frombuffer(row[c], np.uint8).astype(np.int64) for c in ("cls", "faults"))
            cost, audit, state = audits(cls, fault, np.array([len(cls)]), np.array([row["behind"]]), np.arange(4)[None, :])
            row |= {"cost": int(cost[0, START]), "audits": audit[0], "states": state[0].tolist()}
            yield _batch(SOLVED, [tuple(row[f.split()[0]] for f in SOLVED.split(", "))])


def join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved chunks in order -> RESULT rows of their conversations."""
    at = None
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            if at is None or at.conv != row["conv"]:
                if at is not None:
                    out.append(at.result())
                at = Joined(row["conv"], row["cost"])
            at.add(row)
        yield _batch(RESULT, out)
    if at is not None:
        yield _batch(RESULT, [at.result()])


class Joined:
    """A conversation's result while its chunks come in order."""

    def __init__(self, conv: int | None, cost: int):
        self.conv, self.cost, self.state = conv, cost, START
        self.counts = np.zeros(4, np.int64)
        self.illegal = self.turns = self.lines = 0
        self.low = self.high = None
        self.last = ""
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def _feed(self, audit: str, cls=(), roles=(), texts=()) -> None:
        for line in repaired(audit, self.state, cls, roles, texts):
            self.hash.update((("\n" if self.lines else "") + line).encode())
            self.lines += 1
        self.audit.append(audit)

    def add(self, row: dict) -> None:
        cls = np.frombuffer(row["cls"], np.uint8).astype(np.int64)
        self._feed(row["audits"][self.state], cls.tolist(), row["roles"], row["texts"])
        self.state = row["states"][self.state]
        self.counts += np.bincount(np.frombuffer(row["faults"], np.uint8), minlength=4)
        self.illegal += int(illegal(cls, np.array([0, len(cls)]))[0]) if len(cls) else 0
        if row["ends"]:
            self.illegal += bool(self.last) and self.last + row["ends"][0] not in ("su", "ua", "au")
            self.last = row["ends"][1]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]

    def result(self) -> tuple:
        self._feed(TAIL[self.state])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        blank, duplicate, truncated = (int(self.counts[f]) for f in (BLANK, DUPLICATE, TRUNCATED))
        return self.conv, gaps, blank, duplicate, truncated, int(self.illegal), self.cost, "".join(self.audit), self.hash.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """RESULT rows of all conversations in ``rows`` (conv, turn, role, text, kind), as ``damaged`` has them."""
    found = stored(faults(rows).mapInArrow(solve_sorted, f"{RESULT}, {CHUNK}"), "conversations")
    names = [f.split()[0] for f in RESULT.split(", ")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = found.where(F.col("chunk").isNotNull()).withColumnRenamed("conv_id", "conv")
    light = chunks.select("conv", "part", "chunk", "steps").repartition(parts, "conv")
    back = light.sortWithinPartitions("conv", F.desc("part"), F.desc("chunk"))
    behind = stored(back.mapInArrow(costs_behind, BEHIND), "costs-behind")
    wanted = [f.split()[0] for f in SOLVED.split(", ")]
    held = chunks.join(behind, ["part", "chunk"]).select(*(c for c in wanted if c in chunks.columns and c != "cost"), "behind")
    solved = stored(held.mapInArrow(solve_chunks, SOLVED), "solved-chunks")
    joined = solved.repartition(parts, "conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(join_chunks, RESULT)
    return found.where(F.col("chunk").isNull()).select(*names).unionByName(joined)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """RESULT rows of every conv_id of (conv_id, turn, role, text)."""
    return repair(damaged(conversations))

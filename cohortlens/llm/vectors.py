"""Blocks of vectors: matrices as single rows, shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MATRIX = "n int, dim int, ids binary, matrix binary"


def unpack_lists(lists: pa.Array) -> np.ndarray:
    """A matrix of a column of lists; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(sizes.max()) if len(sizes) else 0
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def widen(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return widen(a, dim), widen(b, dim)


def matrix_values(ids: np.ndarray, m: np.ndarray) -> list:
    """The MATRIX columns of a block."""
    return [len(ids), m.shape[1], ids.astype("<i8").tobytes(), np.ascontiguousarray(m, "<f8").tobytes()]


def matrix_of(batch: pa.RecordBatch, row: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    n, dim, ids, data = (batch.column(prefix + c)[row] for c in ("n", "dim", "ids", "matrix"))
    return np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(data.as_buffer(), "<f8").reshape(n.as_py(), dim.as_py())


def prefixed(schema: str, prefix: str) -> list[tuple[str, str]]:
    return [(prefix + f.split()[0], f.split()[0]) for f in schema.split(", ")]


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (score, id) of each query, in that order."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]

"""Vector columns as NumPy matrices inside Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


#: Queries that are scored at once.
TILE = 256


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """An Arrow list column as double rows; a row of another length raises."""
    if isinstance(column, pa.ChunkedArray):
        parts = [matrix(c, dimension) for c in column.chunks]
        return np.concatenate(parts) if parts else np.empty((0, dimension))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(flat) != len(column) * dimension or (len(column) and (np.diff(column.offsets.to_numpy()) != dimension).any()):
        raise ValueError(f"vectors must have {dimension} components")
    return flat.reshape(-1, dimension)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0, 1.0, norms)


def scores(queries: np.ndarray, rows: np.ndarray, space: str) -> np.ndarray:
    """Higher is more similar: cosine, dot product (``ip``), or 1 - squared distance (``l2``)."""
    if space == "cosine":
        return np.clip(unit(queries) @ unit(rows).T, -1.0, 1.0)
    if space == "ip":
        return queries @ rows.T
    if space == "l2":
        out = np.empty((len(queries), len(rows)))
        for i, q in enumerate(queries):
            out[i] = 1.0 - ((rows - q) ** 2).sum(1)
        return out
    raise ValueError(f"unknown space {space}")


def top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, by score, then id; queries are taken ``TILE`` at a time.

    Single precision finds who may be among the k, double precision scores
    those; values that single precision cannot hold are scored in double at once.
    """
    if ids.dtype == object:
        ids = np.unique(ids, return_inverse=True)[1]
    k = min(k, len(rows))
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = (unit(queries), unit(rows)) if space == "cosine" else (queries, rows)
        small, left = x.astype(np.float32), y.astype(np.float32).T.copy()
        # The error of single precision is below this part of the largest term.
        part = 4 * np.finfo(np.float32).eps * (x.shape[1] + 8)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        for at in range(0, len(x) if k else 0, TILE):
            t = slice(at, at + TILE)
            s = small[t] @ left
            slack = part * np.sqrt(xx[t] * (yy.max() if len(yy) else 0.0))
            if space == "l2":
                s = 2 * s - yy.astype(np.float32)
                slack = 2 * slack + part * (yy.max() + xx[t])
            if not (np.isfinite(s).all() and np.isfinite(slack).all()):
                s = scores(queries[t], rows, space)
                j = best(s, ids, k)
                i = np.repeat(np.arange(len(s)), k)
                parts.append((i + at, j.ravel(), s[i, j.ravel()]))
                continue
            edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(np.float64)
            i, j = np.nonzero(s >= (edge - 2 * slack)[:, None])
            exact = 1.0 - ((y[j] - x[i + at]) ** 2).sum(1) if space == "l2" else (x[i + at] * y[j]).sum(1)
            if space == "cosine":
                exact = np.clip(exact, -1.0, 1.0)
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            parts.append((i[keep] + at, j[keep], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*parts))


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rows.ravel(), kind))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``score`` the positions of its k best, by score, then id; exact in ties."""
    k = min(k, score.shape[1])
    if k == score.shape[1]:
        return np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    taken = np.take_along_axis(score, at, axis=1)
    edge = taken.min(1)
    # Where more share the edge than fit, the smaller ids do.
    for row in np.flatnonzero((score >= edge[:, None]).sum(1) > k):
        some = np.flatnonzero(score[row] >= edge[row])
        at[row] = some[np.lexsort((ids[some], -score[row, some]))[:k]]
        taken[row] = score[row, at[row]]
    return np.take_along_axis(at, np.lexsort((ids[at], -taken), axis=1), axis=1)

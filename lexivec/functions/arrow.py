"""Zero-copy bridges between Arrow list columns and numpy matrices, for
``mapInArrow`` kernels (no per-row Python objects)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(col, width: int) -> np.ndarray:
    """A non-null ``list<double>`` column of fixed length ``width`` as (rows × width)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, width)


def list_array(m: np.ndarray) -> pa.Array:
    """(rows × width) -> ``list<double>`` column."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    rows, width = m.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``sizes`` from ``starts``, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def matches(asked: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inner join: places in ``asked`` and the places of the same word in ``names``, repeats of both included."""
    words = names.dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    starts = np.searchsorted(ids[order], np.arange(len(words.dictionary) + 1))
    code = pc.fill_null(pc.index_in(asked, words.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(code >= 0)
    sizes = starts[code[rows] + 1] - starts[code[rows]]
    return np.repeat(rows, sizes), order[ranges(starts[code[rows]], sizes)]

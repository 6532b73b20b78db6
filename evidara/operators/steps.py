"""Texts of an Arrow batch a few at a time, so that Python holds a step's objects and not a batch's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of one step; a longer text makes a step of its own.
STEP_BYTES, STEP_ROWS = 2 << 20, 1024
#: The C library's call that gives free pages back; None where it has none.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def in_steps(texts: pa.Array, work: Callable[[list], pa.Array], limit: int = STEP_BYTES, rows: int = STEP_ROWS) -> pa.Array:
    """``work`` of the texts (or bytes), step by step, put together; freed memory goes back to the system at the end, as workers live on."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(size, before + limit, side="right"))))
        out.append(work(texts.slice(at, end - at).to_pylist()))
        at = end
    whole = pa.concat_arrays(out) if out else work([])
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)
    return whole

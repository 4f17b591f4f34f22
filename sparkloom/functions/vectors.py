"""Vector columns as numpy blocks, for use on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the usable rows, and their unit vectors (float32)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    flat = pc.list_flatten(column.filter(pa.array(ok)))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1)) if len(x) else np.zeros(0)
    good = np.isfinite(norm) & (norm > 0)  # null entries arrive as NaN
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, (x[good] / norm[good, None]).astype(np.float32)

"""Float vectors as integers: shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components beyond this magnitude (524,288.0 at a scale of 256) are an error: sums of 64 squares must fit 64 bits.
LIMIT = 1 << 27


def integers(col: pa.Array, scale: float, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, offsets): the rows whose list has no null or non-finite component (and `size` of them), floor(scale * x) of each."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.slice(off[0], off[-1] - off[0])
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan))
    off = off - off[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (bad[off[1:]] == bad[off[:-1]]) & np.asarray(col.is_valid())
    if size is not None:
        good &= np.diff(off) == size
    rows = np.flatnonzero(good)
    n = np.diff(off)[rows]
    x = np.floor(scale * x[np.repeat(good, np.diff(off))]) if len(rows) < len(col) else np.floor(scale * x)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT / scale:g}")
    return rows, x.astype(np.int64), np.concatenate([[0], np.cumsum(n)])

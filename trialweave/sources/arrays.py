"""Arrow lists of samples as numpy arrays and back, without a Python object for each sample."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The waveform of each row as 32-bit floats; null samples are NaN, none for a null row."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), column.offsets.to_numpy()
    for valid, a, b in zip(column.is_valid().to_numpy(zero_copy_only=False), offsets[:-1], offsets[1:], strict=True):
        yield flat[a:b] if valid else None


def lists(found: Iterable[np.ndarray | None]) -> pa.Array:
    """Rows of 32-bit floats, null for none."""
    found = list(found)
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in found)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, np.float32), *(x for x in found if x is not None)]).astype(np.float32, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in found], pa.bool_()))

"""Random numbers that follow from a row and the place of a draw, not from the layout of the data."""

from __future__ import annotations

import numpy as np


def uniform(h: np.ndarray, *place: int) -> np.ndarray:
    """Numbers between 0 and 1 from 64-bit hashes of rows and the place of the draw."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64)
        for p in place:
            x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(p + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53

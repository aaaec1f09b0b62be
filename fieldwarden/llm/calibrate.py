"""Isotonic calibration from binned raw scores."""

from __future__ import annotations

import numpy as np

#: Raw scores are counted in so many bins over 0 to 1, so that what reaches the driver is bounded.
BINS = 1000


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.asarray(raw) * BINS), 0, BINS - 1).astype(np.int64)


def isotonic(rows: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The calibrated score of every bin: pooled adjacent violators over the bins, one prior row at the mean.

    Empty bins take the value between their neighbours; without any row all bins are 0.5.
    """
    held = np.flatnonzero(rows > 0)
    if not len(held):
        return np.full(BINS, 0.5)
    mean = positives.sum() / rows.sum()
    blocks: list[list[float]] = []
    for i in held:
        blocks.append([float(positives[i]), float(rows[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    level = np.concatenate([np.full(int(b[2]), (b[0] + mean) / (b[1] + 1)) for b in blocks])
    return np.interp(np.arange(BINS), held, np.maximum.accumulate(level))

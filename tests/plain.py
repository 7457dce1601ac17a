"""Plain versions of steps that the library does in Spark."""

import numpy as np


def stack_of(xs, ys, h: int, w: int) -> np.ndarray:
    """Count rasters (n, h, w) of click lists; clicks out of bounds are left out."""
    out = np.zeros((len(xs), h, w), dtype=np.float32)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        x, y = np.asarray(x, dtype=int), np.asarray(y, dtype=int)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        np.add.at(out[k], (y[inside], x[inside]), 1)
    return np.minimum(out, 255)


def greedy_distinct(stack: np.ndarray, thresh: float) -> list[int]:
    """Indices that stay if each map too near an earlier one that stays is dropped."""
    flat = stack.reshape(len(stack), -1).astype(np.float64)
    gone = np.zeros(len(flat), dtype=bool)
    for i in range(len(flat)):
        if not gone[i]:
            near = ((flat[i + 1 :] - flat[i]) ** 2).sum(1) < thresh**2
            gone[i + 1 :] |= near
    return np.flatnonzero(~gone).tolist()

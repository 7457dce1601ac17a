"""Agreement of two maps as one number; numpy only.

Each metric takes a test map and a reference map of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed thresholds of the area metrics.
THRESHOLDS = np.arange(0.05, 1.0, 0.05)


def ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks from 1; equal values share theirs."""
    flat = np.asarray(values).ravel()
    _, group, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2.0)[group.ravel()]


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation; NaN for a constant side or fewer than two values."""
    if len(a) < 2:
        return float("nan")
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 0 else float("nan")


def iou_binary(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, dtype=bool), np.asarray(b, dtype=bool)
    union = (a | b).sum()
    return float((a & b).sum() / union) if union else 0.0


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=float)
    return (m - m.min()) / (m.max() - m.min() + 1e-8)


def auc_iou(test: np.ndarray, ref: np.ndarray) -> float:
    """Area under the overlap by threshold, of both maps scaled to 0 and 1."""
    a, b = _unit(test).ravel()[None], _unit(ref).ravel()[None]
    over_a, over_b = a > THRESHOLDS[:, None], b > THRESHOLDS[:, None]
    union = (over_a | over_b).sum(1)
    values = np.where(union > 0, (over_a & over_b).sum(1) / np.maximum(union, 1), 0.0)
    return float(np.trapezoid(values, THRESHOLDS))


def average_precision(truth: np.ndarray, score: np.ndarray) -> float:
    """Precision weighted by gain in recall, equal scores taken at once; 0 with no truth."""
    truth, score = np.asarray(truth, dtype=bool).ravel(), np.asarray(score).ravel()
    if not truth.any():
        return 0.0
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(truth[order])
    last = np.append(np.flatnonzero(np.diff(score[order])), len(score) - 1)
    precision, recall = hits[last] / (last + 1), hits[last] / hits[-1]
    return float((np.diff(np.append(0.0, recall)) * precision).sum())


def auc_map(test: np.ndarray, ref: np.ndarray) -> float:
    """Area under the average precision by the reference's threshold."""
    a, b = _unit(test), _unit(ref)
    return float(np.trapezoid([average_precision(b > t, a) for t in THRESHOLDS], THRESHOLDS))


def rankorder(test: np.ndarray, ref: np.ndarray) -> float:
    """Mean normalised rank of the test map where the reference is over zero; ties by place."""
    test, ref = np.asarray(test, dtype=float).ravel(), np.asarray(ref, dtype=float).ravel()
    top = ref.max() if len(ref) else 0.0
    on = (ref / top > 0) if top > 0 else np.zeros(len(ref), dtype=bool)
    if not on.any():
        return 0.0
    place = np.empty(len(test))
    place[np.argsort(test, kind="stable")] = np.arange(len(test))
    return float((place / max(1, len(test) - 1))[on].mean())


def spearman(test: np.ndarray, ref: np.ndarray) -> float:
    return pearson(ranks(test), ranks(ref))


def rank_pearson(test: np.ndarray, ref: np.ndarray) -> float:
    """Correlation of the ranks over all pixels, where the reference isn't zero."""
    on = np.asarray(ref).ravel() != 0
    return pearson(ranks(test)[on], ranks(ref)[on])


def rank_cosine(test: np.ndarray, ref: np.ndarray) -> float:
    """Cosine distance of the same ranks; 0 for equal directions."""
    on = np.asarray(ref).ravel() != 0
    a, b = ranks(test)[on], ranks(ref)[on]
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float(1.0 - (a * b).sum() / scale) if scale > 0 else float("nan")


def emd(test: np.ndarray, ref: np.ndarray, eps: float = 0.2, rounds: int = 10) -> float:
    """Sinkhorn transport cost of the maps' positive standard scores on the unit square.

    The cost is the squared distance, so its kernel acts on rows and columns in turn.
    """

    def mass(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, dtype=float)
        z = np.maximum((m - m.mean()) / (m.std() + 1e-8), 0) + 1e-12
        return z / z.sum()

    a, b = mass(test), mass(ref)
    grids = [np.linspace(0, 1, n) if n > 1 else np.zeros(1) for n in a.shape]
    costs = [(g[:, None] - g) ** 2 for g in grids]
    ky, kx = (np.exp(-c / eps) for c in costs)
    u, v = np.ones_like(a), np.ones_like(a)
    for _ in range(rounds):
        u = a / (ky @ v @ kx)
        v = b / (ky @ u @ kx)
    moved = (u * ((ky * costs[0]) @ v @ kx)).sum() + (u * (ky @ v @ (kx * costs[1]))).sum()
    return float(moved)


def crossentropy(test: np.ndarray, ref: np.ndarray) -> float:
    """Cross-entropy of the maps, each scaled to a sum of one."""
    p, q = (np.asarray(m, dtype=float).ravel() + 1e-12 for m in (ref, test))
    p, q = p / p.sum(), q / q.sum()
    return float(-(p * np.log(q)).sum())


def rsa(test: np.ndarray, ref: np.ndarray) -> float:
    """Correlation of the maps' row-by-row correlation matrices, above the diagonal."""

    def upper(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, dtype=float)
        m = m - m.mean(1, keepdims=True)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return (m @ m.T)[np.triu_indices(len(m), 1)]

    return pearson(upper(test), upper(ref))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "auc": auc_iou,
    "map": auc_map,
    "rankorder": rankorder,
    "spearman": spearman,
    "rank_pearson": rank_pearson,
    "rank_cosine": rank_cosine,
    "emd": emd,
    "crossentropy": crossentropy,
    "rsa": rsa,
}


def score(metric: str | Callable, test: np.ndarray, ref: np.ndarray) -> float:
    """A metric by name or as a callable; NaN where a map has NaN."""
    if not (np.isfinite(test).all() and np.isfinite(ref).all()):
        return float("nan")
    return float((METRICS[metric] if isinstance(metric, str) else metric)(test, ref))

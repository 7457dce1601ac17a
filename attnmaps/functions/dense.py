"""Numpy helpers on dense maps; they import no Spark."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def disk_runs(size: int) -> tuple[tuple[int, int], ...]:
    """(row offset, half width) of each row of the disk kernel of an odd size."""
    c = (size - 1) // 2
    return tuple((dy, int(np.sqrt(c * c - dy * dy) + 1e-9)) for dy in range(-c, c + 1))


def disk_kernel(size: int) -> np.ndarray:
    """Ones on the disk, normalised to a sum of one."""
    c = (size - 1) // 2
    out = np.zeros((size, size))
    for dy, half in disk_runs(size):
        out[c + dy, c - half : c + half + 1] = 1
    return out / out.sum()


def blur_once(maps: np.ndarray, size: int) -> np.ndarray:
    """Zero-padded convolution of the last two axes with the disk.

    Each kernel row is a run, so its sum along a row is a difference of cumulated sums.
    """
    h, w = maps.shape[-2:]
    sums = np.concatenate([np.zeros((*maps.shape[:-1], 1)), np.cumsum(maps, axis=-1, dtype=np.float64)], axis=-1)
    out = np.zeros(maps.shape)
    at = np.arange(w)
    cells = 0
    for dy, half in disk_runs(size):
        cells += 2 * half + 1
        to, frm = slice(max(0, -dy), min(h, h - dy)), slice(max(0, dy), min(h, h + dy))
        if to.start >= to.stop:
            continue
        rows = sums[..., frm, :]
        out[..., to, :] += rows[..., np.minimum(at + half + 1, w)] - rows[..., np.maximum(at - half, 0)]
    return out / cells


def blur(maps: np.ndarray, size: int) -> np.ndarray:
    """Two passes of the disk, each cut at the edges."""
    return blur_once(blur_once(maps, size), size)


def source_index(n: int, out: int) -> np.ndarray:
    """Nearest-exact source index of every target index."""
    return np.minimum(np.floor((np.arange(out) + 0.5) * n / out).astype(int), n - 1)


def resize_nearest(maps: np.ndarray, h: int, w: int) -> np.ndarray:
    return maps[..., source_index(maps.shape[-2], h)[:, None], source_index(maps.shape[-1], w)]


def centred(maps: np.ndarray, h: int, w: int) -> np.ndarray:
    """Centre the last two axes on a canvas: zeros around, or the centre cut out."""
    out = np.zeros((*maps.shape[:-2], h, w), dtype=maps.dtype)
    mh, mw = maps.shape[-2:]
    top, left = (h - mh) // 2, (w - mw) // 2
    y0, y1, x0, x1 = max(0, top), min(h, top + mh), max(0, left), min(w, left + mw)
    out[..., y0:y1, x0:x1] = maps[..., y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def resize_center_crop(maps: np.ndarray, short_side: int, crop: int) -> np.ndarray:
    h, w = maps.shape[-2:]
    scale = short_side / min(h, w)
    nh, nw = (short_side if n == min(h, w) else int(n * scale) for n in (h, w))
    resized = resize_nearest(maps, nh, nw)
    top, left = int(np.rint((nh - crop) / 2)), int(np.rint((nw - crop) / 2))
    out = np.zeros((*maps.shape[:-2], crop, crop), dtype=maps.dtype)
    y0, x0 = max(0, -top), max(0, -left)
    part = resized[..., max(0, top) : top + crop, max(0, left) : left + crop]
    out[..., y0 : y0 + part.shape[-2], x0 : x0 + part.shape[-1]] = part
    return out


def sparse_scale(maps: np.ndarray, scale: float, pad: bool = True) -> np.ndarray:
    """Mean of the source pixels that map to each cell, centred on the old canvas."""
    h, w = maps.shape[-2:]
    th, tw = int(h / scale), int(w / scale)
    cy = np.minimum(np.floor(np.arange(h) / scale).astype(int), th - 1)
    cx = np.minimum(np.floor(np.arange(w) / scale).astype(int), tw - 1)
    rows = np.zeros((*maps.shape[:-2], th, w))
    np.add.at(np.moveaxis(rows, -2, 0), cy, np.moveaxis(maps.astype(np.float64), -2, 0))
    sums = np.zeros((*maps.shape[:-2], th, tw))
    np.add.at(np.moveaxis(sums, -1, 0), cx, np.moveaxis(rows, -1, 0))
    counts = np.bincount(cy, minlength=th)[:, None] * np.bincount(cx, minlength=tw)
    out = sums / np.maximum(counts, 1)
    return centred(out, h, w) if pad else out


def nearest_scale(maps: np.ndarray, scale: float) -> np.ndarray:
    """Nearest-exact resize by 1 / scale, centred on the old canvas."""
    h, w = maps.shape[-2:]
    return centred(resize_nearest(maps, int(h / scale), int(w / scale)), h, w)


#: A point may lie so much deeper than the target's surface, as a factor.
DEPTH_SLACK = 1.1


def reproject(image: np.ndarray, depth: np.ndarray, target_depth: np.ndarray, w2c_s, w2c_t, k_s, k_t) -> np.ndarray:
    """The map as seen by the target camera.

    Pixels are lifted by their depth into the world, moved into the target's frame and
    projected, rounding half to even. The nearest point of a pixel counts, of equal
    ones the last source pixel; points behind the target camera or its surface are dropped.
    """
    h, w = image.shape
    ys, xs = np.mgrid[0:h, 0:w]
    d = np.asarray(depth, dtype=float).reshape(h, w).ravel()
    w2c_s, w2c_t, k_s, k_t = (np.asarray(m, dtype=float) for m in (w2c_s, w2c_t, k_s, k_t))
    rays = np.linalg.inv(k_s) @ np.stack([xs.ravel() * d, ys.ravel() * d, d])
    world = w2c_s[:3, :3].T @ (rays - w2c_s[:3, 3:4])
    seen = w2c_t[:3, :3] @ world + w2c_t[:3, 3:4]
    flat = k_t @ seen
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = np.rint(flat[0] / flat[2]), np.rint(flat[1] / flat[2])
    good = (seen[2] > 0) & np.isfinite(u) & np.isfinite(v) & (u >= 0) & (u < w) & (v >= 0) & (v < h)
    source = np.flatnonzero(good)
    cell = v[good].astype(int) * w + u[good].astype(int)
    z = seen[2][good]
    front = z <= DEPTH_SLACK * np.asarray(target_depth, dtype=float).ravel()[cell]
    source, cell, z = source[front], cell[front], z[front]
    order = np.lexsort((-source, z))
    first = np.unique(cell[order], return_index=True)[1]
    out = np.zeros(h * w)
    out[cell[order][first]] = image.ravel()[source[order][first]]
    return out.reshape(h, w)

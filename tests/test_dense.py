"""Numpy helpers against direct definitions and properties."""

import numpy as np
import plain
import pytest

from attnmaps.functions import dense, metrics

RNG = np.random.default_rng(0)


def convolve(m, k):
    c, out = len(k) // 2, np.zeros(m.shape)
    padded = np.pad(m, c)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = (padded[y : y + len(k), x : x + len(k)] * k).sum()
    return out


@pytest.mark.parametrize(("size", "cells"), [(3, 5), (5, 13), (11, 81), (21, 317), (51, 1961)])
def test_disk_kernel(size, cells):
    k = dense.disk_kernel(size)
    assert (k > 0).sum() == cells and k.sum() == pytest.approx(1)


@pytest.mark.parametrize("size", [1, 3, 5, 11, 41])
def test_blur_is_two_convolutions(size):
    m = RNG.random((17, 13))
    k = dense.disk_kernel(size)
    assert np.allclose(dense.blur(m, size), convolve(convolve(m, k), k))
    assert np.allclose(dense.blur(np.stack([m, 2 * m]), size)[1], 2 * dense.blur(m, size))


def test_blur_keeps_mass_inside():
    m = np.zeros((64, 64))
    m[32, 32] = 3
    assert dense.blur(m, 11).sum() == pytest.approx(3)


def test_sparse_scale_means_and_identity():
    m = RNG.random((8, 8))
    assert np.allclose(dense.sparse_scale(m, 1.0), m)
    small = dense.sparse_scale(m, 2.0, pad=False)
    assert np.allclose(small, m.reshape(4, 2, 4, 2).mean((1, 3)))
    assert np.allclose(dense.sparse_scale(m, 2.0)[2:6, 2:6], small)
    assert dense.sparse_scale(m, 0.5).shape == (8, 8)
    assert np.allclose(dense.nearest_scale(m, 1.0), m)


def test_identity_camera_is_identity_reprojection():
    m, depth = RNG.random((9, 7)), np.full((9, 7), 4.0)
    k = [[5.0, 0, 3], [0, 5, 4], [0, 0, 1]]
    assert np.allclose(dense.reproject(m, depth, depth, np.eye(4), np.eye(4), k, k), m)


def test_reprojection_moves_and_hides():
    m, k = np.arange(16.0).reshape(4, 4), [[2.0, 0, 0], [0, 2, 0], [0, 0, 1]]
    target = np.eye(4)
    target[0, 3] = 1.0
    depth = np.full((4, 4), 2.0)
    moved = dense.reproject(m, depth, depth, np.eye(4), target, k, k)
    assert np.allclose(moved[:, 1:], m[:, :-1]) and (moved[:, 0] == 0).all()
    assert (dense.reproject(m, depth, depth / 2, np.eye(4), target, k, k) == 0).all()


def test_metrics_on_identical_and_constant_maps():
    a = RNG.random((12, 12))
    assert metrics.auc_iou(a, a) == pytest.approx(0.9, abs=1e-6)
    assert metrics.spearman(a, a) == pytest.approx(1)
    assert metrics.rank_cosine(a, a) == pytest.approx(0)
    assert metrics.rsa(a, a) == pytest.approx(1)
    assert metrics.emd(a, a) < metrics.emd(a, np.roll(a[::-1], 6, 1)) + 1e-9
    flat = np.ones((12, 12))
    assert np.isnan(metrics.spearman(flat, a)) and metrics.auc_iou(flat, flat) == 0
    assert metrics.rankorder(a, np.zeros((12, 12))) == 0
    assert np.isnan(metrics.score("spearman", np.full((2, 2), np.nan), a[:2, :2]))


def test_average_ranks_and_precision():
    assert metrics.ranks(np.array([3, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
    assert metrics.average_precision([1, 0, 1, 0], [4, 3, 2, 1]) == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.average_precision([1, 0], [1, 1]) == pytest.approx(0.5)


def test_greedy_distinct_keeps_the_first():
    a = np.zeros((4, 2, 2))
    a[1, 0, 0], a[2, 0, 0], a[3, 0, 0] = 1, 2, 9
    assert plain.greedy_distinct(a, 1.5) == [0, 2, 3]


def test_rasters_leave_out_of_bounds_and_saturate():
    stack = plain.stack_of([[-1, 4, 0, 1], [2] * 300], [[0, 0, 4, 1], [3] * 300], 4, 4)
    assert stack[0].sum() == 1 and stack[1, 3, 2] == 255

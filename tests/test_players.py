"""The player classifier against a plain weighted logistic regression."""

import numpy as np
from pyspark.sql import functions as F

from attnmaps.operators import filters, players
from attnmaps.sources.fixtures import Inputs


def plain_regression(x, y, weight, reg, rounds=200):
    """Newton steps on the mean weighted loss, with a penalty on the coefficients of scaled features."""
    scale = np.sqrt((weight[:, None] * (x - np.average(x, axis=0, weights=weight)) ** 2).sum(0) / (weight.sum() * (len(x) - 1) / len(x)))
    z = np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)
    z = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.diag([reg] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (weight * (p - y)) / weight.sum() + penalty @ beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return z @ beta


def test_predictions(spark):
    t = Inputs(spark, "/root/testdata/sf0.01")
    labelled = filters.filter_players(filters.drop_trivial(t.subs), t.players)
    model = players.train_player_classifier(labelled, 4, 8, max_iter=200)
    rows = players.click_features(players.class_balance(labelled), 4, 8).select("sub_id", "features", F.col("label").cast("double").alias("y"), "weight").orderBy("sub_id").collect()
    margin = plain_regression(np.array([r.features.toArray() for r in rows]), np.array([r.y for r in rows]), np.array([r.weight for r in rows]), 0.01)
    found = {r.sub_id: r.good for r in players.predict_players(labelled, model, 4, 8).collect()}
    clear = [(r.sub_id, m) for r, m in zip(rows, margin) if abs(m) > 0.02]
    assert len(found) == len(rows) and len(clear) > 0.5 * len(rows)
    assert np.mean([found[i] == (m > 0) for i, m in clear]) > 0.99


def test_clicks_are_put_together_once(spark):
    """The labelled rows are written once: the predictions' plan reads neither orders nor their lines."""
    from attnmaps.plans.registry import QUERIES

    plan = QUERIES["job8_player_classifier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "labelled-" in plan and "lineitem" not in plan and "l_orderkey" not in plan

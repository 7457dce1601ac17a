"""Player quality: features of click sets, a classifier, and the filter by its verdict."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.functions.clicks import bin_features
from attnmaps.operators.stats import class_balance


def click_features(subs: DataFrame, div: int, extent: int) -> DataFrame:
    """Adds ``features``: multi-hot coarse columns, then rows, each up to ``extent``."""
    sets = bin_features(F.col("clicks"), div)
    hot = lambda part: F.transform(F.sequence(F.lit(0), F.lit(extent)), lambda k: F.when(F.array_contains(sets[part], k), 1.0).otherwise(0.0))
    return subs.withColumn("features", array_to_vector(F.concat(hot("cols"), hot("rows"))))


def train_player_classifier(labelled: DataFrame, div: int, extent: int, max_iter: int = 20, reg: float = 0.01):
    """Logistic regression of good (1) against bad (0) players, classes weighted evenly."""
    rows = click_features(class_balance(labelled), div, extent).select("features", F.col("label").cast("double").alias("label"), "weight")
    return LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="weight").fit(rows)


def predict_players(subs: DataFrame, model, div: int, extent: int) -> DataFrame:
    """Adds ``good``: 1 or 0 of each submission."""
    return model.transform(click_features(subs, div, extent)).withColumn("good", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def participant_filter(subs: DataFrame, scores: DataFrame, debug: bool = False) -> DataFrame:
    """Submissions scored 1 in (sub_id, good), or with ``debug`` all others; empty images go with them."""
    return subs.join(scores.select("sub_id", "good"), "sub_id").where((F.col("good") != 1) if debug else (F.col("good") == 1)).drop("good")

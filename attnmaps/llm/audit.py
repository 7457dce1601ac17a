"""Filter interaction audit: what each filter removes, in every order of filters.

A document is a mask of the filters that it fails, so a part of the corpus is at most 32
numbered cells of counts, summed by Spark. From there on nothing depends on the number of documents:
a Gray code walks through all subsets of filters and toggles one filter at a time. Each
cell counts the active filters that it fails; a cell whose counter leaves or reaches
zero leaves or joins the survivors. A step of an order is the difference of two subsets' survivors.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnmaps.llm.common import bound, fresh

MIN_WORDS = 100
#: Least distinct words, most capital letters, in percent of all words and characters.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules(text_col: str = "text") -> dict[str, Column]:
    """Failure conditions of the filters that look at one text only; null is an empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": counts["n"] < MIN_WORDS,
        "B": 100 * counts["distinct"].cast("long") < MIN_DISTINCT * counts["n"].cast("long"),
        "C": 100 * capitals > MAX_CAPITALS * chars,
        "D": text.rlike("[#$%&*|]"),
    }


def cells(
    docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, duplicate: str = "E",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail.

    Bit k of the mask is the k-th of ``fails``; the last bit is ``duplicate``: the text equals
    that of a row with a smaller id. Texts meet as digests, and repeated rows are counted
    before they travel. A null id is larger than any other; rows that share the smallest
    id of a text are all originals. ``labels`` may have several rows of a document: it is
    good or toxic if one of them says so.
    """
    fails = rules(text_col) if fails is None else fails
    doc, part, mask, digest, n = (fresh(k) for k in ("id", "part", "mask", "digest", "n"))
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(fails.values())]
    own = docs.select(
        F.col(id_col).cast("long").alias(doc), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias(part),
        sum(bits, F.lit(0)).cast("int").alias(mask), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias(digest),
    )
    counted = own.groupBy(doc, part, mask, digest).agg(F.count(F.lit(1)).alias(n))
    verdict = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias(doc)).agg(verdict("quality"), verdict("toxic"))
    place = F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("id"))
    groups = counted.join(known, doc, "left").groupBy(digest, part, mask, "quality", "toxic")
    alike = groups.agg(F.sum(n).alias("n"), F.min(F.struct(place.alias("place"), F.col(n).alias("n"))).alias("low"))
    first = alike.groupBy(digest).agg(F.min("low.place").alias("first"))
    firsts = F.when(F.col("low.place") == F.col("first"), F.col("low.n")).otherwise(0)
    last = 1 << len(fails)
    halves = F.array(F.struct(F.col(mask).alias("mask"), firsts.alias("n")), F.struct((F.col(mask) + last).alias("mask"), (F.col("n") - firsts).alias("n")))
    split = alike.join(first, digest).select(F.col(part).alias("part"), "quality", "toxic", F.explode(halves).alias("x")).where("x.n > 0")
    if_so = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("x.n"))), F.lit(0))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), if_so("quality").alias("good"), if_so("toxic").alias("toxic"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: (subsets, counts) from (masks, counts)."""
    size = len(counts)
    failed, left = [0] * size, counts.sum(axis=0)
    states = np.zeros_like(counts)
    states[0] = left
    subset = 0
    for step in range(1, size):
        bit = step & -step
        subset ^= bit
        turn = 1 if subset & bit else -1
        for mask in range(size):
            if mask & bit:
                before = failed[mask]
                failed[mask] += turn
                if before == 0:
                    left = left - counts[mask]
                elif failed[mask] == 0:
                    left = left + counts[mask]
        states[subset] = left
    return states


def steps(counts: np.ndarray, names: list[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    k, every = len(names), (1 << len(names)) - 1
    states = gray_walk(counts)
    failing = [sum(int(counts[m][0]) for m in range(len(counts)) if m >> b & 1) for b in range(k)]
    shapley = [0] * k
    for b in range(k):
        for s in range(len(counts)):
            if not s >> b & 1:
                before = s.bit_count()
                shapley[b] += factorial(before) * factorial(k - 1 - before) * int(states[s][0] - states[s | 1 << b][0])
    unique = [int(states[every ^ 1 << b][0] - states[every][0]) for b in range(k)]
    out = []
    for order in permutations(range(k)):
        name, before = "".join(names[b] for b in order), 0
        for step, b in enumerate(order, 1):
            after = before | 1 << b
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            out.append((name, step, int(states[after][0]), removed, failing[b] - removed, unique[b], good, toxic, shapley[b]))
            before = after
    return out


_STEP = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, duplicate: str = "E", **columns: str) -> DataFrame:
    """One row for each part, order of filters and step; parameters as for :func:`cells`.

    ``kept`` are the documents after the step, ``removed`` those that go in it, ``redundant``
    those that fail its filter but went before; ``good_lost`` and ``toxic_lost`` are among the
    removed. ``unique_fails`` fail only this filter; ``shapley`` sums its removals over all
    orders. A part has a row for every order even where counts are zero; an empty table has no parts.
    """
    names = [*(rules() if fails is None else fails), duplicate]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(names), 3), dtype=np.int64)
        counts[pdf["mask"].to_numpy()] = pdf[["n", "good", "toxic"]].to_numpy()
        out = pd.DataFrame(steps(counts, names), columns=_STEP)
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _STEP[2:])
    return cells(docs, labels, fails, duplicate, **columns).groupBy("part").applyInPandas(run, schema)

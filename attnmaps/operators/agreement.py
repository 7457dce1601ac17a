"""How much people agree: split-half ceilings, floors and constancy.

An iteration is a draw of weights: how often each submission is in the test half or the reference
half of an image. Draws are made on a narrow table without pixels. Then clicks and the weights
of all iterations meet in one exchange by image, and a task reads its images one after the other
and adds weights to the pixels that were clicked, so it holds the summed maps of one
image and level, never its submissions. Ceilings are scored on the spot; halves that must meet those of
another image travel as summed maps. Images of very many submissions are dealt out in
lots, whose summed maps are added. Blur and rescaling are linear, so doing them after the
mean changes nothing. Draws are hashes of (seed, image, level, iteration), so partitioning changes
nothing. A score that isn't defined (an empty half, a constant map) is NaN or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.functions import dense
from attnmaps.functions.metrics import score
from attnmaps.functions.paths import hashed_number
from attnmaps.operators import raster
from attnmaps.operators.joins import random_partner
from attnmaps.sources.shared import settled

#: Iterations whose draws, and whose summed maps, are one row.
CHUNK = 10
#: Submissions of an image from which they are dealt out in lots, and the most lots.
LOT, LOTS = 50_000, 64
#: Clicks that are gathered before they are added to an image's maps.
GATHER = 1 << 14
#: Places to which blurred maps are rounded, so that equal pixels have equal ranks.
PLACES = 10


@dataclass(frozen=True)
class Agreement:
    """Parameters of the agreement jobs.

    With ``levels`` over one, maps are made of the clicks up to each of so many cut points;
    the metric "auc" uses all levels, the others the last. Submissions may have a column
    ``kernel`` with their image's own blur size; without it ``kernel`` holds for all.
    """

    h: int = 256
    w: int = 256
    kernel: int = 21
    metric: str | Callable = "spearman"
    iterations: int = 20
    crop: int | None = None
    short_side: int | None = None
    redraw_test: bool = False
    seed: int = 0
    levels: int = 1
    min_clicks: int = 1


def stacks(subs: DataFrame, p: Agreement) -> DataFrame:
    """(image_key, level, sub_id, ord, kernel, cells): every map as the cells y * w + x of its clicks.

    Each row comes from one submission alone. With one level, submissions without a click
    within bounds have an empty map; with more, those with fewer than ``min_clicks`` clicks
    within bounds have none at a level.
    """
    kernel = F.col("kernel").cast("int") if "kernel" in subs.columns else F.lit(p.kernel)
    inside = lambda c: c["x"].between(0, p.w - 1) & c["y"].between(0, p.h - 1)
    cells = lambda clicks: F.transform(F.filter(clicks, inside), lambda c: (c["y"] * p.w + c["x"]).cast("int"))
    own = ["image_key", "sub_id", F.col("ord").cast("long").alias("ord"), kernel.alias("kernel")]
    if p.levels == 1:
        return subs.select(*own, F.lit(0).alias("level"), cells(F.col("clicks")).alias("cells"))
    rows = subs.join(raster.image_bins(subs, p.levels), "image_key").select(*own, "clicks", F.posexplode("bins").alias("level", "cut"))
    prefix = F.slice("clicks", F.lit(1), F.greatest(F.lit(0), F.ceil("cut").cast("int")))
    return rows.select("image_key", "sub_id", "ord", "kernel", "level", cells(prefix).alias("cells")).where(F.size("cells") >= max(1, p.min_clicks))


def members(clicked: DataFrame, p: Agreement) -> DataFrame:
    """(image_key, level, sub_id, ord): the maps that take part, without their pixels.

    ``clicked`` are stacks. All levels of an image are cut to the least number of maps of any, at least two; metrics
    other than "auc" look at the last level only.
    """
    maps = clicked.select("image_key", "level", "sub_id", "ord")
    if p.levels == 1:
        return maps
    kept = raster.align_levels(maps)
    return kept if p.metric == "auc" else kept.where(F.col("level") == p.levels - 1)


def half_weights(maps: DataFrame, p: Agreement, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, image_key, level, chunk, iteration, half, sub_id, weight, n, size) of every map in a half.

    The maps of an image are put in the order of a hash. The first half, rounded down, is
    the test half, the rest the reference half; each gets as many redraws of its own maps as the
    first half has, and the test half is on demand redrawn to the number of all maps. The mean
    map is the sum of weights times maps over the size. Maps that no draw takes have weight 0.
    Maps travel once for each ten iterations.
    """
    keys = [*by, "image_key", "level", "chunk", "iteration"]
    text = lambda *more: F.concat_ws("|", F.lit(p.seed).cast("string"), F.col("image_key"), F.col("level").cast("string"), F.col("iteration").cast("string"), *more)
    draw = lambda k, tag, n: F.pmod(hashed_number(text(k.cast("string"), F.lit(tag))), F.greatest(n, F.lit(1)).cast("long"))
    own = Window.partitionBy(*keys)
    chunks = F.explode(F.sequence(F.lit(0), F.lit((p.iterations - 1) // CHUNK)))
    rows = maps.select(*by, "image_key", "level", "sub_id", chunks.alias("chunk")).repartition(*by, "image_key", "chunk")  # serves all that follows
    first_of = F.col("chunk") * CHUNK
    rows = rows.withColumn("iteration", F.explode(F.sequence(first_of, F.least(first_of + CHUNK, F.lit(p.iterations)) - 1)))
    rank = F.row_number().over(own.orderBy(F.md5(text(F.col("sub_id").cast("string"))), "sub_id")).cast("long") - 1
    rows = rows.withColumns({"r": rank, "n": F.count(F.lit(1)).over(own)}).withColumn("h", F.floor(F.col("n") / 2))
    r, n, h = F.col("r"), F.col("n"), F.col("h")
    nobody = F.lit(None).cast("long")
    slot = lambda at, sub, w: F.struct(at.alias("rank"), sub.cast("long").alias("map"), F.lit(w).alias("w"))
    first, redrawn = draw(r, "test", h), draw(r, "again", 2 * h)
    mine = F.col("sub_id")
    slots = [F.when((r < h) & F.lit(p.redraw_test), slot(r, mine, 0)).otherwise(slot(r, mine, 1)), F.when(r < h, slot(h + draw(r, "ref", n - h), nobody, 1))]
    if p.redraw_test:
        slots.append(F.when(h > 0, slot(F.when(redrawn < h, redrawn).otherwise(draw(redrawn - h, "test", h)), nobody, 1)))
    else:
        slots.append(F.when(r < h, slot(first, nobody, 1)))
    drawn = rows.select(*keys, "n", "h", F.explode(F.array(*slots)).alias("x")).where("x is not null")
    # a place has one map and any number of redraws
    found = drawn.groupBy(*keys, "x.rank").agg(F.first("x.map", ignorenulls=True).alias("sub_id"), F.sum("x.w").alias("weight"), F.max("n").alias("n"), F.max("h").alias("h"))
    test = F.col("rank") < F.col("h")
    return found.select(*keys, F.when(test, "test").otherwise("ref").alias("half"), "sub_id", "weight", "n", _size(p, test).alias("size"))


def _size(p: Agreement, test: Column) -> Column:
    return F.when(test & F.lit(not p.redraw_test), 2 * F.floor(F.col("n") / 2)).otherwise(F.col("n"))


def _codes(weights: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, image_key, level, chunk, sub_id, codes, n): a map's weights in a chunk's iterations.

    A code is twice the weight, and one more in the reference half.
    """
    code = (2 * F.col("weight") + F.when(F.col("half") == "ref", 1).otherwise(0)).cast("int")
    codes = F.array_sort(F.collect_list(F.struct("iteration", code.alias("code"))))["code"]  # CHUNK at most
    return weights.groupBy(*by, "image_key", "level", "chunk", "sub_id").agg(codes.alias("codes"), F.max("n").alias("n"))


def with_lots(clicked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``lots``, over one for images with over ``LOT`` maps; if there are none, without a join."""
    counts = clicked.groupBy("image_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LOT)
    lots = counts.select("image_key", F.least(F.lit(LOTS), F.ceil(F.col("_n") / LOT).cast("int")).alias("lots"))
    if not lots.limit(1).count():
        return lambda df: df.withColumn("lots", F.lit(1))
    return lambda df: df.join(lots, "image_key", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))


class _Sums:
    """Weights of all iterations and both halves, summed by cell."""

    def __init__(self, columns: int):
        self.cells = np.zeros(0, dtype=np.int64)
        self.totals = np.zeros((0, columns), dtype=np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, cells: np.ndarray, weights: np.ndarray) -> None:
        if len(cells) > raster.MAX_COUNT:
            cells, counts = np.unique(cells, return_counts=True)
            cells = np.repeat(cells, np.minimum(counts, raster.MAX_COUNT))
        self.held.append((cells, weights))
        self.size += len(cells)
        if self.size >= GATHER:
            self.gather()

    def gather(self) -> None:
        if self.size:
            cells = np.concatenate([c for c, _ in self.held])
            weights = np.repeat(np.stack([w for _, w in self.held]), [len(c) for c, _ in self.held], axis=0)
            order = np.argsort(cells, kind="stable")
            own, starts = np.unique(cells[order], return_index=True)
            sums = np.add.reduceat(weights[order], starts, axis=0)
            every = np.union1d(self.cells, own)
            if len(every) > len(self.cells):
                grown = np.zeros((len(every), self.totals.shape[1]), dtype=np.int64)
                grown[np.searchsorted(every, self.cells)] = self.totals
                self.cells, self.totals = every, grown
            self.totals[np.searchsorted(every, own)] += sums
        self.held, self.size = [], 0


def _cropped(m: np.ndarray, p: Agreement, wider: bool = False) -> np.ndarray:
    if p.crop and not (wider and m.shape[-1] <= p.crop):
        return dense.resize_center_crop(m, p.short_side or min(p.h, p.w), p.crop)
    return m


def _ready(p: Agreement, totals: np.ndarray, half: str, n: int, kernel: int, move: Callable | None = None, wider: bool = False) -> np.ndarray:
    """Blurred mean maps, one an iteration, from summed ones (iterations, h * w)."""
    maps = totals.reshape(-1, p.h, p.w) / (2 * (n // 2) if half == "test" and not p.redraw_test else n)
    if move is not None and half == "test":
        maps = np.stack([move(m) for m in maps])
    return np.round(_cropped(dense.blur(maps, kernel), p, wider), PLACES)


def _agree(p: Agreement, test: np.ndarray | None, ref: np.ndarray | None, iterations: int) -> list[float]:
    if test is None or ref is None:
        return [float("nan")] * iterations
    return [score(p.metric, a, b) for a, b in zip(test, ref, strict=True)]


def _in_chunk(p: Agreement, chunk: int) -> int:
    return min(CHUNK, p.iterations - chunk * CHUNK)


class _Open:
    """The image and level whose rows are being read."""

    def __init__(self, p: Agreement, image: str, level: int, kernel: int):
        self.p, self.image, self.level, self.kernel = p, image, level, kernel
        self.sums: dict[tuple, _Sums] = {}
        self.n: dict[tuple, int] = {}

    def add(self, by: tuple, n: int, chunks: list[tuple[int, np.ndarray]], cells: np.ndarray) -> None:
        if by not in self.sums:
            self.sums[by], self.n[by] = _Sums(2 * self.p.iterations), n
        weights = np.zeros(2 * self.p.iterations, dtype=np.int64)
        for chunk, codes in chunks:
            at = 2 * (chunk * CHUNK + np.arange(len(codes))) + (codes & 1)
            weights[at] = codes >> 1
        self.sums[by].add(cells, weights)

    def rows(self, by: tuple, lots: int, of: list[str] | None, asks: bool, kinds: tuple[str, ...]) -> Iterator[tuple]:
        """Scores of the ceiling, and halves for where they are wanted."""
        p, own, n = self.p, self.sums[by], self.n[by]
        own.gather()
        there = {"test": n >= 2, "ref": n >= 1}
        for chunk in range(-(-p.iterations // CHUNK)):
            size = _in_chunk(p, chunk)
            part = {h: own.totals[:, 2 * chunk * CHUNK + k : 2 * (chunk * CHUNK + size) : 2] for k, h in enumerate(there)}
            key = (*by, self.image, self.level)
            sent = lambda image, kind, h: (*by, image, self.level, kind, chunk, h, own.cells.astype("<i4").tobytes(), np.ascontiguousarray(part[h], dtype="<i8").tobytes(), n, self.kernel, None)  # noqa: E731, B023
            if "ceiling" in kinds and lots == 1:
                maps = {}
                for h in (h for h in there if there[h]):
                    full = np.zeros((size, p.h * p.w))
                    full[:, own.cells] = part[h].T
                    maps[h] = _ready(p, full, h, n, self.kernel)
                yield (*key, "ceiling", chunk, None, None, None, None, None, _agree(p, maps.get("test"), maps.get("ref"), size))
            wanted = [("ceiling", self.image, h) for h in there] if "ceiling" in kinds and lots > 1 else []
            if "floor" in kinds:
                wanted += [("floor", self.image, "test")] * asks + [("floor", image, "ref") for image in of or []]
            if not kinds:
                wanted = [("", self.image, h) for h in there]
            yield from (sent(image, kind, h) for kind, image, h in wanted if there[h])


_META, _WEIGHTS, _PIXELS = 0, 1, 2


def half_maps(clicked: DataFrame, p: Agreement, by: dict[str, str] | None = None, maps: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Summed maps of both halves of every image, or what the kinds of scores make of them.

    ``clicked`` are stacks, which are read several times. Rows are (by, image_key, level, kind, chunk, half, cells, totals, n, kernel, scores): the
    cells that were clicked and their sums in each of a chunk's iterations, packed as
    32- and 64-bit integers. An image of many submissions has such a row for each lot. With
    "ceiling" among ``kinds``, images in one lot have their scores in place of halves; with
    "floor", a test half stays with its image and a reference half goes to the images whose
    partner its image is. ``maps`` are the members that take part, which may be in several draws, told
    apart by the columns ``by`` (name: type).
    """
    by = by or {}
    maps = members(clicked, p) if maps is None else maps
    lotted = with_lots(clicked)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own_lot = F.pmod(F.xxhash64("sub_id"), "lots").cast("int").alias("lot")
    shared = ["image_key", own_lot, "lots", "level", F.col("sub_id").cast("long").alias("sub_id")]
    rows = lotted(_codes(half_weights(maps, p, tuple(by)), tuple(by))).select(*shared, F.lit(_WEIGHTS).alias("kind"), *by, "chunk", "codes", "n", null("array<int>", "cells"), null("int", "kernel"), null("array<string>", "of"))
    nothing = [null(t, c) for c, t in by.items()] + [null("int", "chunk"), null("array<int>", "codes"), null("long", "n")]
    wanted = clicked.where(F.col("level") == p.levels - 1) if p.levels > 1 and p.metric != "auc" else clicked
    rows = rows.unionByName(lotted(wanted).select(*shared, F.lit(_PIXELS).alias("kind"), *nothing, "cells", "kernel", null("array<string>", "of")))
    if "floor" in kinds:
        partners = random_partner(clicked, p.seed)
        # null among an image's askers: it asks itself; few images share a partner
        both = partners.select("image_key", null("string", "of")).unionAll(partners.select(F.col("partner").alias("image_key"), F.col("image_key").alias("of")))
        asked = lotted(both.groupBy("image_key").agg(F.transform(F.collect_list(F.struct("of")), lambda x: x["of"]).alias("of")))
        asked = asked.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        rows = rows.unionByName(asked.select("image_key", "lot", "lots", null("int", "level"), null("long", "sub_id"), F.lit(_META).alias("kind"), *nothing, null("array<int>", "cells"), null("int", "kernel"), "of"))

    names = [*by, "image_key", "level", "kind", "chunk", "half", "cells", "totals", "n", "kernel", "scores"]
    sql = ", ".join([*[f"{c} {t}" for c, t in by.items()], "image_key string, level int, kind string, chunk int, half string, cells binary, totals binary, n long, kernel int, scores array<double>"])
    arrow = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
    kinds_of = [arrow[t] for t in by.values()] + [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.float64())]
    schema = pa.schema(list(zip(names, kinds_of, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, asks, lots, waiting, meta = None, None, False, 1, [], None

        def over() -> Iterator[pa.RecordBatch]:
            for key in now.sums if now is not None else ():
                for row in now.rows(key, lots, of, asks, kinds):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        place = None
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            listed = {c: (columns[c].values.to_numpy(zero_copy_only=False), columns[c].offsets.to_numpy()) for c in ("codes", "cells")}
            part = lambda c, i: listed[c][0][listed[c][1][i] : listed[c][1][i + 1]]  # noqa: E731, B023
            plain = {c: columns[c].to_pylist() for c in ("image_key", "lot", "lots", "level", "kind", "chunk", "n", "kernel", "of", *by)}
            for i, kind in enumerate(plain["kind"]):
                here = (plain["image_key"][i], plain["lot"][i], plain["level"][i])
                if here != place:
                    yield from over()
                    now, waiting, place, lots = None, [], here, plain["lots"][i]
                    if meta is None or meta[0] != here[:2]:
                        meta, of, asks = None, None, False
                if kind == _META:
                    asked = plain["of"][i]
                    meta, of, asks = (here[:2],), [x for x in asked if x is not None], None in asked
                elif kind == _WEIGHTS:
                    waiting.append((tuple(plain[c][i] for c in by), plain["n"][i], plain["chunk"][i], part("codes", i)))
                elif waiting:
                    now = now or _Open(p, here[0], here[2], plain["kernel"][i])
                    groups: dict[tuple, list] = {}
                    for key, n, chunk, codes in waiting:
                        groups.setdefault((key, n), []).append((chunk, codes))
                    for (key, n), chunks in groups.items():
                        now.add(key, n, chunks, part("cells", i))
                    waiting = []
        yield from over()

    dealt = rows.repartition("image_key", "lot").sortWithinPartitions("image_key", "lot", "level", "sub_id", "kind")
    return dealt.mapInArrow(run, sql)


def _added(p: Agreement, rows: pd.DataFrame, half: str, size: int, move: Callable | None = None, wider: bool = False) -> np.ndarray | None:
    """Mean maps of a half from its rows, one a lot; None if it isn't there."""
    own = rows[rows["half"] == half]
    if own.empty:
        return None
    full = np.zeros((size, p.h * p.w))
    for cells, totals in zip(own["cells"], own["totals"], strict=True):
        at = np.frombuffer(cells, dtype="<i4")
        full[:, at] += np.frombuffer(totals, dtype="<i8").reshape(len(at), size).T
    return _ready(p, full, half, int(own["n"].iloc[0]), int(own["kernel"].iloc[0]), move, wider)


def _scores(halves: DataFrame, p: Agreement, by: dict[str, str] | None = None) -> DataFrame:
    """(by, image_key, level, kind, iteration, score) from scores and from halves that meet."""
    by = by or {}
    schema = ", ".join([*[f"{c} {t}" for c, t in by.items()], "image_key string, level int, kind string, iteration int, score double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        size = _in_chunk(p, chunk)
        known = pdf["scores"].dropna()
        found = list(known.iloc[0]) if len(known) else _agree(p, _added(p, pdf, "test", size), _added(p, pdf, "ref", size), size)
        out = pd.DataFrame({"iteration": np.arange(chunk * CHUNK, chunk * CHUNK + size), "score": found})
        for c in (*by, "image_key", "level", "kind"):
            out[c] = pdf[c].iloc[0]
        return out[[*by, "image_key", "level", "kind", "iteration", "score"]]

    return halves.groupBy(*by, "image_key", "kind", "level", "chunk").applyInPandas(run, schema)


def _clicked(subs: DataFrame, p: Agreement) -> DataFrame:
    """The stacks, written once to the shared folder: draws, partners and lots read their narrow columns from there."""
    return settled(stacks(subs, p), "stacks")


def split_half(subs: DataFrame, p: Agreement) -> DataFrame:
    """(image_key, level, "ceiling", iteration, score): agreement of random halves of an image's maps."""
    return _scores(half_maps(_clicked(subs, p), p, kinds=("ceiling",)), p)


def floor(subs: DataFrame, p: Agreement) -> DataFrame:
    """(image_key, level, "floor", iteration, score): test half against a half of another image, level by level."""
    return _scores(half_maps(_clicked(subs, p), p, kinds=("floor",)), p)


def ceiling_floor(subs: DataFrame, p: Agreement) -> DataFrame:
    """Both of the above from the same halves."""
    return _scores(half_maps(_clicked(subs, p), p, kinds=("ceiling", "floor")), p)


def subject_sweep(subs: DataFrame, caps: list[int], p: Agreement) -> DataFrame:
    """(cap, image_key, level, kind, iteration, score) for every cap on subjects, ceiling and floor.

    One job: an image's map takes part in every cap that its place in file order is within; its
    clicks travel once for all caps.
    """
    rank = F.row_number().over(Window.partitionBy("image_key", "level").orderBy("ord", "sub_id"))
    every = F.explode(F.filter(F.array(*map(F.lit, caps)), lambda c: c >= F.col("_rank")))
    clicked = _clicked(subs, p)
    capped = members(clicked, p).withColumn("_rank", rank).withColumn("cap", every).drop("_rank")
    by = {"cap": "int"}
    return _scores(half_maps(clicked, p, by, capped, ("ceiling", "floor")), p, by)


_CONSTANCY = "image_key string, axis string, diff int, level int, kind string, iteration int, score double"


def frame_lots(pairs: DataFrame, seed: int) -> DataFrame:
    """(key, diff, target_key, kind): every pair, and the pair with a random other pair's frame as its floor."""
    lots = pairs.select(F.struct("key", F.col("diff").cast("int").alias("diff")).alias("pair"), "target_key")
    chance = random_partner(lots, seed, "pair").select("pair", F.col("partner.key").alias("target_key"))
    both = lots.withColumn("kind", F.lit("ceiling")).unionByName(chance.withColumn("kind", F.lit("floor")))
    return both.select("pair.key", "pair.diff", "target_key", "kind")


def _constancy(subs: DataFrame, pairs: DataFrame, meta: DataFrame, axis: str, p: Agreement, transform: Callable) -> DataFrame:
    """Scores of frame pairs and their floors; ``pairs`` has (key, diff, target_key).

    ``transform(map, own, other)`` maps the test frame's mean map onto the target frame. What
    it needs of the two frames comes as one row a pair; it never travels with clicks.
    """
    halves, lots, keys = half_maps(_clicked(subs, p), p).drop("kind", "scores"), frame_lots(pairs, p.seed), ["key", "diff", "kind"]
    role = lambda half, key: lots.select(F.col(key).alias("image_key"), F.lit(half).alias("half"), *keys)
    roles = role("test", "key").unionAll(role("ref", "target_key"))
    rows = halves.join(roles, ["image_key", "half"]).select(*keys, "level", "chunk", "half", "cells", "totals", "n", "kernel")
    extra = [c for c in meta.columns if c != "key"]
    own, other = (meta.select(F.col("key").alias(k), F.struct(*extra).alias(n)) for k, n in (("key", "own"), ("target_key", "other")))
    moved = lots.where("kind = 'ceiling' and diff <> 0").join(own, "key").join(other, "target_key").select(*keys, "own", "other")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        name, diff, kind = key
        move = None
        if len(right):
            a, b = right["own"].iloc[0], right["other"].iloc[0]
            move = lambda m: transform(m, a, b)
        found = []
        if move is not None or kind == "floor" or diff == 0:
            for (level, chunk), part in left.groupby(["level", "chunk"]) if len(left) else ():
                size = _in_chunk(p, chunk)
                both = [_added(p, part, h, size, move, wider=True) for h in ("test", "ref")]
                if all(m is not None for m in both):
                    found += [(level, chunk * CHUNK + k, x) for k, x in enumerate(_agree(p, *both, size))]
        out = pd.DataFrame(found, columns=["level", "iteration", "score"])
        return out.assign(image_key=name, axis=axis, diff=diff, kind=kind)[["image_key", "axis", "diff", "level", "kind", "iteration", "score"]]

    apart = moved.select(*[F.col(c).alias(c) for c in moved.columns])  # column ids of its own, for the cogroup
    return rows.groupBy(*keys).cogroup(apart.groupBy(*keys)).applyInPandas(run, _CONSTANCY)


def scale_constancy(subs: DataFrame, pairs: DataFrame, scales: DataFrame, p: Agreement) -> DataFrame:
    """Agreement across zooms: the test map is rescaled by scale / target scale.

    ``scales`` has (key, scale). A pair of a frame with itself takes both halves from one
    permutation. Floors meet a random other pair's frame, without rescaling.
    """
    return _constancy(subs, pairs, scales.select("key", "scale"), "scale", p, lambda m, own, other: dense.sparse_scale(m, own["scale"] / other["scale"]))


def rotation_constancy(subs: DataFrame, pairs: DataFrame, cameras: DataFrame, p: Agreement) -> DataFrame:
    """Agreement across directions: the test map is reprojected into the target camera.

    ``cameras`` has (key, w2c, k, depth), the matrices as nested arrays, depth row-major.
    """

    def move(m: np.ndarray, own: dict, other: dict) -> np.ndarray:
        as_matrix = lambda x: np.array([list(r) for r in x], dtype=float)
        return dense.reproject(m, np.asarray(own["depth"]), np.asarray(other["depth"]), as_matrix(own["w2c"]), as_matrix(other["w2c"]), as_matrix(own["k"]), as_matrix(other["k"]))

    return _constancy(subs, pairs, cameras.select("key", "w2c", "k", "depth"), "rotation", p, move)

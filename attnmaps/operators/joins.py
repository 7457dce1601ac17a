"""Joins of images, devices, frames and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnmaps.functions.paths import frame_of, hashed_number, rotation_targets, scale_targets, sequence_of


def device_flags(devices: DataFrame) -> DataFrame:
    """(user_id, is_mobile, conflicting): one row a user; of two flags the greater counts."""
    return devices.groupBy("user_id").agg(F.max("is_mobile").alias("is_mobile"), (F.countDistinct("is_mobile") > 1).alias("conflicting"))


def attach_device(subs: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions with their user's device flag (false if unknown), and the users in conflict."""
    flags = device_flags(devices)
    joined = subs.drop("is_mobile").join(flags.select("user_id", "is_mobile"), "user_id", "left")
    return joined.withColumn("is_mobile", F.coalesce("is_mobile", F.lit(False))), flags.where("conflicting").select("user_id")


def attach_dimensions(images: DataFrame, dims: DataFrame, default: tuple[int, int]) -> DataFrame:
    """Images with (h, w), the default where they are unknown."""
    joined = images.join(dims.select("image_key", "width", "height"), "image_key", "left")
    return joined.withColumns({"h": F.coalesce("height", F.lit(default[0])), "w": F.coalesce("width", F.lit(default[1]))})


#: Bytes of the numbers of a reference block, of which a task holds one at a time.
BLOCK_BYTES = 32 << 20
#: Queries that go through the cells together.
QUERIES_AT_ONCE = 20_000
#: References that cells are made around, drawn by a hash of their ids; the driver holds these only.
PIVOTS = 64


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(vectors, pivots): distances, summed directly so that rounding is relative to them."""
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in pivots], axis=1)


class _Nearest:
    """The nearest reference so far of a batch of queries."""

    def __init__(self, ids: list, vectors: np.ndarray):
        self.ids, self.asked = ids, vectors
        self.best = np.full(len(ids), np.inf)
        self.ref = np.zeros(len(ids), dtype=np.int64)

    def meet(self, known_ids: np.ndarray, known: np.ndarray, some: np.ndarray) -> None:
        """Exact distances for every reference that rounding can't rule out, by matrices for the rest."""
        norms, size = (known**2).sum(1), np.sqrt((known**2).sum(1).max(initial=0.0))
        for at in range(0, len(some), 256):
            own = some[at : at + 256]
            part = self.asked[own]
            rough = norms - 2 * part @ known.T
            slack = 8 * known.shape[1] * np.finfo(float).eps * (np.sqrt((part**2).sum(1)) + size) ** 2
            rows, columns = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
            for k in range(0, len(rows), 1 << 16):
                r, c = rows[k : k + (1 << 16)], columns[k : k + (1 << 16)]
                exact = np.sqrt(((known[c] - part[r]) ** 2).sum(1))
                order = np.lexsort((known_ids[c], exact, r))
                first = order[np.unique(r[order], return_index=True)[1]]
                i, d, j = own[r[first]], exact[first], known_ids[c[first]]
                better = (d < self.best[i]) | ((d == self.best[i]) & (j < self.ref[i]))
                self.best[i[better]], self.ref[i[better]] = d[better], j[better]


def nearest_reference(queries: DataFrame, refs: DataFrame, folder: str, id_col: str = "id", vec_col: str = "embedding", counter: Accumulator | None = None) -> DataFrame:
    """(id, ref_id, distance): the exact nearest reference by L2; ties to the least id.

    References are written once to ``folder``, which all executors share, in cells around the nearest of
    ``PIVOTS`` of them. Queries are ordered by their own nearest pivot, so that those of a task lie
    together. By the triangle inequality no reference of a cell is nearer than the distance to its pivot less
    the cell's radius, or than the cell's hole; a task reads the cells by this bound, those
    that may be nearest first, compares a block with the queries that it may serve as matrices, and leaves
    out the cells that can't be nearer for any. ``counter`` adds up the cells read. How
    many are left out depends on the data: most if it has clusters, few if vectors are spread evenly
    in many dimensions. Empty if there is no reference.
    """
    vectors = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    drawn = vectors(refs).where("v is not null").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in drawn], dtype=float)
    if not len(pivots):
        return vectors(queries).limit(0).select("id", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("double").alias("distance"))

    def to_cells(batches):
        for batch in batches:
            if len(batch):
                distances = _distances(batch.column("v").flatten().to_numpy().reshape(len(batch), -1), pivots)
                cell = distances.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distances[np.arange(len(cell)), cell])], names=["id", "v", "cell", "far"])

    in_cells = lambda df: vectors(df).where("v is not null").mapInArrow(to_cells, "id long, v array<double>, cell int, far double")
    in_cells(refs).sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)
    spans = refs.sparkSession.read.parquet(folder).groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most")).collect()  # PIVOTS at most
    cells = np.array([r["cell"] for r in spans])
    least, most = (np.array([r[c] for r in spans]) for c in ("least", "most"))

    def blocks(cell: int):
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in ds.dataset(f"{path}/cell={cell}", filesystem=store, format="parquet").to_batches(batch_size=4096, columns=["id", "v"]):
            step = max(1, BLOCK_BYTES // (8 * max(1, pivots.shape[1])))
            for part in (batch.slice(k, step) for k in range(0, len(batch), step)):
                yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(len(part), -1)

    def answer(held: list[pa.RecordBatch]):
        own = pa.Table.from_batches(held).combine_chunks()
        state = _Nearest(own.column("id").to_pylist(), own.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), -1))
        to_pivots = _distances(state.asked, pivots[cells])
        bound = np.maximum(0, np.maximum(to_pivots - most, least - to_pivots)) * (1 - 1e-9) - 1e-12
        for k in np.lexsort((to_pivots.min(0), bound.min(0))):
            some = np.flatnonzero(bound[:, k] <= state.best)
            if len(some):
                for ids, known in blocks(cells[k]):
                    state.meet(ids, known, some)
                if counter is not None:
                    counter.add(1)
        there = np.isfinite(state.best)
        return pa.RecordBatch.from_arrays([own.column("id").combine_chunks().filter(pa.array(there)), pa.array(state.ref[there]), pa.array(state.best[there])], names=["id", "ref_id", "distance"])

    def run(batches):
        held, n, cell = [], 0, None
        for batch in batches:
            own = batch.column("cell").to_numpy()
            for s, e in zip([0, *np.flatnonzero(np.diff(own)) + 1], [*np.flatnonzero(np.diff(own)) + 1, len(own)], strict=True):
                if n and (n >= QUERIES_AT_ONCE or own[s] != cell and n >= QUERIES_AT_ONCE // 8):
                    yield answer(held)
                    held, n = [], 0
                held.append(batch.slice(s, e - s))
                n, cell = n + e - s, own[s] if e > s else cell
        if n:
            yield answer(held)

    asked = in_cells(queries).repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far")
    return asked.mapInArrow(run, "id long, ref_id long, distance double")


def scores_with_heatmaps(scores: DataFrame, maps: DataFrame) -> DataFrame:
    """Ranked images with their map averaged over levels, by flat name."""
    mean = maps.groupBy("name", "y", "x").agg(F.avg("v").alias("v"))
    return scores.join(mean, "name")


def size_audit(maps: DataFrame, dims: DataFrame, actual: DataFrame) -> DataFrame:
    """Images of which map shape, recorded size and own size don't agree; unknown ones are skipped."""
    joined = maps.select("image_key", F.col("h").alias("map_h"), F.col("w").alias("map_w")).join(dims, "image_key").join(actual.select("image_key", F.col("h").alias("own_h"), F.col("w").alias("own_w")), "image_key")
    wrong = (F.col("map_h") != F.col("height")) | (F.col("map_w") != F.col("width")) | (F.col("map_h") != F.col("own_h")) | (F.col("map_w") != F.col("own_w"))
    return joined.where(wrong)


def frame_pairs(frames: DataFrame, kind: str, key_col: str = "frame_key") -> tuple[DataFrame, DataFrame]:
    """(key, diff, target_key) of frames of one sequence, and the targets that are missing.

    ``kind`` is "scale" (the three zooms of a frame) or "rotation" (eight directions).
    """
    targets = {"scale": scale_targets, "rotation": rotation_targets}[kind]
    own = frames.select(F.col(key_col).alias("key"), sequence_of(F.col(key_col)).alias("seq"), frame_of(F.col(key_col)).alias("frame"))
    wanted = own.select("key", "seq", F.inline(targets(F.col("frame"))))
    known = own.select("seq", F.col("frame").alias("target"), F.col("key").alias("target_key"))
    joined = wanted.join(known, ["seq", "target"], "left")
    return joined.where("target_key is not null").select("key", "diff", "target_key"), joined.where("target_key is null").select("key", "diff", "target")


def random_partner(images: DataFrame, seed: int, key_col: str = "image_key") -> DataFrame:
    """(key, partner): each key with another one, chosen by a hash of key and seed; the key may be a struct.

    Keys are numbered within hash buckets and the buckets' sizes are added up, so no task
    sees all of them; the partner is an equi-join on that number. Empty for one key.
    """
    buckets = 256
    text = F.col(key_col).cast("string")
    rows = images.select(key_col).distinct().withColumn("b", F.pmod(hashed_number(text), F.lit(buckets)))
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = sizes.agg(F.sum("n").alias("total"))
    own = Window.partitionBy("b").orderBy(key_col)
    numbered = rows.withColumn("i", F.row_number().over(own) - 1).join(F.broadcast(starts), "b").select(key_col, (F.col("i") + F.col("start")).alias("i"))
    step = 1 + F.pmod(hashed_number(F.concat_ws("|", text, F.lit(str(seed)))), F.greatest(F.col("total") - 1, F.lit(1)))
    asked = numbered.crossJoin(F.broadcast(total)).where("total > 1").select(key_col, F.pmod(F.col("i") + step, F.col("total")).alias("i"))
    return asked.join(numbered.select(F.col(key_col).alias("partner"), "i"), "i").select(key_col, "partner")

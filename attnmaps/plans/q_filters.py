"""Queries of sources, filters, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attnmaps.functions import clicks as C
from attnmaps.functions import paths as P
from attnmaps.operators import filters, joins, sinks
from attnmaps.plans import agreement_sql, jobs
from attnmaps.plans.base import CLEAN, MAX_CLICKS, MIN_CLICKS, MIN_SUBJECTS, SIDE, SUB, query
from attnmaps.sources import readers
from attnmaps.sources.shared import scratch

TEST = jobs.Prepare(image_shape=(SIDE, SIDE), blur_size=5, min_clicks=MIN_CLICKS, max_clicks=MAX_CLICKS, min_subjects=MIN_SUBJECTS)
BOTH = ("submissions", "clicks")


def keyed(t):
    """Submissions with clicks and image key, before any filter."""
    return t.subs.withColumn("image_key", P.image_key(F.col("image_path")))


def shown(df, *more):
    return df.select("sub_id", "image_key", F.size("clicks").cast("long").alias("n"), *more)


# --- sources ---------------------------------------------------------------------------


@query("SELECT ord, image_path, user_id, n, sx, sy FROM s JOIN (SELECT sub_id, count(*) AS n, sum(x * (pos + 1)) AS sx, sum(y * (pos + 1)) AS sy FROM clicks GROUP BY sub_id) USING (sub_id)", *BOTH, extra="s AS (SELECT * FROM submissions)")
def src1_submissions_csv(t):
    path = scratch(t.spark, "csv")
    sinks.write_sampled(t.subs.where(F.size("clicks") > 0), path)
    return digest(readers.read_submissions_csv(t.spark, path)).select("ord", "image_path", "user_id", "n", "sx", "sy")


@query("""SELECT part, image_path, user_id, n, sx, sy FROM (
  SELECT *, row_number() OVER (PARTITION BY image_key, user_id, image_path ORDER BY part, ord DESC) AS r FROM (SELECT sub.*, CASE WHEN ord % 40 = 0 THEN 0 WHEN ord % 4 = 1 THEN 1 ELSE 2 END AS part FROM sub WHERE n > 0))
  JOIN (SELECT sub_id, sum(x * (pos + 1)) AS sx, sum(y * (pos + 1)) AS sy FROM clicks GROUP BY sub_id) USING (sub_id) WHERE r = 1""", *BOTH, extra=SUB)
def src1_file_order(t):
    """The first submission of a user and image in files without an index: a small file, a large one, and the largest."""
    path = scratch(t.spark, "files")
    part = F.when(F.col("ord") % 40 == 0, 0).when(F.col("ord") % 4 == 1, 1).otherwise(2)
    rows = t.subs.where(F.size("clicks") > 0).withColumn("part", part)
    text = F.concat(F.lit("["), F.array_join(F.transform("clicks", lambda c: F.concat(F.lit("("), c["x"].cast("string"), F.lit(", "), c["y"].cast("string"), F.lit(")"))), ", "), F.lit("]"))
    # each part as many files as its rows fill tasks; tasks number them in file order
    order = ["part", F.desc("ord")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "image_path", text.alias("clicks"), "user_id")
    dealt.write.partitionBy("part").csv(path, header=True, quote='"', escape='"')
    read = readers.read_submissions_csv(t.spark, path).withColumn("image_key", P.image_key(F.col("image_path")))
    first = filters.dedupe_first(read).withColumn("part", F.regexp_extract("ord.file", "part=([0-9]+)/", 1).cast("int"))
    return digest(first).select("part", "image_path", "user_id", "n", "sx", "sy")


def digest(df, *keys):
    """Size of the clicks and sums of coordinates weighted by place."""
    total = lambda c: F.aggregate(F.zip_with(f"clicks.{c}", F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("clicks"))), lambda v, i: F.coalesce(v, F.lit(0)) * i), F.lit(0), lambda a, v: a + v).cast("long")
    return df.withColumns({"n": F.size("clicks").cast("long"), "sx": total("x"), "sy": total("y")})


@query("SELECT sub_id AS ord, image_path, user_id, is_mobile, coalesce(n, 0) AS n FROM submissions LEFT JOIN (SELECT sub_id, count(*) AS n FROM clicks GROUP BY sub_id) USING (sub_id)", *BOTH)
def src2_submissions_archive(t):
    path = scratch(t.spark, "archive")
    flags = F.when(F.col("is_mobile"), F.array(F.lit(True), F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    t.subs.select("image_path", F.col("clicks.x").alias("clickmap_x"), F.concat("clicks.y", F.array(F.lit(1))).alias("clickmap_y"), "user_id", "user_catch_trial", flags.alias("is_mobile"), "ord").write.parquet(path)
    return readers.read_submissions_archive(t.spark, path).select("ord", "image_path", "user_id", "is_mobile", F.size("clicks").cast("long").alias("n"))


@query("SELECT sub_id, image_path, user_id FROM submissions WHERE sub_id % 3 = 0 UNION ALL SELECT sub_id, image_path, user_id FROM submissions WHERE sub_id % 2 = 0", "submissions")
def src3_union_splits(t):
    rows = t.submissions.select("sub_id", "image_path", "user_id")
    return readers.union_splits(rows.where("sub_id % 3 = 0"), rows.where("sub_id % 2 = 0"))


@query("SELECT DISTINCT image_path, replace(image_path, 'dump/imgs/', '') AS image_key FROM submissions WHERE contains(image_path, 'c3')", "submissions")
def src4_image_paths(t):
    return readers.image_paths(t.submissions, "c3", "dump/imgs/")


def _write_images(t, path):
    """Image headers as files: PNG, or JPEG with a long comment for every third image; sizes by number, some files cut short."""
    rows = t.images.withColumns({"width": F.col("image_id") * 7 % 500 + 1, "height": F.col("image_id") * 11 % 300 + 1})

    def run(batches):
        import struct

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                w, h = r["width"], r["height"]
                data = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
                if r["image_id"] % 3 == 0:
                    data = b"\xff\xd8\xff\xfe" + struct.pack(">H", 40_002) + b" " * 40_000 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3)
                store.create_dir(f"{root}/{r['image_key'].rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{root}/{r['image_key']}") as out:
                    out.write(data[: 15 if r["image_id"] % 5 == 0 else len(data)])
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query("""SELECT image_key, CAST(image_id * 7 % 500 + 1 AS INT) AS width, CAST(image_id * 11 % 300 + 1 AS INT) AS height FROM images
  WHERE image_id % 5 <> 0 AND contains(image_key, 'c3/')""", "images")
def src4_image_dimensions(t):
    """Sizes from the headers of files; those cut short are left out, and so are images nobody asked for."""
    path = scratch(t.spark, "images")
    _write_images(t, path)
    return readers.image_dimensions(t.spark, t.submissions, "c3/", "dump/imgs/", path)


@query("SELECT frame_key AS image_key, scale, scale * 2 AS focal, image_id::DOUBLE AS shift FROM frames", "frames")
def src5_camera_json(t):
    path = scratch(t.spark, "cameras")
    ident = lambda f, s: F.array(F.array(f, F.lit(0.0), F.lit(0.0), s), F.array(F.lit(0.0), f, F.lit(0.0), s), F.array(F.lit(0.0), F.lit(0.0), f, s))
    rows = t.frames.select("frame_key", "scale", ident(F.lit(1.0), F.col("image_id").cast("double")).alias("w2c"), ident(F.col("scale") * 2, F.lit(0.0)).alias("k"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("frame_key", c)))
    rows.groupBy(F.split_part("frame_key", F.lit("_"), F.lit(2)).alias("seq")).agg(as_map("scale").alias("scale"), as_map("w2c").alias("w2c"), as_map("k").alias("K")).write.partitionBy("seq").json(path)
    read = readers.read_camera_json(t.spark, path)
    return read.select("image_key", "scale", F.col("k")[0][0].alias("focal"), F.col("w2c")[0][3].alias("shift"))


@query("""SELECT label || '_' || vec_id || '.png' AS name, label, vec_id AS click_count, CAST(list_sum(list_transform(embedding, lambda v: CAST(trunc(abs(CAST(v AS DOUBLE) * 10)) AS INT) % 4)) AS BIGINT) AS image_sum,
  CAST(list_sum(list_transform(embedding[1:16], lambda v: CAST(trunc(abs(CAST(v AS DOUBLE) * 10)) AS INT) % 4)) AS DOUBLE) AS heatmap_sum
  FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, embedding[1:48] AS embedding FROM embeddings)""")
def src6_packed_records(t):
    """Decodes records whose bytes are made of the first numbers of every vector, as an image holds them."""
    side = 4
    floats = lambda n: F.slice("embedding", 1, n)
    values = t.embeddings.select(F.col("vec_id").alias("ord"), F.col("label").cast("long").alias("label"), floats(48).alias("i"), floats(16).alias("m"))
    # hex of small whole numbers as little-endian floats: 0, 1, 2 and 3
    codes = {0: "00000000", 1: "0000803F", 2: "00000040", 3: "00004040"}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    pack = lambda c: F.unhex(F.array_join(F.transform(c, lambda v: F.element_at(table, F.abs(v.cast("double") * 10).cast("int") % 4)), ""))
    packed = values.select("ord", "label", F.col("ord").alias("click_count"), pack("i").alias("image"), pack("m").alias("heatmap"))
    out = readers.decode_packed_records(packed, side=side)
    return out.select("name", "label", "click_count", F.aggregate("image", F.lit(0), lambda a, v: a + v).cast("long").alias("image_sum"), F.aggregate("heatmap", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("heatmap_sum"))


@query("SELECT split_part(image_key, '.', 1) AS mask_key, 32 AS h, 32 AS w FROM images", "images")
def src7_masks(t):
    path = scratch(t.spark, "masks")
    t.images.select(F.concat(F.lit("/masks/"), "image_key").alias("image_path"), F.array(P.category(F.col("image_key"))).alias("category"), F.lit(32).alias("h"), F.lit(32).alias("w"), F.array(F.lit(1).cast("tinyint")).alias("data")).write.parquet(path)
    return readers.read_masks(t.spark, path).select("mask_key", "h", "w")


# --- filters ---------------------------------------------------------------------------


@query("SELECT sub_id, user_catch_trial FROM submissions WHERE user_catch_trial >= 0.95", "submissions")
def flt1_filter_catch(t):
    return filters.filter_catch(t.submissions).select("sub_id", "user_catch_trial")


@query("SELECT sub_id, is_mobile AND sub_id % 3 <> 0 AS is_mobile FROM submissions", "submissions")
def flt2_normalise_mobile(t):
    none, flag = F.array().cast("array<boolean>"), F.col("is_mobile")
    return t.submissions.select("sub_id", C.normalise_mobile(F.when(F.col("sub_id") % 3 == 0, none).otherwise(F.array(flag, ~flag))).alias("is_mobile"))


@query("SELECT sub_id, user_id FROM submissions WHERE user_catch_trial >= 0.95 AND NOT is_mobile", "submissions")
def flt3_filter_mobile(t):
    return filters.filter_mobile(filters.filter_catch(t.submissions)).select("sub_id", "user_id")


@query("SELECT sub_id, image_key, n FROM sub WHERE contains(image_key, 'c1/')", *BOTH, extra=SUB)
def flt4_include_paths(t):
    return shown(filters.include_paths(keyed(t), "c1/"))


@query("SELECT sub_id, image_key, n FROM sub WHERE NOT contains(image_key, 'c1/') AND NOT contains(image_key, '_0001')", *BOTH, extra=SUB)
def flt5_exclude_paths(t):
    return shown(filters.exclude_paths(keyed(t), ["c1/", "_0001"]))


LISTED = "SELECT sub_id, image_key, n FROM sub WHERE EXISTS (SELECT 1 FROM listing WHERE contains(path, image_key))"


@query(LISTED, *BOTH, "listing", extra=SUB)
def flt6_restrict_to_listing(t):
    return shown(filters.restrict_to_listing(keyed(t), t.listing))


@query(LISTED, *BOTH, "listing", extra=SUB)
def flt6_restrict_to_listing_theta(t):
    return shown(filters.restrict_to_listing(keyed(t), t.listing, theta=True))


@query("""SELECT sub_id, split_part(image_key, '/', 1) || '/' || split_part(image_key, '/', 1) || '_' || split_part(image_key, '/', 2) AS image_key, n
  FROM sub WHERE EXISTS (SELECT 1 FROM listing WHERE contains(path, image_key))""", *BOTH, "listing", extra=SUB)
def flt7_constancy_rename(t):
    renamed = t.listing.select(F.regexp_replace("path", "/(c[0-9]+)/", "/$1/$1_").alias("path"))
    return shown(filters.constancy_rename(keyed(t), renamed))


@query("SELECT sub_id, image_key, n FROM sub WHERE split_part(image_key, '/', 1) IN (SELECT category FROM classes)", *BOTH, "classes", extra=SUB)
def flt8_filter_classes(t):
    return shown(filters.filter_classes(keyed(t), t.classes))


@query("SELECT sub_id, image_key, n FROM sub WHERE n > 1", *BOTH, extra=SUB)
def flt9_drop_trivial(t):
    return shown(filters.drop_trivial(keyed(t)))


@query("SELECT sub_id, image_key, least(n, 4) AS n FROM sub WHERE n > 2", *BOTH, extra=SUB)
def flt10_limit_clicks_trim(t):
    return shown(filters.limit_clicks(keyed(t), 2, 4, "trim"))


@query("SELECT sub_id, image_key, n FROM sub WHERE n > 2 AND n <= 4", *BOTH, extra=SUB)
def flt11_limit_clicks_exclude(t):
    return shown(filters.limit_clicks(keyed(t), 2, 4, "exclude"))


@query("SELECT sub_id, image_key, n FROM (SELECT *, count(*) OVER (PARTITION BY image_key) AS k FROM sub) WHERE k >= 155", *BOTH, extra=SUB)
def flt12_min_subjects(t):
    return shown(filters.min_subjects(keyed(t), 155))


@query("SELECT image_key, sub_id FROM ra GROUP BY ALL HAVING sum(n) >= 3", *BOTH, extra=CLEAN)
def flt13_valid_maps(t):
    from attnmaps.operators import raster

    return raster.valid_maps(raster.rasterise(jobs.clean(t.subs, TEST), SIDE, SIDE), 3)


@query("SELECT image_key, count(*) AS maps FROM (SELECT image_key, sub_id FROM ra GROUP BY ALL HAVING sum(n) >= 5) GROUP BY image_key HAVING count(*) >= 8", *BOTH, extra=CLEAN)
def flt14_recheck_subjects(t):
    from attnmaps.operators import raster

    rows = raster.keep_valid(raster.rasterise(jobs.clean(t.subs, TEST), SIDE, SIDE), 5, 8)
    return rows.groupBy("image_key").agg(F.countDistinct("sub_id").alias("maps"))


@query("SELECT sub_id, image_key, n FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY ord) AS r FROM sub) WHERE r <= 7", *BOTH, extra=SUB)
def flt15_max_subjects(t):
    return shown(filters.max_subjects(keyed(t), 7))


@query(f"""SELECT mask_key, round(iou, 9) AS iou FROM (
  SELECT mask_key, count(*) FILTER (a AND b) / count(*) FILTER (a OR b) AS iou
  FROM (SELECT m.mask_key, coalesce(h.v > bar, false) AS a, g.x BETWEEN x0 AND x1 AND g.y BETWEEN y0 AND y1 AS b
    FROM masks m JOIN (SELECT image_key, max(v) * 0.5 AS bar FROM mm GROUP BY image_key) k ON split_part(k.image_key, '.', 1) = m.mask_key
    CROSS JOIN (SELECT x, y FROM range({SIDE}) r(x), range({SIDE}) s(y)) g
    LEFT JOIN mm h ON h.image_key = k.image_key AND h.x = g.x AND h.y = g.y)
  GROUP BY mask_key) WHERE iou < 0.02""", *BOTH, "masks", extra=CLEAN)
def flt16_filter_foreground(t):
    maps = jobs.mean_maps(jobs.clean(t.subs, TEST), TEST, SIDE, SIDE)
    rows = maps.select(P.without_extension(F.col("image_key")).alias("mask_key"), F.lit(0).alias("level"), "y", "x", "v", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"))
    masks = t.masks.select("mask_key", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("mask_key", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return filters.filter_foreground(rows, masks, 0.02).select("mask_key", F.round("iou", 9).alias("iou"))


@query("SELECT sub_id, user_id, label FROM submissions JOIN players USING (user_id)", "submissions", "players")
def flt17_filter_players(t):
    return filters.filter_players(t.submissions, t.players).select("sub_id", "user_id", "label")


@query("SELECT sub_id, n FROM sub WHERE n > 0 OR sub_id % 2 = 0", *BOTH, extra=SUB)
def flt18_drop_empty_coords(t):
    none = F.array().cast("array<int>")
    rows = t.subs.withColumns({"clickmap_x": F.col("clicks.x"), "clickmap_y": F.when(F.col("sub_id") % 2 == 0, F.array(F.lit(1))).when(F.size("clicks") > 0, F.col("clicks.y")).otherwise(none)})
    return filters.drop_empty_coords(rows).select("sub_id", F.size("clicks").cast("long").alias("n"))


@query("SELECT split_part(image_key, '/', 1) AS category, split_part(image_key, '/', 2) AS file FROM images WHERE image_id % 6 = 5", "images", "listing")
def flt19_missing_files(t):
    split = lambda c: (P.category(F.col(c)).alias("category"), F.element_at(F.split(c, "/"), -1).alias("file"))
    return filters.missing_files(t.images.select(*split("image_key")), t.listing.select(P.image_key(F.col("path")).alias("k")).select(*split("k")))


@query("SELECT image_key, count(*) AS n FROM sub GROUP BY image_key HAVING count(*) < 155", *BOTH, extra=SUB)
def flt20_under_annotated(t):
    return filters.under_annotated(keyed(t), 155)


# --- projections -----------------------------------------------------------------------


@query("SELECT sub_id, regexp_extract(image_path, '[^/]+/[^/]+$') AS image_key FROM submissions", "submissions")
def prj1_image_key(t):
    return t.submissions.select("sub_id", P.image_key(F.col("image_path")).alias("image_key"))


@query("SELECT sub_id, count(*) AS n, sum(x * (pos + 1)) AS sx, sum(y * (pos + 1)) AS sy FROM clicks GROUP BY sub_id", "clicks")
def prj2_parse_clicks(t):
    pair = lambda sep: lambda c: F.concat(F.lit("("), c["x"].cast("string"), F.lit(sep), c["y"].cast("string"), F.lit(")"))
    first = F.concat(F.lit("["), F.array_join(F.transform("clicks", pair(", ")), ", "), F.lit("]"))
    second = F.concat(F.lit('{"'), F.array_join(F.transform("clicks", pair(",")), '","'), F.lit('"}'))
    rows = t.subs.where(F.size("clicks") > 0).select("sub_id", C.parse_clicks(F.when(F.col("sub_id") % 2 == 0, first).otherwise(second)).alias("clicks"))
    return digest(rows).select("sub_id", "n", "sx", "sy")


@query("SELECT sub_id, greatest(n - 1, 0) AS n FROM sub", *BOTH, extra=SUB)
def prj3_zip_clicks(t):
    shorter = F.slice(F.col("clicks.y"), F.lit(1), F.greatest(F.lit(0), F.size("clicks") - 1))
    return t.subs.select("sub_id", F.size(C.zip_clicks(F.col("clicks.x"), shorter)).cast("long").alias("n"))


@query("SELECT image_key, split_part(image_key, '/', 1) AS category FROM images", "images")
def prj4_category(t):
    return t.images.select("image_key", P.category(F.col("image_key")).alias("category"))


@query("SELECT image_key, replace(image_key, '/', '_') AS flat, image_key AS back FROM images", "images")
def prj5_flat_name(t):
    flat = P.flat_name(F.col("image_key"))
    return t.images.select("image_key", flat.alias("flat"), P.unflat_name(flat).alias("back"))


@query("""SELECT event_id, split_part(file_pointer, '/', 3) AS synset, CAST(substr(split_part(file_pointer, '/', 3), 2) AS BIGINT) AS number,
  CAST(substr(split_part(file_pointer, '/', 3), 2) AS BIGINT) < 2666196 AS is_animal FROM pointers""", "pointers")
def prj6_synset(t):
    p = F.col("file_pointer")
    return t.pointers.select("event_id", P.synset(p).alias("synset"), P.synset_number(p).alias("number"), P.is_animal(p).alias("is_animal"))


@query("SELECT frame_key, CAST(image_id % 24 AS INT) AS frame, CAST(image_id % 24 % 3 AS INT) AS zoom, 'seq_' || (image_id // 24) AS seq FROM frames", "frames")
def prj7_frame_of(t):
    k = F.col("frame_key")
    return t.frames.select("frame_key", P.frame_of(k).alias("frame"), P.zoom_of(k).alias("zoom"), P.sequence_of(k).alias("seq"))


@query("SELECT frame_key, CAST(f - f % 3 + i AS INT) AS target, CAST(i - f % 3 AS INT) AS diff FROM (SELECT frame_key, image_id % 24 AS f FROM frames), range(3) r(i)", "frames")
def prj8_scale_targets(t):
    return t.frames.select("frame_key", F.inline(P.scale_targets(P.frame_of(F.col("frame_key")))))


@query("SELECT frame_key, CAST((f + 3 * i + 24) % 24 AS INT) AS target, CAST(i AS INT) AS diff FROM (SELECT frame_key, image_id % 24 AS f FROM frames), range(-3, 5) r(i)", "frames")
def prj9_rotation_targets(t):
    return t.frames.select("frame_key", F.inline(P.rotation_targets(P.frame_of(F.col("frame_key")))))


@query("""SELECT sub_id, array_to_string(list_sort(list(DISTINCT CAST(floor(x / 4) AS INT))), ',') AS cols,
  array_to_string(list_sort(list(DISTINCT CAST(floor(y / 4) AS INT))), ',') AS rows FROM clicks GROUP BY sub_id""", "clicks")
def prj10_bin_features(t):
    sets = C.bin_features(F.col("clicks"), 4)
    text = lambda c: F.array_join(sets[c].cast("array<string>"), ",").alias(c)
    return t.subs.where(F.size("clicks") > 0).select("sub_id", text("cols"), text("rows"))


@query("""SELECT image_key, CASE WHEN width IS NULL THEN 21 ELSE least(CASE WHEN r % 2 = 0 THEN r + 1 ELSE r END, 51) END AS size
  FROM (SELECT i.image_key, width, CAST(round_even(21.0 * least(width, height) / 24, 0) AS INT) AS r FROM images i LEFT JOIN dims USING (image_key))""", "images", "dims")
def prj11_kernel_size(t):
    rows = t.images.join(t.dims, "image_key", "left")
    return rows.select("image_key", C.kernel_size(21, "width", "height", (24, 24)).alias("size"))


# --- joins -----------------------------------------------------------------------------


@query("""SELECT sub_id, user_id, coalesce(m, false) AS is_mobile, coalesce(c, false) AS conflicting
  FROM submissions LEFT JOIN (SELECT user_id, max(is_mobile) AS m, count(DISTINCT is_mobile) > 1 AS c FROM devices GROUP BY user_id) USING (user_id)""", "submissions", "devices")
def joi1_attach_device(t):
    joined, conflicts = joins.attach_device(t.submissions, t.devices)
    flagged = joined.join(conflicts.withColumn("conflicting", F.lit(True)), "user_id", "left")
    return flagged.select("sub_id", "user_id", "is_mobile", F.coalesce("conflicting", F.lit(False)).alias("conflicting"))


@query("SELECT image_key, coalesce(height, 32) AS h, coalesce(width, 32) AS w FROM images LEFT JOIN dims USING (image_key)", "images", "dims")
def joi2_attach_dimensions(t):
    return joins.attach_dimensions(t.images, t.dims, (32, 32)).select("image_key", "h", "w")


@query("""SELECT id, ref_id, round(d, 6) AS distance FROM (
  SELECT q.vec_id AS id, r.vec_id AS ref_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), r.vec_id) AS rn
  FROM embeddings q, embeddings r WHERE q.vec_id % 5 <> 0 AND r.vec_id % 5 = 0) WHERE rn = 1""")
def joi3_nearest_reference(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    found = joins.nearest_reference(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), scratch(t.spark, "references"))
    return found.select("id", "ref_id", F.round("distance", 6).alias("distance"))


@query("SELECT replace(image_key, '/', '_') AS name, y, x, round(v, 9) AS v, s AS score FROM mm JOIN (SELECT image_key, count(*) AS s FROM sub GROUP BY image_key ORDER BY s DESC, image_key LIMIT 10) USING (image_key)", *BOTH, extra=CLEAN)
def joi4_scores_with_heatmaps(t):
    maps = jobs.mean_maps(jobs.clean(t.subs, TEST), TEST, SIDE, SIDE).withColumn("name", P.flat_name(F.col("image_key")))
    ranked = keyed(t).groupBy("image_key").agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "image_key").limit(10)
    out = joins.scores_with_heatmaps(ranked.select(P.flat_name(F.col("image_key")).alias("name"), "score"), maps)
    return out.select("name", "y", "x", F.round("v", 9).alias("v"), "score")


@query("SELECT image_key, width, height, 32 AS map_h, 32 AS map_w FROM dims JOIN images USING (image_key) WHERE height <> 32 OR width <> 32", "images", "dims")
def joi5_size_audit(t):
    shape = t.images.select("image_key", F.lit(32).alias("h"), F.lit(32).alias("w"))
    own = joins.attach_dimensions(t.images, t.dims, (32, 32)).select("image_key", "h", "w")
    return joins.size_audit(shape, t.dims, own).select("image_key", "width", "height", "map_h", "map_w")


PAIRS = """SELECT a.frame_key AS key, CAST(d AS INT) AS diff, b.frame_key AS target_key
  FROM (SELECT frame_key, image_id // 24 AS s, image_id % 24 AS f FROM frames) a, {range} JOIN (SELECT frame_key, image_id // 24 AS s, image_id % 24 AS f FROM frames) b
  ON a.s = b.s AND b.f = {target}"""


@query(PAIRS.format(range="(SELECT d FROM range(-2, 3) r(d)) x", target="a.f + d AND b.f // 3 = a.f // 3"), "frames")
def joi6_frame_pairs_scale(t):
    return joins.frame_pairs(t.frames, "scale")[0]


@query(PAIRS.format(range="(SELECT d FROM range(-3, 5) r(d)) x", target="(a.f + 3 * d + 24) % 24"), "frames")
def joi6_frame_pairs_rotation(t):
    return joins.frame_pairs(t.frames, "rotation")[0]


@query("SELECT image_key, p_image_key AS partner FROM pt", "images", extra=agreement_sql.partners("images", "image_key", "image_key", 1))
def joi7_random_partner(t):
    return joins.random_partner(t.images, seed=1)

"""Hand-made cases, edge cases, stability and plans."""

import pytest
from pyspark.sql import functions as F

from attnmaps.functions import clicks as C
from attnmaps.functions.paths import image_key
from attnmaps.operators import agreement, filters, joins, raster, stats
from attnmaps.plans import jobs
from attnmaps.sources.fixtures import Inputs

SCHEMA = "sub_id long, ord long, image_path string, image_key string, user_id long, ts string, user_catch_trial double, is_mobile boolean, clicks array<struct<x:int,y:int>>"


def sub(i, n=2, image="c0/a.png", user=1, ts=None, clicks=None):
    return (i, i, f"dump/{image}", image, user, ts, 1.0, False, clicks if clicks is not None else [(k, k) for k in range(n)])


@pytest.fixture
def subs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return sorted(r["sub_id"] for r in df.collect())


def test_mobile_forms(spark):
    df = spark.createDataFrame([([True],), ([],), ([False, True],), (None,)], "f array<boolean>")
    assert [r[0] for r in df.select(C.normalise_mobile(F.col("f"))).collect()] == [True, False, False, False]


def test_unequal_coordinates_and_click_texts(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "x array<int>, y array<int>")
    assert df.select(F.size(C.zip_clicks(F.col("x"), F.col("y")))).first()[0] == 2
    text = spark.createDataFrame([("[(1, 2), (3, -4)]",), ('{"(1,2)","(3,-4)"}',), ("[]",)], "t string")
    assert [[(c.x, c.y) for c in r[0]] for r in text.select(C.parse_clicks(F.col("t"))).collect()] == [[(1, 2), (3, -4)]] * 2 + [[]]


def test_a_short_first_submission_hides_a_later_one(subs):
    rows = subs(sub(1, 1, ts="2024-01-01"), sub(2, 9, ts="2024-01-02"))
    assert ids(filters.drop_trivial(filters.dedupe_first(rows))) == []


def test_dedupe_ties_nulls_and_missing_user(subs):
    rows = subs(sub(2, ts="2024"), sub(1, ts="2024"), sub(3, user=None), sub(4, user=None), sub(5, image="c1/b.png"))
    assert ids(filters.dedupe_first(rows)) == [1, 3, 5]
    with pytest.warns(UserWarning):
        assert filters.dedupe_first(rows.drop("user_id")).count() == 5


def test_click_limits(subs):
    rows = subs(*[sub(n, n) for n in (1, 2, 6, 7)])
    trimmed = filters.limit_clicks(rows, 2, 6, "trim")
    assert sorted((r.sub_id, len(r.clicks)) for r in trimmed.collect()) == [(6, 6), (7, 6)]
    assert ids(filters.limit_clicks(rows, 2, 6, "exclude")) == [6]
    with pytest.raises(ValueError):
        filters.limit_clicks(rows, 2, 6, "other")


def test_out_of_bounds_and_saturation(subs):
    rows = subs(sub(1, clicks=[(-1, 0), (4, 0), (0, 4)]), sub(2, clicks=[(1, 2)] * 300))
    assert [(r.sub_id, r.y, r.x, r.n) for r in raster.rasterise(rows, 4, 4).collect()] == [(2, 2, 1, 255)]


@pytest.mark.parametrize(("w", "h", "blur", "shape", "size"), [(None, None, 20, 256, 21), (2560, 2560, 21, 256, 51), (128, 300, 21, 256, 11)])
def test_kernel_sizes(spark, w, h, blur, shape, size):
    df = spark.createDataFrame([(w, h)], "w int, h int")
    assert df.select(C.kernel_size(blur, "w", "h", (shape, shape))).first()[0] == size


def test_empty_tables(spark, subs):
    none = subs(sub(1)).limit(0)
    assert jobs.mean_maps(jobs.clean(none, jobs.Prepare()), jobs.Prepare(), 4, 4).count() == 0
    assert stats.medians_all(none).first()["median"] is None
    assert joins.random_partner(none, 1).count() == 0


def test_partner_is_never_self_and_covers_all(spark):
    images = spark.range(50).select(F.concat(F.lit("c/"), F.col("id").cast("string")).alias("image_key"))
    found = joins.random_partner(images, 3).collect()
    assert len({r.image_key for r in found}) == 50 and all(r.image_key != r.partner for r in found)
    assert {(r.image_key, r.partner) for r in joins.random_partner(images.repartition(7), 3).collect()} == {(r.image_key, r.partner) for r in found}


def test_scores_do_not_depend_on_partitioning(spark, subs):
    rows = subs(*[sub(i, 5, image=f"c0/{i % 3}.png", user=i, clicks=[((i * k) % 16, (i + k) % 16) for k in range(5)]) for i in range(30)])
    p = agreement.Agreement(h=16, w=16, kernel=3, iterations=3)
    both = [{(r.image_key, r.iteration): r.score for r in agreement.split_half(x, p).collect()} for x in (rows, rows.repartition(5).orderBy(F.desc("sub_id")))]
    assert both[0] == both[1]


def test_one_submission_has_no_score(subs):
    p = agreement.Agreement(h=8, w=8, kernel=3, iterations=2)
    scores = agreement.split_half(subs(sub(1, 3)), p)
    assert all(r.score is None for r in scores.collect())
    summary = stats.ceiling_floor_summary(stats.integrate_scores(scores.withColumn("level", F.lit(0)), ["image_key", "kind"]))
    assert summary.first()["mean_ceiling"] is None


def test_scale_pairs_of_a_frame_with_itself(subs, spark):
    rows = subs(*[sub(i, 4, image="s_00000.png", user=i) for i in range(6)], *[sub(10 + i, 4, image="s_00001.png", user=i) for i in range(6)])
    pairs, missing = joins.frame_pairs(rows.select(F.col("image_key").alias("frame_key")).distinct(), "scale")
    assert {(r.key, r.diff, r.target_key) for r in pairs.collect()} == {("s_00000.png", 0, "s_00000.png"), ("s_00000.png", 1, "s_00001.png"), ("s_00001.png", -1, "s_00000.png"), ("s_00001.png", 0, "s_00001.png")}
    assert missing.count() == 2
    scales = spark.createDataFrame([("s_00000.png", 1.0), ("s_00001.png", 2.0)], "key string, scale double")
    out = agreement.scale_constancy(rows, pairs, scales, agreement.Agreement(h=8, w=8, kernel=3, iterations=2))
    assert {r.kind for r in out.collect()} == {"ceiling", "floor"}


def test_participant_filter_debug(subs, spark):
    from attnmaps.operators import players

    verdicts = spark.createDataFrame([(1, 1), (2, 0)], "sub_id long, good int")
    rows = subs(sub(1), sub(2), sub(3))
    assert ids(players.participant_filter(rows, verdicts)) == [1]
    assert ids(players.participant_filter(rows, verdicts, debug=True)) == [2]


def test_no_step_gathers_the_rows_of_an_image(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    p = jobs.Prepare(image_shape=(32, 32))
    text = jobs.clean(t.subs, p)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "windowspecdefinition(image_key#" in text
    assert all("user_id" in line for line in text.splitlines() if "windowspecdefinition(image_key" in line or "Exchange hashpartitioning(image_key" in line)
    wide = jobs.mean_maps(jobs.clean(t.subs, jobs.Prepare(image_shape=(32, 32), min_subjects=5)), p, 32, 32)
    text = wide._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and text.count("partial_sum(n") == 1  # pixels are summed before they travel


def test_hot_image_is_many_tasks(spark):
    """An image with nearly all rows: its rows are spread by user, and pixels are combined in every task."""
    rows = [sub(k, 3, image="a/hot.png" if k % 10 else "a/b.png", user=k % 700, clicks=[(k % 5, 1), (2, k % 3), (7, 7)]) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cleaned = jobs.clean(df, jobs.Prepare(image_shape=(8, 8), min_subjects=2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in filters.dedupe_first(df).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    means = {(r.image_key, r.y, r.x): r.v for r in jobs.mean_maps(cleaned, jobs.Prepare(image_shape=(8, 8)), 8, 8).collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts is None, r.ts, r.ord)):
        first.setdefault((r.image_path, r.user_id), r)
    own = [r for (path, _), r in first.items() if path.endswith("hot.png")]
    for y, x in ((1, 0), (7, 7), (0, 2)):
        assert means["a/hot.png", y, x] == pytest.approx(sum((c.y, c.x) == (y, x) for r in own for c in r.clicks) / len(own))


def test_image_key(spark):
    df = spark.createDataFrame([("a/b/c.png",), ("c.png",), ("b/c.png",)], "p string")
    assert [r[0] for r in df.select(image_key(F.col("p"))).collect()] == ["b/c.png", "c.png", "b/c.png"]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from attnmaps.sources.readers import ARCHIVE, read_submissions_archive

    rows = [("d/c0/a.png", [1, 2], [3], 7, 0.99, [True], 0), ("d/c0/b.png", [1], [3], 8, 0.5, [], 1)]
    spark.createDataFrame(rows, ARCHIVE).write.parquet(f"{tmp_path}/archive")
    plan = filters.filter_catch(read_submissions_archive(spark, f"{tmp_path}/archive")).select("user_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_catch_trial,0.95)" in text and "ReadSchema: struct<user_id:bigint,user_catch_trial:double>" in text
    assert [r.user_id for r in plan.collect()] == [7]


def test_top_k_needs_no_full_sort(spark):
    scores = spark.range(100).select(F.col("id").cast("string").alias("image_key"), (F.col("id") % 7).cast("double").alias("score"))
    plan = stats.top_bottom(scores, 3)
    assert plan._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 2
    assert {(r.side, r.score) for r in plan.collect()} == {("top", 6.0), ("bottom", 0.0)}


def test_running_total_stops_with_ties(spark):
    counts = spark.createDataFrame([("a", 30), ("b", 20), ("c", 20), ("d", 5)], "image_key string, n long")
    assert sorted(r.image_key for r in stats.most_clicked_until(counts, 40).collect()) == ["a", "b", "c"]


def test_file_order_over_many_files(spark, tmp_path, monkeypatch):
    """A part is written by several tasks, as its rows ask for, and the first of each user stays the same."""
    from attnmaps.plans import q_filters
    from attnmaps.plans.base import QUERIES

    paths = [f"file://{tmp_path}/{k}" for k in range(2)]
    monkeypatch.setattr(q_filters, "scratch", lambda spark, name: paths.pop(0))
    run = lambda: sorted(map(tuple, QUERIES["src1_file_order"](spark, "/root/testdata/sf0.001").collect()))
    whole = run()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run() == whole != []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "1").glob("part=2/*.csv"))) > 1

"""Operators whose groups may hold most rows: scans by chunks, bitmaps of ids, greedy choice in rounds."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.functions.values import iou
from trajspark.operators import bitmaps, greedy, joins, keys, scans, trim
from trajspark.plans import checks
from trajspark.storage import Scratch


@pytest.fixture(autouse=True)
def chunks(monkeypatch):
    """Small tables are cut into chunks too, but where a test says otherwise."""
    monkeypatch.setattr(scans, "SMALL", 0)


@pytest.fixture(scope="module")
def hot(spark):
    """Nine tenths of the frames are one episode's; ids are not dense, some signals null, one episode has no id."""
    i = F.col("id")
    episode = F.when(i % 10 != 0, 7).when(i % 400 == 0, None).otherwise(i % 30).cast("long")
    value = F.when(i % 17 != 0, F.floor(F.pmod(F.xxhash64("id"), F.lit(60)) / 20) * 10.0)
    rows = spark.range(40_000, numPartitions=6).select(episode.alias("episode_index"), (i * 3 + i % 2).alias("index"), value.alias("value"))
    path = Scratch(spark).table(rows, "hot")
    return path


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plain_windows(rows):
    w = Window.partitionBy("episode_index").orderBy("index")
    before, n = F.lag("value").over(w), F.count("*").over(Window.partitionBy("episode_index"))
    v = F.coalesce(F.abs(F.col("value") - before), F.lit(0.0))
    return rows.withColumns({"rn": (F.row_number().over(w) - 1).cast("long"), "n": n, "velocity": v, "before": before})


def test_scans_equal_windows(spark, hot):
    w = Window.partitionBy("episode_index").orderBy("index")
    down = Window.partitionBy("episode_index").orderBy(F.col("index").desc())
    x = F.col("value")
    want = hot.select(
        "episode_index", "index", F.lag("value").over(w).alias("b"), (F.row_number().over(w) - 1).cast("long").alias("n"),
        F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"),
        F.last("value", True).over(w).alias("l"), F.last("value", True).over(down).alias("u"),
    )
    kinds = {"b": scans.before(x), "n": scans.number(), "s": scans.sum_before(x), "l": scans.latest(x), "u": scans.upcoming(x)}
    for width in (64, 4096, 1 << 40):
        assert rows_of(scans.scan(hot, "episode_index", "index", kinds, width), *want.columns) == rows_of(want, *want.columns)
    twice = [scans.scan(hot, "episode_index", ["index", "value"], kinds, 100), scans.scan(hot.limit(0), "episode_index", "index", kinds)]
    assert rows_of(twice[0], *want.columns) == rows_of(want, *want.columns) and twice[1].count() == 0


def test_small_tables_need_no_chunks(spark, hot, monkeypatch):
    x = F.col("value")
    kinds = {"b": scans.before(x), "n": scans.number(), "s": scans.sum_before(x), "l": scans.latest(x), "u": scans.upcoming(x)}
    cut = scans.scan(hot, "episode_index", "index", kinds)
    monkeypatch.setattr(scans, "SMALL", 64 << 20)
    whole = scans.scan(hot, "episode_index", "index", kinds)
    assert "Join" in cut._jdf.queryExecution().optimizedPlan().toString() and "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert cut.columns == whole.columns and rows_of(cut, *cut.columns) == rows_of(whole, *whole.columns)
    assert scans.estimated_bytes(hot) < scans.estimated_bytes(hot.crossJoin(hot.select("index").withColumnRenamed("index", "i")))


def test_no_task_has_the_hot_episode(spark, hot):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for df in (trim.velocity(hot, "value"), joins.nearest(hot.select("episode_index", F.col("index").alias("t")), hot.select("episode_index", F.col("index").alias("t")), "episode_index", "t", 1.0)):
            sizes = Counter(r["p"] for r in df.withColumn("p", F.spark_partition_id()).collect()).values()
            assert max(sizes) < 3 * sum(sizes) / 16
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_operators_on_a_hot_episode(spark, hot):
    plain = plain_windows(hot)
    assert rows_of(trim.velocity(hot, "value"), "episode_index", "index", "velocity") == rows_of(plain, "episode_index", "index", "velocity")
    moving = F.col("velocity") > 5
    ends = plain.groupBy("episode_index").agg(F.first("n").alias("n"), F.min(F.when(moving, F.col("rn"))).alias("f"), F.max(F.when(moving, F.col("rn"))).alias("l"))
    lead, trail = trim.balanced_shrink(F.coalesce("f", F.col("n")), F.coalesce(F.col("n") - 1 - F.col("l"), F.col("n")), F.col("n"), 50)
    want = ends.select("episode_index", "n", F.when(F.col("n") <= 50, 0).otherwise(lead).cast("long").alias("lead"), F.when(F.col("n") <= 50, 0).otherwise(trail).cast("long").alias("trail"))
    assert rows_of(trim.frozen_bounds(hot, "value", threshold=5), *want.columns) == rows_of(want, *want.columns)

    flag = F.coalesce(F.col("value") >= 10, F.lit(False))
    island = F.sum((~flag).cast("int")).over(Window.partitionBy("episode_index").orderBy("rn"))
    runs = plain.withColumn("i", island).where(flag).groupBy("episode_index", "i").agg(F.min("rn").alias("s"), F.count("*").alias("c")).where("c >= 9")
    assert rows_of(trim.first_run(plain, flag, 9), "episode_index", "run_start") == rows_of(runs.groupBy("episode_index").agg(F.min("s").alias("run_start")), "episode_index", "run_start")


def test_nearest_times_across_chunks(spark, hot):
    asked = hot.select("episode_index", "index", (F.col("index") + 0.4).alias("t"))
    times = hot.where("index % 7 = 0").select("episode_index", F.col("index").cast("double").alias("t"))
    got = {(r.episode_index, r.t): (r.gap, r.valid) for r in joins.nearest(asked, times, "episode_index", "t", 1.5, width=50.0).collect()}
    known = {}
    for r in times.collect():
        known.setdefault(r.episode_index, []).append(r.t)
    import bisect

    for r in asked.collect():
        own = sorted(known.get(r.episode_index, []))
        k = bisect.bisect(own, r.t)
        both = [abs(r.t - own[j]) for j in (k - 1, k) if 0 <= j < len(own)]
        gap, valid = got[r.episode_index, r.t]
        assert (gap is None and not both) or gap == pytest.approx(min(both))
        assert valid == bool(both and min(both) <= 1.5)
    assert len(got) == asked.count()


def test_null_episodes_raise(spark, hot):
    with pytest.raises(Exception, match="episode_index is null"):
        keys.reindex(hot).collect()
    rows = hot.where("episode_index IS NOT NULL")
    assert [r.new_index for r in keys.reindex(rows).orderBy("new_index").collect()] == list(range(rows.count()))


def test_an_emptied_episode_raises(spark):
    frames = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 2.0), (1, 3.0)], "episode_index long, timestamp double")
    limit = lambda a, b: spark.createDataFrame([(0, a), (1, b), (1, b + 1)], "episode_index long, limit double")
    assert rows_of(trim.clip_to_limit(frames, limit(0.0, 2.5)), "episode_index", "timestamp") == [(0, 0.0), (1, 2.0)]
    with pytest.raises(Exception, match="no frame is left of episode 1"):
        trim.clip_to_limit(frames, limit(0.0, 1.5)).collect()
    with pytest.raises(Exception, match="no limit of episode 1"):
        trim.clip_to_limit(frames, limit(0.0, 1.5).where("episode_index = 0")).collect()


# Bitmaps


@pytest.mark.parametrize("seed", range(3))
def test_missing_and_dense_ids(spark, seed):
    r = random.Random(seed)
    top = [70_000, 32_767, 32_768][seed]
    gone = set(r.sample(range(top), 300)) | (set(range(32_768, 65_536)) if seed == 0 else set())
    ids = [i for i in range(top + 1) if i not in gone] + [5, 5, -3, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").repartition(4)
    assert [x[0] for x in checks.missing_ids(rows, "i").orderBy("missing_id").collect()] == sorted(gone - {5})
    real = [i for i in ids if i is not None]
    assert tuple(checks.dense_ids(rows, "i").first()) == (len(real), len(set(real)), -3, top, False)
    assert checks.dense_ids(rows.where("i >= 0").distinct(), "i").first().dense == (not gone - {5})


def test_dense_ids_of_few_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(40_000)], "i long")
    assert tuple(checks.dense_ids(rows, "i").first()) == (40_000, 40_000, 0, 39_999, True)
    assert checks.missing_ids(rows, "i").collect() == [] and checks.missing_ids(rows.limit(0), "i").collect() == []
    assert tuple(checks.dense_ids(rows.limit(0), "i").first()) == (0, 0, None, None, True)


def exchanged(df):
    """The columns that each exchange of a plan moves."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange [^\n]*", text), text


def test_no_rows_move_for_ids(spark):
    rows = spark.range(1000).withColumnRenamed("id", "i")
    for df in (checks.dense_ids(rows, "i"), bitmaps.bitmaps(rows, "i")):
        exchanges, text = exchanged(df)
        assert exchanges and text.count("partial_bitmap_construct_agg") == 1
        # What is under each exchange is a partial aggregate: a row a bitmap.
        assert all(re.search(r"Exchange[^\n]*\n[^\n]*Aggregate\([^\n]*partial_", text[text.index(e) - 2 :]) for e in exchanges)


# Greedy choice


def plain_greedy(items, size, conflict):
    kept = []
    for b in sorted(items, key=lambda b: (-size(b), b[1])):
        if not any(k[0] == b[0] and conflict(k, b) for k in kept):
            kept.append(b)
    return sorted(kept, key=repr)


def plain_iou(a, b):
    w = max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    union = a[4] * a[5] + b[4] * b[5] - w * h
    return w * h / union if union > 0 else 0.0


def test_greedy_boxes_of_one_group(spark):
    r = random.Random(3)
    items = [(r.choice(["a", "a", "a", None]), i, r.uniform(-200, 200), r.uniform(0, 150), r.choice([20.0, 30.0, 45.0, 120.0]), r.choice([20.0, 25.0, 70.0])) for i in range(900)]
    items += [("a", 1000 + i, 5.0, 5.0, 40.0, 40.0) for i in range(300)] + [("b", i, 0.0, 0.0, 0.0, 0.0) for i in range(3)]
    boxes = spark.createDataFrame(items, "f string, id long, x double, y double, w double, h double").repartition(3)
    got = rows_of(greedy.boxes(boxes, "f", Scratch(spark)), "f", "id", "x", "y", "w", "h")
    assert got == plain_greedy(items, lambda b: b[4] * b[5], lambda k, b: plain_iou(k, b) >= 0.35)
    assert rows_of(greedy.boxes(boxes, "f", Scratch(spark), cell=13.0), "id", "f") == rows_of(greedy.boxes(boxes, "f", Scratch(spark)), "id", "f")
    lost = boxes.withColumn("x", F.when(F.col("id") == 1, None).when(F.col("id") == 2, float("nan")).otherwise(F.col("x")))
    assert not {1, 2} & {x.id for x in greedy.boxes(lost.where("f = 'a'"), "f", Scratch(spark)).collect()}
    assert greedy.boxes(boxes.limit(0), "f", Scratch(spark)).collect() == []


def test_greedy_centres_of_one_group(spark):
    r = random.Random(4)
    items = [(1, i, float(r.randrange(5)), r.uniform(0, 900), r.uniform(0, 900)) for i in range(700)]
    shapes = spark.createDataFrame(items, "f long, id long, area double, cx double, cy double")
    near = lambda k, b: ((k[3] - b[3]) ** 2 + (k[4] - b[4]) ** 2) ** 0.5 < 60
    assert rows_of(greedy.centres(shapes, "f", 60.0, Scratch(spark)), "f", "id", "area", "cx", "cy") == plain_greedy(items, lambda b: b[2], near)


def test_overlap_limit_is_the_one_of_pairs(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 1.0, 0.0, 10.0, 10.0)], "id long, x double, y double, w double, h double")
    pair = boxes.alias("a").join(boxes.alias("b"), F.expr("a.id < b.id")).select(iou(tuple(F.col(f"a.{c}") for c in "xywh"), tuple(F.col(f"b.{c}") for c in "xywh")))
    assert pair.first()[0] == pytest.approx(90 / 110)

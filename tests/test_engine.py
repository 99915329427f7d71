"""Operators on small literal datasets, and random cases against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import queries
from trajspark.functions import text as X
from trajspark.functions import values as V
from trajspark.model import TrajectoryDataset, harmonised_stats, normalise_tasks, normalise_videos, require_columns
from trajspark.operators import edit, greedy, intervals, joins, keys, sample, stats, trim
from trajspark.plans import checks, report, trials
from trajspark.sources import layouts
from trajspark.storage import Scratch
from trajspark.streaming import counts


def dataset(spark, lengths=(4, 4, 4), prompts=("a", "b"), fps=10):
    frames, episodes, at = [], [], 0
    for e, n in enumerate(lengths):
        t = e % len(prompts)
        frames += [(at + i, e, i, i / fps, t, [float(i), float(e)]) for i in range(n)]
        episodes.append((e, n, at, at + n, [prompts[t]]))
        at += n
    return TrajectoryDataset(
        spark.createDataFrame(frames, "index long, episode_index long, frame_index long, timestamp double, task_index long, action array<float>"),
        spark.createDataFrame(episodes, "episode_index long, length long, dataset_from_index long, dataset_to_index long, tasks array<string>"),
        spark.createDataFrame(list(enumerate(prompts)), "task_index long, task string"),
        {"fps": fps, "robot_type": "arm"},
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_valid_dataset_has_no_violations(spark):
    assert checks.violations(dataset(spark)).collect() == []


def test_violations_are_found(spark):
    ds = dataset(spark)
    bad = TrajectoryDataset(ds.frames.where("index <> 5"), ds.episodes, ds.tasks.where("task_index = 0"), ds.info)
    found = {r["check"] for r in checks.violations(bad).collect()}
    assert {"length", "frame_index", "frame_ids", "unknown_task"} <= found


def test_merge_shifts_ids_and_joins_dictionaries(spark):
    out = edit.merge([dataset(spark), dataset(spark, prompts=("b", "c"))])
    assert rows(out.tasks) == [(0, "a"), (1, "b"), (2, "c")]
    assert checks.violations(out).collect() == []
    assert out.totals()["total_frames"] == 24 and out.totals()["splits"] == {"train": "0:6"}
    assert [r[0] for r in out.frames.where("index >= 12").orderBy("index").select("task_index").collect()] == [1] * 4 + [2] * 4 + [1] * 4


def test_merge_refuses_one_dataset_and_other_rates(spark):
    with pytest.raises(ValueError):
        edit.merge([dataset(spark)])
    with pytest.raises(ValueError):
        edit.merge([dataset(spark), dataset(spark, fps=30)])


def test_delete_move_and_missing_ids(spark):
    out = edit.delete(dataset(spark, (2, 3, 4)), [1])
    assert checks.violations(out).collect() == []
    assert out.frames.count() == 6
    with pytest.raises(KeyError):
        edit.delete(dataset(spark), [9])
    source, target = edit.move(dataset(spark, (2, 3, 4)), dataset(spark, (5,), ("z",)), [2])
    assert (source.frames.count(), target.frames.count()) == (5, 9)
    assert checks.violations(target).collect() == []


def test_relabel_retask_and_change_prompt(spark):
    ds = dataset(spark, prompts=("Put the cup in the red bowl", "Put the cup to the red colored bowl."))
    out = edit.relabel(ds, X.negated)
    assert rows(out.tasks) == [(0, "Put the cup into the bowl that is not green and not blue.")]
    assert checks.violations(out).collect() == []
    with pytest.raises(ValueError):
        edit.relabel(dataset(spark), X.negated)
    with pytest.raises(ValueError):
        edit.retask(dataset(spark), "x")
    assert rows(edit.retask(dataset(spark, prompts=("a",)), "x").tasks) == [(0, "x")]
    changed = edit.change_prompt(dataset(spark, (2, 2), ("a", "b")), 1, "c")
    assert rows(changed.tasks) == [(0, "a"), (1, "c")]
    assert rows(changed.frames.select("episode_index", "task_index").distinct()) == [(0, 0), (1, 1)]


def shrink(lead, trail, n, keep):
    if n <= keep:
        return 0, 0
    while n - lead - trail < keep and lead + trail > 0:
        if lead > trail:
            lead -= 1
        else:
            trail -= 1
    return lead, trail


def test_frozen_bounds_against_a_loop(spark):
    random.seed(1)
    data, expected, at = [], {}, 0
    for e in range(60):
        n = random.choice([1, 30, 50, 51, 55, 70, 120])
        signal, x = [], 0.0
        start, stop = sorted(random.sample(range(n + 1), 2)) if n > 1 else (0, 0)
        for i in range(n):
            x += 1.0 if start <= i < stop and i else 0.0
            signal.append(x)
        moves = [i for i in range(1, n) if abs(signal[i] - signal[i - 1]) > 0.5]
        lead, trail = (moves[0], n - 1 - moves[-1]) if moves else (n, n)
        expected[e] = shrink(lead, trail, n, 50)
        data += [(at + i, e, v) for i, v in enumerate(signal)]
        at += n
    out = trim.frozen_bounds(spark.createDataFrame(data, "index long, episode_index long, v double"), "v", 0.5)
    assert {r.episode_index: (r.lead, r.trail) for r in out.collect()} == expected


def test_first_run(spark):
    flags = [1, 1, 1, 1, 0, 1, 1, 1, 1, 1]
    data = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate(flags)], "episode_index long, rn long, f boolean")
    assert trim.first_run(data, F.col("f"), 5).first().run_start == 5
    assert trim.first_run(data, F.col("f"), 6).collect() == []
    assert trim.first_run(data, F.col("f"), 0).first().run_start == 0


def test_closing_plan_cases(spark):
    up = [0.0] * 30 + [1.0] * 70
    data = {0: up, 1: [1 - x for x in up], 2: [0.5] * 100, 3: up[:20], 4: [0.0] * 95 + [1.0] * 5}
    out = trim.closing_plan(spark.createDataFrame([(e, i, v) for e, s in data.items() for i, v in enumerate(s)], "episode_index long, index long, v double"), "v")
    assert {r.episode_index: r.trim_start for r in out.collect()} == {0: 38, 1: 38, 2: 35, 3: 0, 4: 80}


@pytest.mark.parametrize("source,target", [(30, 10), (10, 3), (30, 12.5)])
def test_downsample_indices_against_numpy(spark, source, target):
    lengths = [1, 2, 7, 14, 101]
    out = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", trim.kept_indices(F.col("n"), source, target).alias("k"))
    for n, kept in out.collect():
        times = np.arange(0, (n - 1) / source + 1 / (2 * target), 1 / target)
        assert kept == np.unique(np.clip(np.round(times * source).astype(int), 0, n - 1)).tolist()
    with pytest.raises(ValueError):
        trim.kept_indices(F.col("n"), 10, 10)


def test_stats_against_numpy_and_merged(spark):
    random.seed(2)
    values = [(i % 3, random.random() * 10) for i in range(100)]
    df = spark.createDataFrame(values, "g long, x double")
    own = stats.scalar_stats(df, "x", ["g"])
    for r in own.collect():
        x = np.array([v for g, v in values if g == r.g])
        assert np.allclose([r["min"], r["max"], r["mean"], r["std"], r["q10"], r["q50"]], [x.min(), x.max(), x.mean(), x.std(), *np.quantile(x, [0.1, 0.5])])
    x, whole = np.array([v for _, v in values]), stats.merged(own).first()
    assert np.allclose([whole["mean"], whole["std"], whole["count"]], [x.mean(), x.std(), 100])
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 6.0])], "g long, v array<float>")
    back = stats.as_arrays(stats.vector_stats(vectors, "v", ["g"]), ["g"]).first()
    assert back["mean"] == [2.0, 4.0] and back["count"] == [2, 2]


def test_prefix_crosses_buckets(spark):
    df = spark.range(50).select((F.col("id") * 7).alias("k"), (F.col("id") % 5).alias("w"))
    out = {r.k: r.p for r in keys.prefix(df, "k", F.col("w"), "p", bucket=16).collect()}
    total = 0
    for i in range(50):
        assert out[i * 7] == total
        total += i % 5


def test_nearest_range_and_greedy(spark):
    q = spark.createDataFrame([(0, 0.5), (0, 2.0), (1, 1.0)], "g long, t double")
    t = spark.createDataFrame([(0, 0.4), (0, 1.7)], "g long, t double")
    got = [(r.g, r.t, None if r.gap is None else round(r.gap, 3), r.valid) for r in joins.nearest(q, t, "g", "t", 0.2).orderBy("g", "t").collect()]
    assert got == [(0, 0.5, 0.1, True), (0, 2.0, 0.3, False), (1, 1.0, None, False)]
    ranges = spark.createDataFrame([(0, 0, 9), (1, 5, 3000)], "file long, start long, end long")
    points = spark.createDataFrame([(7,), (2999,), (5000,)], "i long")
    assert {r.i: r.file for r in intervals.first_cover(points, "i", ranges).collect()} == {7: 0, 2999: 1, 5000: None}
    boxes = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (0, 2, 1, 1, 9, 9), (0, 3, 50, 50, 5, 5)], "f long, id long, x int, y int, w int, h int")
    assert sorted(r.id for r in greedy.boxes(boxes, "f", Scratch(spark)).collect()) == [1, 3]


def test_range_query_reaches_the_largest_index(spark, tmp_path):
    ids = [0, 776, 777, 799, 800, 9346, 9347, 50_000]
    rows = spark.createDataFrame([(i, 0, 1.0, "view", None, None) for i in ids], "event_id long, user_id long, value double, event_type string, ts timestamp, props string")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["index"]: r["file"] for r in queries.range_lookup_file(spark, str(tmp_path)).collect()}
    assert got == {i: min(k for k in range(100) if k * 777 <= i <= k * 777 + 799) for i in ids}


def test_box_queries_take_all_ids(spark, tmp_path):
    ids = [0, 1, 2, 1999, 2000, 2001, 3700, 5007, 9999, 123_456]
    spark.createDataFrame([(i, i % 2) for i in ids], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    box = {i: (i * 37 % 100, i * 53 % 100, 20 + i % 30, 20 + i % 17) for i in ids}

    def iou(a, b):
        (ax, ay, aw, ah), (bx, by, bw, bh) = box[a], box[b]
        both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
        return both / (aw * ah + bw * bh - both)

    pairs = {(a, b): round(iou(a, b), 6) for a in ids for b in ids if a < b and a % 2 == b % 2 and iou(a, b) >= 0.35}
    assert {(r.id, r.other): r.iou for r in queries.iou_pairs(spark, str(tmp_path)).collect()} == pytest.approx(pairs, abs=2e-6)
    kept = []
    for i in sorted(ids, key=lambda i: (-box[i][2] * box[i][3], i)):
        if all(i % 2 != k % 2 or iou(i, k) < 0.35 for k in kept):
            kept.append(i)
    assert sorted(r.id for r in queries.greedy_box_dedup(spark, str(tmp_path)).collect()) == sorted(kept)


def test_strict_map_raises(spark):
    d = spark.createDataFrame([("a", 1)], "k string, v long")
    with pytest.raises(Exception, match="unknown value"):
        joins.strict_map(spark.createDataFrame([("b",)], "k string"), "k", d, "k", "v", "out").collect()


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Put the cup into the 2nd bowl from the left from the robot perspective", "Put the cup in the red colored bowl"),
        ("put it INTO the 1nd bowl from left", "put it in the green colored bowl"),
        ("Put it on the table", "Put it on the table"),
    ],
)
def test_ordinal_to_color(spark, text, expected):
    assert one(spark, X.ordinal_to_color(F.lit(text), [F.lit(c) for c in ("green", "red", "blue")])) == expected


def test_prompt_functions(spark):
    full = F.lit("Put the  big  cup into the 3rd bowl from the left from the robot perspective.")
    assert one(spark, X.ordinal_to_position(full)) == "Put the big cup into the bowl on the right from the robot perspective"
    assert one(spark, X.ordinal_from_right(full)) == "Put the big cup into the 1st bowl from the right from the robot perspective"
    with pytest.raises(Exception, match="could not parse"):
        one(spark, X.ordinal_to_position(F.lit("nothing")))
    assert one(spark, X.detect_color(F.lit("red or Green colored"))) == "green"
    assert one(spark, X.detect_color(F.lit("colored"))) is None
    assert one(spark, X.extract_object(F.lit("Put the red in the bowl near the cup"))) == "cup"
    assert one(spark, F.size(X.variants(F.lit("q"), F.lit("red"), F.lit("cup")))) == 20
    answers = ["top_left", "Top-Right.", "it is bottom left", "dunno"]
    assert [one(spark, X.normalise_answer(F.lit(a))) for a in answers] == ["top_left", "top_right", "bottom_left", None]
    assert len({one(spark, X.near_key(F.lit(t))) for t in ("Put it.", "put  it", "PUT IT")}) == 1
    assert one(spark, X.parse_config(F.lit("a/config1-Red-blue-green"))) == ["red", "blue", "green"]
    assert one(spark, F.size(X.relative_prompts(F.lit("cup"), F.lit(1), F.array(*map(F.lit, "abc"))))) == 2


def test_values(spark):
    assert math.isclose(one(spark, V.hue(F.lit(0.0), F.lit(1.0), F.lit(0.0))), 120)
    assert one(spark, V.circular_difference(F.lit(350.0), F.lit(10.0))) == 20
    assert one(spark, V.chunk_path(F.lit(1234), 1000)) == "data/chunk-001/episode_001234.parquet"
    assert one(spark, V.human(F.lit(1234567))) == "1.23M"
    assert one(spark, V.finite(F.lit(float("inf")))) is False


def test_sampling_is_seeded(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = (rows(sample.fraction(df, "k", 0.25, 7)) for _ in range(2))
    assert a == b and len(a) == 25 and rows(sample.fraction(df, "k", 0.25, 8)) != a
    counts_ = {r.value: r["count"] for r in sample.balanced(df, "k", ["x", "y", "z"], 1).groupBy("value").count().collect()}
    assert sorted(counts_.values()) == [33, 33, 34]


def test_plans(spark):
    assert trials.plan(spark, "balanced").count() == 270
    compact = trials.plan(spark, "compact30")
    assert {r["target_color"]: r["count"] for r in compact.groupBy("target_color").count().collect()} == {"red": 10, "green": 10, "blue": 10}
    with pytest.raises(ValueError):
        trials.plan(spark, "full", repeats=0)


def test_accuracy_and_reports(spark):
    results = spark.createDataFrame([("top_left", "top-left"), ("top_left", "dunno"), ("top_right", "top left")], "target_position string, prediction string")
    out = {r["class"]: (r.total, r.correct, r.unparseable) for r in report.accuracy(results).collect()}
    assert out == {"top_left": (2, 1, 1), "top_right": (1, 0, 0), "bottom_left": (0, 0, 0), "bottom_right": (0, 0, 0), None: (3, 1, 1)}
    infos = {"a": {"fps": 10, "features": {}}, "b": {"fps": 10.0, "features": {}}}
    fields = spark.createDataFrame(report.header_fields(infos), "dataset string, field string, value string")
    assert report.uniformity(fields, 2).where("NOT uniform").collect() == []


@pytest.mark.parametrize("layout", ["2", "3"])
def test_layouts_round_trip(spark, tmp_path, layout):
    ds, root = dataset(spark), f"file://{tmp_path}/{layout}"
    layouts.write(ds, root, layout)
    back = layouts.read(spark, root, columns=["index", "episode_index", "frame_index", "task_index"])
    assert layouts.version(spark, root) == layout
    assert back.info["total_frames"] == 12 and checks.totals_match(TrajectoryDataset(ds.frames, ds.episodes, ds.tasks, back.info))
    assert rows(back.tasks) == [(0, "a"), (1, "b")]
    assert checks.violations(back).collect() == []
    with pytest.raises(FileExistsError):
        layouts.write(ds, root, layout)


def test_side_files(spark, tmp_path):
    path = f"file://{tmp_path}/cache.json"
    assert layouts.read_cache(spark, path).count() == 0
    layouts.write_text(spark, path, json.dumps({"episodes": {"3": {"keep_full": True, "trim_start": 4}}}))
    assert layouts.read_cache(spark, path).select("episode_index", "keep_full", "trim_start").first() == (3, True, 4)
    (tmp_path / "s.csv").write_text('scene_path,target_celebrity,target_position,all_celebrities\na.png,x,top_left,"[""x"", ""y""]"\n')
    first = layouts.read_samples(spark, f"file://{tmp_path}/s.csv").first()
    assert first.scene_path.endswith("/a.png") and first.all_celebrities == ["x", "y"]


def test_prompt_tables_of_all_layouts(spark):
    for df in (
        spark.createDataFrame([(0, "a"), (1, "b")], "task_index long, task string"),
        spark.createDataFrame([(0, "a"), (1, "b")], "task_index long, __index_level_0__ string"),
        spark.createDataFrame([("a",), ("b",)], "words string").coalesce(1),
    ):
        assert rows(normalise_tasks(df)) == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="stands twice"):
        normalise_tasks(spark.createDataFrame([(0, "a"), (0, "b")], "task_index long, task string")).collect()
    with pytest.raises(ValueError):
        normalise_tasks(spark.range(1))


def test_episode_columns(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.5, 1.5, float("nan"))], "e long, `videos/c/chunk_index` long, `videos/c/file_index` long, `videos/c/from_timestamp` float, `videos/c/to_timestamp` float, `stats/x/min` double")
    assert normalise_videos(df).first().videos[0].from_ts == 0.5
    assert harmonised_stats(df).first()["stats/x/min"] == [None]
    with pytest.raises(ValueError):
        require_columns(df, ["missing"])


def test_clip_and_rebase(spark):
    ds = dataset(spark, (5, 5))
    limits = spark.createDataFrame([(0, 0.2), (0, 0.3), (1, 9.0)], "episode_index long, limit double")
    assert trim.clip_to_limit(ds.frames, limits).count() == 8
    with pytest.raises(Exception, match="no limit"):
        trim.clip_to_limit(ds.frames, limits.where("episode_index = 0")).collect()
    out = trim.rebase(ds.frames.where("frame_index >= 2")).where("episode_index = 0").orderBy("index").collect()
    assert [round(r.timestamp, 3) for r in out] == [0.0, 0.1, 0.2] and math.isclose(out[0]["shift"], 0.2)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, f"t{i % 2}", float(i)) for i in range(50)], "event_id long, user_id long, event_type string, value double")
    events = events.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600))
    events.write.parquet(f"{tmp_path}/events.parquet")
    batch = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert rows(counts.counted(batch, f"file://{tmp_path}/counts", 3)) == rows(counts.task_counts(batch))
    keys_ = ["start", "end", "event_type"]
    assert rows(counts.counted(batch, f"file://{tmp_path}/windows", 3, groups=counts.windowed, keys=keys_)) == rows(counts.windowed(batch))
    assert rows(counts.closed_sessions(batch, f"file://{tmp_path}/sessions", 3, "15 minutes")) == rows(counts.sessions(batch, "15 minutes"))


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

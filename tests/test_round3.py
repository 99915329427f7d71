"""Steps that differed from their SQL or grew too fast on larger tables."""

import time

from pyspark.sql import functions as F

from trajspark.functions import text as X
from trajspark.functions import values as V
from trajspark.model import TrajectoryDataset
from trajspark.operators import datasets, stats
from trajspark.sources import layouts, sink
from trajspark.storage import Scratch


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_means_add_up_in_frame_order(spark):
    # Backwards (and in parts) the sum is 0.6.
    rows = [(0, 2, 0.3, [0.3, 3.0]), (0, 1, 0.2, [0.2, 2.0]), (0, 0, 0.1, [0.1, 1.0]), (1, 0, None, None)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, x double, v array<double>").coalesce(1)
    own = {r["episode_index"]: r for r in stats.scalar_stats(frames, "x", ["episode_index"], "frame_index").collect()}
    assert own[0]["mean"] == (0.1 + 0.2 + 0.3) / 3 != (0.3 + 0.2 + 0.1) / 3 and own[0]["count"] == 3
    assert own[1]["mean"] is None and own[1]["count"] == 0
    episodes = spark.createDataFrame([(0,), (1,)], "episode_index long")
    out = datasets.with_episode_stats(TrajectoryDataset(frames, episodes, None, {}), ["x", "v"]).episodes.where("episode_index = 0").first()
    assert out["stats/x/mean"] == [(0.1 + 0.2 + 0.3) / 3] and out["stats/v/mean"] == [(0.1 + 0.2 + 0.3) / 3, 2.0]


def test_rounding_next_to_ties(spark):
    x = [56.208749999999995, 46.996249999999996, -0.00005, 2.0]
    assert [one(spark, V.rounded(F.lit(v), 4)) for v in x] == [56.2088, 46.9962, -0.0001, 2.0]


def test_counts_for_people_round_as_printf_does(spark):
    for n in (1000, 1005, 22465, 30845, 79125, 88475, 81425, 999995, 1234567, 1125000, 1375000, 10**9, 2345000000):
        unit, by = next((u, b) for u, b in (("B", 1e9), ("M", 1e6), ("K", 1e3)) if n >= b)
        assert one(spark, V.human(F.lit(n))) == f"{n / by:.2f}{unit}"
    assert one(spark, V.human(F.lit(999))) == "999" and one(spark, V.human(F.lit(None).cast("long"))) is None


def test_wordings_work_out_color_and_object_once(spark):
    rows = spark.createDataFrame([("q", "der", "cup"), ("q", None, "cup"), ("q", "der", None)], "t string, c string, o string")
    forms = ["a {obj} {color}", "A {OBJ} {color}", "A {obj} {color}", "b", "B", "{color}", "c {obj}"]
    df = rows.select(X.variants(F.col("t"), F.reverse("c"), F.initcap("o"), forms).alias("v"))
    assert [r["v"] for r in df.collect()] == [["a Cup red", "A {OBJ} red", "b", "red", "c Cup"], ["q"], ["q"]]
    plan = spark.range(9).select(F.col("id").cast("string").alias("x")).select(X.variants(F.col("x"), F.reverse("x"), F.initcap("x")).alias("v"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("reverse(") == text.count("initcap(") == 1


def test_siblings_are_copied_without_listing_data(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for name in ("README.md", ".gitattributes", "meta/notes.txt", "meta/info.json", "meta/episodes/chunk-000/file-000.parquet", "videos/top/chunk-000/file-000.mp4"):
        (a / name).parent.mkdir(parents=True, exist_ok=True)
        (a / name).write_text(name)
    (a / "meta/.notes.txt.crc").write_text("Hadoop's")
    (a / "data/chunk-000").mkdir(parents=True)
    for i in range(4000):
        (a / f"data/chunk-000/file-{i:03d}.parquet").touch()
    spark.range(1).count()
    began = time.perf_counter()
    done = layouts.copy_siblings(spark, f"file://{a}", f"file://{b}")
    took = time.perf_counter() - began
    assert done == [".gitattributes", "README.md", "meta/notes.txt", "videos/top/chunk-000/file-000.mp4"]
    assert all((b / x).read_text() == x for x in done) and sorted(str(x.relative_to(b)) for x in b.rglob("*") if x.is_file()) == done
    assert took < 12


def test_writers_work_out_small_tables_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, own=Scratch.table: made.append(name) or own(self, df, name))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    episodes = spark.createDataFrame([(0, 2, ["p"], 0, 0), (1, 1, ["p"], 0, 1)], "episode_index long, length long, tasks array<string>, `data/chunk_index` long, `data/file_index` long")
    frames = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 0), (2, 1, 0, 0)], "index long, episode_index long, frame_index long, task_index long")
    ds = TrajectoryDataset(frames, episodes.mapInArrow(counted, episodes.schema), spark.createDataFrame([(0, "p")], "task_index long, task string"), {"fps": 10})
    layouts.write(ds, f"file://{tmp_path}/a", "3")
    assert made == ["episodes", "tasks"] and seen.value == 2
    assert layouts.read(spark, f"file://{tmp_path}/a").frames.count() == 3


def test_card_takes_the_header_that_was_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    episodes = spark.createDataFrame([(0, 2, ["p"]), (1, 1, ["p"])], "episode_index long, length long, tasks array<string>")
    frames = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 0), (2, 1, 0, 0)], "index long, episode_index long, frame_index long, task_index long")
    ds = TrajectoryDataset(frames, episodes.mapInArrow(counted, episodes.schema), spark.createDataFrame([(0, "p")], "task_index long, task string"), {"fps": 10})
    a = f"file://{tmp_path}/a"
    info = layouts.write(ds, a, "3")
    assert info == layouts.read_info(spark, a) and (info["total_episodes"], info["total_frames"], info["total_tasks"]) == (2, 3, 1)
    layouts.write_card(ds, a, "Own", ["one"], info)
    assert made.value == 2  # as the write made them
    own = (tmp_path / "a/README.md").read_text()
    layouts.write_card(ds, a, "Own", ["one"])
    assert own == (tmp_path / "a/README.md").read_text() and "| total_frames | 3 |" in own and made.value > 2


def test_files_are_copied_by_several_tasks(spark, tmp_path):
    (tmp_path / "a/x").mkdir(parents=True)
    names = [f"x/{i}.bin" for i in range(40)]
    for name in names:
        (tmp_path / "a" / name).write_text(name)
    spark.sparkContext.setJobGroup("copies", "")
    sink.copy_files(spark.createDataFrame([(x,) for x in names], "path string"), f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    tracker = spark.sparkContext.statusTracker()
    last = max(s for job in tracker.getJobIdsForGroup("copies") for s in tracker.getJobInfo(job).stageIds)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tracker.getStageInfo(last).numTasks == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(str(x.relative_to(tmp_path / "b")) for x in (tmp_path / "b").rglob("*.bin")) == sorted(names)
    assert all((tmp_path / "b" / x).read_text() == x for x in names)
    sink.copy_files(spark.createDataFrame([], "path string"), f"file://{tmp_path}/a", f"file://{tmp_path}/c")
    assert not (tmp_path / "c").exists()

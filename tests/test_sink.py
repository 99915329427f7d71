"""Files of given names: whole or not at all, exact rows, and rewritten only where rows changed."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trajspark.model import TrajectoryDataset
from trajspark.operators import edit
from trajspark.sources import layouts, sink


def found(root):
    return {os.path.relpath(p, root): hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(p)}


@pytest.fixture()
def ds(spark):
    rows = spark.range(95).select(
        F.col("id").alias("index"), F.floor(F.col("id") / 10).alias("episode_index"), (F.col("id") % 10).alias("frame_index"), (F.col("id") % 3).alias("task_index"),
        F.array(F.col("id").cast("double")).alias("state"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("note"),
    )
    tasks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "task_index long, task string")
    episodes = rows.groupBy("episode_index").agg(F.count("*").alias("length"), F.min("index").alias("dataset_from_index"), (F.max("index") + 1).alias("dataset_to_index"))
    episodes = episodes.withColumns({"tasks": F.array(F.lit("a")), "data/chunk_index": F.lit(0).cast("long"), "data/file_index": F.floor(F.col("episode_index") / 4)})
    return TrajectoryDataset(rows.repartition(5), episodes, tasks, {"fps": 10, "chunks_size": 3})


def test_files_have_exact_rows_and_all_values(spark, ds, tmp_path):
    root = f"file://{tmp_path}/d"
    layouts.write(ds, root, "3", rows_per_file=20)
    files = sorted(glob.glob(f"{tmp_path}/d/data/**/*.parquet", recursive=True))
    assert [os.path.relpath(p, f"{tmp_path}/d/data") for p in files] == [f"chunk-{i // 3:03d}/file-{i % 3:03d}.parquet" for i in range(5)]
    assert [spark.read.parquet(p).count() for p in files] == [20, 20, 20, 20, 15]
    back = layouts.read(spark, root).frames.select(*ds.frames.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ds.frames.collect()))
    assert [tuple(r) for r in spark.read.parquet(files[1]).select("index").collect()] == [(i,) for i in range(20, 40)]


def test_a_failed_write_leaves_the_old_files(spark, ds, tmp_path):
    root = f"file://{tmp_path}/d"
    layouts.write(ds, root, "2")
    before = found(f"{tmp_path}/d/data")
    assert len(before) == 10
    broken = ds.frames.withColumn("task_index", F.when(F.col("index") == 94, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("task_index")))
    with pytest.raises(Exception, match="broken"):
        layouts.write(TrajectoryDataset(broken, ds.episodes, ds.tasks, ds.info), root, "2", overwrite=True)
    named = ds.frames.withColumn("_path", F.when(F.col("index") > 50, None).otherwise("x.parquet"))
    with pytest.raises(Exception, match="have no name"):
        sink.write_files(named, f"{root}/data", "_path", ["index"])
    assert found(f"{tmp_path}/d/data") == before
    assert sorted(os.listdir(f"{tmp_path}/d")) == ["data", "meta"]


def test_json_lines_and_copies(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"é{i}", f"part-{i % 2}.jsonl") for i in range(6)], "i long, t string, name string")
    sink.write_files(rows, f"{tmp_path}/j", "name", ["i"], kind="json")
    assert open(f"{tmp_path}/j/part-1.jsonl", encoding="utf-8").read() == "".join(f'{{"i": {i}, "t": "é{i}"}}\n' for i in (1, 3, 5))
    sink.copy_files(spark.createDataFrame([("part-0.jsonl",)], "path string"), f"{tmp_path}/j", f"{tmp_path}/k")
    assert found(f"{tmp_path}/k") == {"part-0.jsonl": found(f"{tmp_path}/j")["part-0.jsonl"]}


def test_only_changed_files_are_written(spark, ds, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    layouts.write(ds, a, "3")
    layouts.write_text(spark, f"{a}/README.md", "card")
    new = edit.change_prompt(layouts.read(spark, a), 5, "b")
    done = {r.path: (r.rows, r.changed) for r in layouts.rewrite(new, a, b).collect()}
    assert done == {"chunk-000/file-000.parquet": (40, False), "chunk-000/file-001.parquet": (40, True), "chunk-000/file-002.parquet": (15, False)}
    old, now = found(f"{tmp_path}/a"), found(f"{tmp_path}/b")
    assert [n for n in sorted(old) if n.startswith("data/") and old[n] == now[n]] == ["data/chunk-000/file-000.parquet", "data/chunk-000/file-002.parquet"]
    assert now["README.md"] == old["README.md"] and not [n for n in now if "staging" in n or n.endswith(".part")]
    back = layouts.read(spark, b)
    assert {r.task_index for r in back.frames.where("episode_index = 5").collect()} == {1}
    want = new.frames.select(*ds.frames.columns).collect()
    assert sorted(map(tuple, back.frames.select(*ds.frames.columns).collect())) == sorted(map(tuple, want))
    with pytest.raises(FileExistsError):
        layouts.rewrite(new, a, b)

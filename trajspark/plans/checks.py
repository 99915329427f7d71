"""Validators: each violation is a row, so a valid dataset has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TrajectoryDataset, require_columns
from ..operators import bitmaps
from ..operators.datasets import timed
from ..operators.keys import prefixes


def missing_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids between 0 and the largest that no row has."""
    return bitmaps.missing(rows, key)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("duplicate_id")).agg(F.count("*").alias("n")).where("n > 1")


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """One row of counts: a key is dense from 0 if all agree."""
    return bitmaps.dense(rows, key)


def violations(ds: TrajectoryDataset) -> DataFrame:
    """(check, episode_index, detail) of everything that a valid dataset must not have.

    Frames are read once and summed by episode and word of 64 frame numbers, which map tasks do for themselves. Ids are
    dense if every episode's frames are a run, and if runs and episodes follow each other without a gap.
    """
    frames, episodes, tasks = ds.frames, ds.episodes, ds.tasks
    known = frames.select("episode_index", "index", "frame_index", "task_index").join(tasks.select("task_index", F.lit(True).alias("there")), "task_index", "left")
    unknown = F.when(F.col("there").isNull(), F.coalesce(F.col("task_index").cast("string"), F.lit("null")))
    own = known.groupBy("episode_index", bitmaps.word("frame_index").alias("word")).agg(
        F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"),
        F.min("frame_index").alias("f0"), F.max("frame_index").alias("f1"), bitmaps.bits_of("frame_index").alias("bits"),
        F.min(F.col("index") - F.col("frame_index")).alias("s0"), F.max(F.col("index") - F.col("frame_index")).alias("s1"),
        F.min(unknown).alias("unknown"),
    )
    lows, highs = ([f(c).alias(c) for c in names] for f, names in ((F.min, ("low", "f0", "s0", "unknown")), (F.max, ("high", "f1", "s1"))))
    own = own.groupBy("episode_index").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("fn"), *lows, *highs)
    meta = episodes.groupBy("episode_index").agg(
        F.count("*").alias("rows"), F.min("length").alias("length"), F.min("dataset_from_index").alias("dataset_from_index"),
        F.min("dataset_to_index").alias("dataset_to_index"), F.min(F.coalesce(F.size("tasks"), F.lit(0))).alias("n_tasks"),
    )
    both = meta.join(own, "episode_index", "full").where(F.col("episode_index").isNotNull())
    both = prefixes(both, "episode_index", {"before": F.lit(1).cast("long"), "frames_before": F.coalesce("n", F.lit(0).cast("long"))})
    say = lambda name, bad, detail: F.when(bad, F.struct(F.lit(name).alias("check"), F.col(detail).cast("string").alias("detail")))
    found = F.array(
        say("episode_without_frames", F.col("n").isNull(), "length"),
        say("frames_without_episode", F.col("rows").isNull(), "n"),
        say("several_episode_rows", F.col("rows") > 1, "rows"),
        say("length", F.col("n") != F.col("length"), "n"),
        say("range", (F.col("low") != F.col("dataset_from_index")) | (F.col("high") + 1 != F.col("dataset_to_index")), "low"),
        say("frame_index", (F.col("f0") != 0) | (F.col("f1") != F.col("n") - 1) | (F.col("fn") != F.col("n")), "f1"),
        say("no_prompt", F.coalesce(F.col("n_tasks"), F.lit(0)) < 1, "length"),
        say("unknown_task", F.col("unknown").isNotNull(), "unknown"),
        say("episode_ids", F.col("before") != F.col("episode_index"), "before"),
        say("frame_ids", (F.col("low") != F.col("frames_before")) | (F.col("s0") != F.col("s1")), "low"),
    )
    rows = both.select("episode_index", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    return rows.select("v.check", "episode_index", "v.detail")


def trimmed_violations(ds: TrajectoryDataset, required: list[str], files: DataFrame | None = None) -> DataFrame:
    """What `violations` finds, episodes of no length, header totals that differ, and, given a listing (path), files
    that episodes name and that aren't there. Missing columns raise."""
    require_columns(ds.frames, required)
    out = violations(ds)
    empty = ds.episodes.where("length <= 0").select(F.lit("empty_episode").alias("check"), "episode_index", F.col("length").cast("string").alias("detail"))
    out = out.unionByName(empty)
    real = ds.episodes.agg(F.count("*").alias("total_episodes")).crossJoin(ds.frames.agg(F.count("*").alias("total_frames")))
    for name in ("total_episodes", "total_frames"):
        if name in ds.info:
            differs = real.where(F.col(name) != ds.info[name])
            out = out.unionByName(differs.select(F.lit(name).alias("check"), F.lit(None).cast("long").alias("episode_index"), F.col(name).cast("string").alias("detail")))
    if files is not None:
        out = out.unionByName(missing_files(ds.episodes, files))
    return out


def named_files(episodes: DataFrame) -> DataFrame:
    """episode_index and the path of every data and video file that an episode names."""
    from ..model import video_keys

    def path(prefix: str, folder: str, suffix: str):
        part = lambda name: F.format_string(name + "-%03d", F.col(f"`{prefix}{name.replace('chunk', 'chunk_index').replace('file', 'file_index')}`").cast("long"))
        return F.concat(F.lit(folder), part("chunk"), F.lit("/"), part("file"), F.lit(suffix))

    own = [path("data/", "data/", ".parquet")] if "data/file_index" in episodes.columns else []
    own += [path(f"videos/{key}/", f"videos/{key}/", ".mp4") for key in video_keys(episodes.columns)]
    return episodes.select("episode_index", F.explode(F.array(*own)).alias("path")) if own else episodes.select("episode_index", F.lit("").alias("path")).where("false")


def missing_files(episodes: DataFrame, files: DataFrame) -> DataFrame:
    lost = named_files(episodes).join(files.select("path"), "path", "left_anti")
    return lost.select(F.lit("missing_file").alias("check"), "episode_index", F.col("path").alias("detail"))


def video_violations(frames: DataFrame, episodes: DataFrame, times: DataFrame, tolerance: float) -> DataFrame:
    """(check, episode_index, detail): episodes with frames that no video time (key, chunk, file, t) is near to; the
    detail names the camera and the number of frames."""
    far = timed(frames, episodes, times, tolerance).where(~F.col("valid"))
    out = far.groupBy("episode_index", "key").agg(F.count("*").alias("n"))
    return out.select(F.lit("video_timestamps").alias("check"), "episode_index", F.concat_ws(": ", "key", F.col("n").cast("string")).alias("detail"))


#: Phrases of which every dataset must have one prompt each.
PHRASES = ["red colored bowl", "green colored bowl", "blue colored bowl"]


def final_report(
    ds: TrajectoryDataset, source_totals: tuple[int, int] | None = None, copies: int = 2, files: DataFrame | None = None, brightness: DataFrame | None = None
) -> DataFrame:
    """One row for each of the twelve checks of a finished dataset: step, name, status (ok, fail, skip), bad (how many).

    source_totals: episodes and frames of the sources, of which the dataset holds `copies`. files: a listing (path).
    brightness: episode_index, brightness; an episode and its copy half the dataset later must differ.
    """
    from ..functions.text import has_ordinal

    spark, info = ds.frames.sparkSession, ds.info
    one = lambda df, bad: df.agg(F.sum(bad).cast("long").alias("bad"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    literal = lambda n: spark.range(1).select(F.lit(n).cast("long").alias("bad"))
    cameras = [k for k, v in info.get("features", {}).items() if v.get("dtype") == "video"]
    own = ds.frames.groupBy("episode_index", bitmaps.word("index").alias("word")).agg(
        F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), bitmaps.bits_of("index").alias("bits")
    )
    own = own.groupBy("episode_index").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("distinct")
    )
    own = prefixes(own, "episode_index", {"before": F.lit(1).cast("long"), "frames_before": F.col("n")})
    meta = ds.episodes.select("episode_index", "dataset_from_index", "dataset_to_index").join(own, "episode_index", "left")
    half = ds.episodes.select("episode_index").distinct().agg((F.count("*") / 2).cast("long").alias("half"))
    pairs = own.select("episode_index", "n").crossJoin(F.broadcast(half))  # one row
    copies_of = pairs.withColumn("episode_index", F.col("episode_index") - F.col("half")).select("episode_index", F.col("n").alias("other"))
    paired = pairs.where("episode_index < half").join(copies_of, "episode_index", "left")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")  # a fixed list
    covered = ds.tasks.select(F.lower("task").alias("text")).join(F.broadcast(phrases), F.expr("contains(text, phrase)")).select("phrase").distinct()
    checks = [
        ("header", literal(int(not cameras) + int(float(info.get("fps", 0)) <= 0))),
        ("episode_total", literal(int(info.get("total_episodes") != copies * source_totals[0])) if source_totals else None),
        ("frame_total", literal(int(info.get("total_frames") != copies * source_totals[1])) if source_totals else None),
        ("episode_ids", one(own, flag(F.col("before") != F.col("episode_index")))),
        ("frame_ids", one(own, flag((F.col("low") != F.col("frames_before")) | (F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("distinct") != F.col("n"))))),
        ("task_ids", one(ds.frames.select("task_index").distinct().join(ds.tasks.select("task_index", F.lit(1).alias("known")), "task_index", "left"), flag(F.col("known").isNull()))),
        ("no_ordinals", one(ds.tasks, flag(has_ordinal(F.col("task"))))),
        ("phrases", covered.agg((len(PHRASES) - F.count("*")).alias("bad"))),
        ("ranges", one(meta, flag(~F.coalesce((F.col("low") == F.col("dataset_from_index")) & (F.col("high") + 1 == F.col("dataset_to_index")), F.lit(False))))),
        ("files", missing_files(ds.episodes, files).select("detail").distinct().agg(F.count("*").alias("bad")) if files is not None else None),
        ("brightness", None),
        ("copies", one(paired, flag(~F.coalesce(F.col("n") == F.col("other"), F.lit(False))))),
    ]
    if brightness is not None:
        checks[10] = ("brightness", one(brightness_pairs(brightness, ds), flag(~F.col("differs"))))
    rows = []
    for step, (name, found) in enumerate(checks, 1):
        bad = F.coalesce(F.col("bad"), F.lit(0)).cast("long") if found is not None else F.lit(None).cast("long")
        status = F.lit("skip") if found is None else F.when(bad == 0, "ok").otherwise("fail")
        rows.append((literal(0) if found is None else found).select(F.lit(step).alias("step"), F.lit(name).alias("name"), status.alias("status"), bad.alias("bad")))
    return reduce(DataFrame.unionByName, rows)


def brightness_pairs(brightness: DataFrame, ds: TrajectoryDataset, least: float = 1.0, share: float = 0.03) -> DataFrame:
    """episode_index, brightness, other, differs: episodes of the first half beside their copies. They differ by more
    than `least` levels or by more than that share."""
    half = ds.episodes.select("episode_index").distinct().agg((F.count("*") / 2).cast("long").alias("half"))
    rows = brightness.crossJoin(F.broadcast(half))  # one row
    copies = rows.select((F.col("episode_index") - F.col("half")).alias("episode_index"), F.col("brightness").alias("other"))
    out = rows.where("episode_index < half").join(copies, "episode_index").drop("half")
    gap = F.abs(F.col("other") - F.col("brightness"))
    return out.withColumn("differs", (gap > least) | F.coalesce(F.abs(F.try_divide("other", "brightness") - 1) > share, F.lit(False)))


def totals_match(ds: TrajectoryDataset) -> bool:
    """Whether the header's totals are those of the tables."""
    real = ds.totals()
    return all(ds.info.get(k) == real[k] for k in ("total_episodes", "total_frames", "total_tasks"))

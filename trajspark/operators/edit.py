"""Datasets as wholes: merge, move, delete, relabel, retask, compact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import TrajectoryDataset
from .keys import BUCKET, first_seen, prefixes


def require_ids(episodes: DataFrame, ids: list[int]) -> None:
    """Every id of a stated list must be there."""
    asked = episodes.sparkSession.createDataFrame([(i,) for i in ids], "episode_index long")
    missing = [r[0] for r in asked.join(episodes, "episode_index", "left_anti").limit(20).collect()]
    if missing:
        raise KeyError(f"no such episodes: {sorted(missing)}")


def _rekey(episodes: DataFrame) -> DataFrame:
    """(source, episode_index) with dense new ids and frame ranges, in that order; by two-level prefix sums."""
    rows = episodes.select("source", "episode_index", "length").withColumn("_b", F.floor(F.col("episode_index") / BUCKET))
    sums = rows.groupBy("source", "_b").agg(F.count("*").alias("_c"), F.sum("length").alias("_s"))
    before = Window.orderBy("source", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_c", "_s")])
    inside = Window.partitionBy("source", "_b").orderBy("episode_index")
    rows = rows.withColumns(
        {"_n": F.row_number().over(inside) - 1, "_l": F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    rows = rows.join(sums, ["source", "_b"])
    return rows.select(
        "source",
        "episode_index",
        (F.col("_c") + F.col("_n")).alias("new_episode"),
        (F.col("_s") + F.col("_l")).alias("dataset_from_index"),
        (F.col("_s") + F.col("_l") + F.col("length")).alias("dataset_to_index"),
    )


def _tagged(parts: list[DataFrame]) -> DataFrame:
    rows = [df.withColumn("source", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def merge(sources: list[TrajectoryDataset]) -> TrajectoryDataset:
    """All datasets as one: dense ids in the sources' order, one dictionary in order of first appearance."""
    if len(sources) < 2:
        raise ValueError("merge takes two datasets or more")
    headers = {(s.info.get("fps"), s.info.get("robot_type")) for s in sources}
    if len(headers) > 1:
        raise ValueError(f"headers differ: {sorted(map(str, headers))}")
    out = merge_tagged(
        _tagged([s.frames for s in sources]), _tagged([s.episodes for s in sources]), _tagged([s.tasks for s in sources]), dict(sources[0].info)
    )
    names = sources[0].frames.columns
    return TrajectoryDataset(out.frames.select(*[f"`{c}`" for c in names]), out.episodes, out.tasks, out.info)


def merge_tagged(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, info: dict) -> TrajectoryDataset:
    """Datasets that lie in common tables with a number `source`, as one. Their own ids need not be dense."""
    dictionary = first_seen(tasks, "task", ["source", "task_index"], "new_task").withColumnRenamed("new_task", "_new")
    remap = tasks.join(dictionary, "task").select("source", "task_index", "_new")
    keys = _rekey(episodes)
    names = [c for c in frames.columns if c != "source"]
    frames = frames.withColumn("index", F.lit(None).cast("long")) if "index" not in names else frames
    frames = frames.join(remap, ["source", "task_index"], "left")
    frames = frames.join(keys.drop("dataset_to_index"), ["source", "episode_index"])
    names = names if "index" in names else ["index", *names]
    index = F.col("dataset_from_index") + F.col("frame_index")
    changed = {"index": index, "episode_index": F.col("new_episode"), "task_index": F.col("_new")}
    frames = frames.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names])
    drop = ["dataset_from_index", "dataset_to_index"]
    episodes = episodes.drop(*drop).join(keys, ["source", "episode_index"]).drop("source", "episode_index")
    episodes = episodes.withColumnRenamed("new_episode", "episode_index")
    return TrajectoryDataset(frames, episodes, dictionary.select(F.col("_new").alias("task_index"), "task"), info).with_totals()


def select(ds: TrajectoryDataset, ids: list[int], keep: bool = True) -> TrajectoryDataset:
    """Listed episodes, or all others, under their old ids."""
    require_ids(ds.episodes, ids)
    few = F.broadcast(ds.frames.sparkSession.createDataFrame([(i,) for i in ids], "episode_index long"))  # as many as the caller lists
    how = "left_semi" if keep else "left_anti"
    return TrajectoryDataset(ds.frames.join(few, "episode_index", how), ds.episodes.join(few, "episode_index", how), ds.tasks, ds.info)


def rebuilt(ds: TrajectoryDataset) -> TrajectoryDataset:
    """Dense ids for a dataset that lost episodes."""
    episodes = ds.episodes.withColumn("source", F.lit(0))
    keys = _rekey(episodes).drop("source")
    frames = ds.frames.join(keys.select("episode_index", "new_episode", "dataset_from_index"), "episode_index")
    changed = {"index": F.col("dataset_from_index") + F.col("frame_index"), "episode_index": F.col("new_episode")}
    frames = frames.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in ds.frames.columns])
    rows = ds.episodes.drop("dataset_from_index", "dataset_to_index").join(keys, "episode_index").drop("episode_index")
    return TrajectoryDataset(frames, rows.withColumnRenamed("new_episode", "episode_index"), ds.tasks, dict(ds.info)).with_totals()


def delete(ds: TrajectoryDataset, ids: list[int]) -> TrajectoryDataset:
    return rebuilt(select(ds, ids, keep=False))


def move(source: TrajectoryDataset, target: TrajectoryDataset, ids: list[int]) -> tuple[TrajectoryDataset, TrajectoryDataset]:
    """The source without, and the target with, the listed episodes."""
    return delete(source, ids), merge([target, rebuilt(select(source, ids))])


def relabel(ds: TrajectoryDataset, rewrite, allow_unchanged: bool = False) -> TrajectoryDataset:
    """Prompts rewritten by a Column function; equal results share an entry. Prompts that stay raise unless allowed."""
    new = ds.tasks.withColumn("new", rewrite(F.col("task")))
    if not allow_unchanged:
        same = new.where(F.col("new").eqNullSafe(F.col("task"))).select("task").limit(5).collect()
        if same:
            raise ValueError(f"prompts without a match: {[r[0] for r in same]}")
    dictionary = first_seen(new, "new", ["task_index"], "_new")
    remap = new.join(dictionary, "new").select("task_index", "_new", "task", "new")
    frames = ds.frames.join(remap.select("task_index", "_new"), "task_index", "left")
    frames = frames.select(*[F.col("_new").alias(c) if c == "task_index" else F.col(f"`{c}`") for c in ds.frames.columns])
    pairs = remap.agg(F.map_from_entries(F.collect_list(F.struct("task", "new"))).alias("_map"))  # one entry a prompt
    episodes = ds.episodes.crossJoin(F.broadcast(pairs))
    renamed = F.transform("tasks", lambda t: F.coalesce(F.try_element_at(F.col("_map"), t), t))
    episodes = episodes.withColumn("tasks", renamed).drop("_map")
    return TrajectoryDataset(frames, episodes, dictionary.select(F.col("_new").alias("task_index"), F.col("new").alias("task")), ds.info).with_totals()


def retask(ds: TrajectoryDataset, prompt: str) -> TrajectoryDataset:
    """One new prompt for a dataset that has exactly one."""
    if ds.tasks.limit(2).count() != 1:
        raise ValueError("the dataset must have exactly one prompt")
    return relabel(ds, lambda t: F.lit(prompt), allow_unchanged=True)


def change_prompt(ds: TrajectoryDataset, episode: int, prompt: str) -> TrajectoryDataset:
    """Another prompt for one episode; the dictionary gains it if it is new and loses what nobody uses."""
    require_ids(ds.episodes, [episode])
    here = F.col("episode_index") == episode
    added = ds.tasks.agg((F.coalesce(F.max("task_index"), F.lit(-1)) + 1).alias("task_index")).withColumn("task", F.lit(prompt))
    known = ds.tasks.unionByName(added.join(ds.tasks.select("task"), "task", "left_anti"))
    target = known.where(F.col("task") == prompt).agg(F.min("task_index").alias("_t"))
    frames = ds.frames.crossJoin(F.broadcast(target)).withColumn("task_index", F.when(here, F.col("_t")).otherwise(F.col("task_index"))).drop("_t")
    episodes = ds.episodes.withColumn("tasks", F.when(here, F.array(F.lit(prompt))).otherwise(F.col("tasks")))
    return compact(TrajectoryDataset(frames, episodes, known, ds.info))


def compact(ds: TrajectoryDataset) -> TrajectoryDataset:
    """Dictionary entries that frames use, renumbered in their order."""
    used = ds.tasks.join(ds.frames.select("task_index").distinct(), "task_index", "left_semi")
    dense = prefixes(used, "task_index", {"_new": F.lit(1).cast("long")})
    frames = ds.frames.join(dense.select("task_index", "_new"), "task_index")
    frames = frames.select(*[F.col("_new").alias(c) if c == "task_index" else F.col(f"`{c}`") for c in ds.frames.columns])
    return TrajectoryDataset(frames, ds.episodes, dense.select(F.col("_new").alias("task_index"), "task"), ds.info).with_totals()


def single_prompt(episodes: DataFrame, used: DataFrame, tasks: DataFrame) -> DataFrame:
    """Episodes with `prompt`: the first of tasks, else the only entry their frames use."""
    own = used.groupBy("episode_index").agg(F.min("task_index").alias("low"), F.max("task_index").alias("high"))
    names = tasks.select(F.col("task_index").alias("low"), "task")
    rows = episodes.join(own, "episode_index", "left").join(names, "low", "left")
    first = F.get(F.col("tasks"), F.lit(0))
    only = F.when(F.col("low") == F.col("high"), F.col("task"))
    return rows.withColumn("prompt", F.coalesce(first, only, F.raise_error(F.lit("an episode has no prompt")).cast("string"))).drop("low", "high", "task")

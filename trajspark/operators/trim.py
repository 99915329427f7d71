"""Operators that drop or thin out frames: frozen ends, waiting phases, clipping, downsampling, repair.

What depends on the order of an episode's frames is a scan over chunks (`scans`), so an episode may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clamp, l2_distance
from . import scans
from .keys import frame_index


def velocity(frames: DataFrame, signal: str, order="index", episode: str = "episode_index", into: str = "velocity") -> DataFrame:
    """Distance of each frame's signal (number or vector) from the one before; 0 for the first."""
    return _stepped(scans.scan(frames, episode, order, {"_before": scans.before(F.col(signal))}), signal, into)


def _stepped(rows: DataFrame, signal: str, into: str) -> DataFrame:
    vector = dict(rows.dtypes)[signal].startswith("array")
    step = l2_distance(F.col(signal), F.col("_before")) if vector else F.abs(F.col(signal) - F.col("_before"))
    return rows.withColumn(into, F.coalesce(step, F.lit(0.0))).drop("_before")


def balanced_shrink(lead: Column, trail: Column, n: Column, keep: int) -> tuple[Column, Column]:
    """Lead and trail made smaller until `keep` frames are left: the larger one first, of equal ones the trail."""
    both = lead + trail
    excess = F.least(both, F.greatest(F.lit(0), both - (n - keep)))
    gap = F.abs(lead - trail)
    rest = excess - gap
    low = F.least(lead, trail)
    new_lead = F.when(excess <= gap, F.when(lead > trail, lead - excess).otherwise(lead)).otherwise(low - F.floor(rest / 2))
    new_trail = F.when(excess <= gap, F.when(lead > trail, trail).otherwise(trail - excess)).otherwise(low - F.ceil(rest / 2))
    return new_lead.cast("long"), new_trail.cast("long")


def frozen_bounds(frames: DataFrame, signal: str, threshold: float = 0.02, keep: int = 50, order="index", episode="episode_index") -> DataFrame:
    """Per episode: n, and how many frames without motion to cut at either end. Short episodes lose none."""
    keys = [episode, *([order] if isinstance(order, str) else order)]
    rows = scans.scan(frames.select(*keys, signal), episode, order, {"_before": scans.before(F.col(signal)), "rn": scans.number()})
    rows = _stepped(rows, signal, "velocity")
    moving = F.col("velocity") > threshold
    ends = rows.groupBy(episode).agg(
        F.count("*").alias("n"), F.min(F.when(moving, F.col("rn"))).alias("first"), F.max(F.when(moving, F.col("rn"))).alias("last")
    )
    n = F.col("n")
    lead, trail = F.coalesce(F.col("first"), n), F.coalesce(n - 1 - F.col("last"), n)
    new_lead, new_trail = balanced_shrink(lead, trail, n, keep)
    short = n <= keep
    return ends.select(
        episode,
        "n",
        F.when(short, F.lit(0)).otherwise(new_lead).cast("long").alias("lead"),
        F.when(short, F.lit(0)).otherwise(new_trail).cast("long").alias("trail"),
    )


def cut_ends(frames: DataFrame, bounds: DataFrame, order="index", episode="episode_index") -> DataFrame:
    """Frames between an episode's lead and trail."""
    rows = scans.scan(frames, episode, order, {"rn": scans.number()}).join(bounds.select(episode, "n", "lead", "trail"), episode)
    return rows.where((F.col("rn") >= F.col("lead")) & (F.col("rn") < F.col("n") - F.col("trail"))).drop("rn", "n", "lead", "trail")


def first_run(rows: DataFrame, flag: Column, length: int, rn: str = "rn", episode: str = "episode_index", into: str = "run_start") -> DataFrame:
    """Per episode that has one: where its first run of at least `length` frames with `flag` starts.

    Frames of a run have the same number of frames without the flag before them, so runs are groups, of any length.
    """
    own = rows.select(episode, rn, flag.alias("_flag"))
    own = scans.scan(own, episode, rn, {"_island": scans.sum_before(F.when(F.col("_flag"), 0).otherwise(1))})
    runs = own.where("_flag").groupBy(episode, "_island")
    runs = runs.agg(F.min(rn).alias("_start"), F.count("*").alias("_n")).where(F.col("_n") >= max(1, length))
    return runs.groupBy(episode).agg(F.min("_start").alias(into))


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    low, high = (F.get(ordered, (F.floor((n + k) / 2) - 1).cast("int")) for k in (1, 2))
    return low + (high - low) / 2


def closing_plan(
    frames: DataFrame, signal: str, run: int = 5, wait: int = 8, remain: int = 20, factor: float = 0.45, fallback: float = 0.35,
    order="index", episode: str = "episode_index",
) -> DataFrame:
    """Per episode: where to start so that frames before a gripper has closed (and `wait` more) go.

    The early level is the median of the first frames; the gripper has closed where the signal has left it by
    `factor` of its range, towards the farther extreme, for `run` frames. Without such a run a share of the episode
    goes. At least `remain` frames stay.
    """
    rows = scans.scan(frames, episode, order, {"rn": scans.number()})
    sizes = frames.groupBy(episode).agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(F.col("n") / 10)))
    # Ten frames at most are early, so those and their places are enough for the median.
    early = F.array_sort(F.collect_list(F.when(F.col("rn") < 10, F.struct("rn", F.col(signal).cast("double").alias("x")))))
    levels = rows.groupBy(episode).agg(
        early.alias("_early"), F.min(F.nanvl(F.col(signal).cast("double"), F.lit(None))).alias("low"), F.max(F.nanvl(F.col(signal).cast("double"), F.lit(None))).alias("high")
    )
    levels = levels.join(sizes, episode)
    known = F.array_sort(F.filter(F.transform(F.filter("_early", lambda r: r["rn"] < first), lambda r: r["x"]), lambda x: x.isNotNull()))
    levels = levels.withColumn("_known", known).withColumn("early", _median(F.col("_known"))).drop("_early", "_known")
    up = (F.col("high") - F.col("early")) >= (F.col("early") - F.col("low"))
    move = factor * F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    levels = levels.withColumns({"up": up, "threshold": F.when(up, F.col("early") + move).otherwise(F.col("early") - move)})
    seen = rows.join(levels, episode)
    shut = F.when(F.col("up"), F.col(signal) >= F.col("threshold")).otherwise(F.col(signal) <= F.col("threshold"))
    runs = first_run(seen.withColumn("shut", F.coalesce(shut, F.lit(False))), F.col("shut"), run, episode=episode)
    out = levels.join(runs, episode, "left")
    n = F.col("n")
    start = F.coalesce(F.col("run_start") + wait, F.rint(n * fallback).cast("long"))
    bounded = F.greatest(F.lit(0), F.least(start, n - remain))
    return out.select(
        episode, "n", "early", "threshold", "up", "run_start", F.when(n <= remain, F.lit(0)).otherwise(bounded).cast("long").alias("trim_start")
    )


def kept_indices(n: Column, source_fps: float, target_fps: float) -> Column:
    """Distinct source frames nearest to the target's times, ties to even."""
    if target_fps >= source_fps:
        raise ValueError("the target rate must be below the source rate")
    step = 1 / target_fps
    count = F.ceil(((n - 1) / source_fps + step / 2) / step)
    nearest = lambda i: clamp(F.rint((i * F.lit(step)) * source_fps), 0.0, (n - 1).cast("double")).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)).cast("long") - 1), nearest))


def downsample(frames: DataFrame, source_fps: float, target_fps: float, order="index", episode: str = "episode_index") -> DataFrame:
    """The kept frames with new frame ids and times."""
    lengths = frames.groupBy(episode).agg(F.count("*").alias("n"))
    kept = lengths.select(episode, F.posexplode(kept_indices(F.col("n"), source_fps, target_fps)).alias("new_frame", "rn"))
    rows = scans.scan(frames, episode, order, {"rn": scans.number()}).withColumn("rn", F.col("rn").cast("int"))
    return rows.join(kept, [episode, "rn"]).withColumn("new_timestamp", (F.col("new_frame") / target_fps).cast("float")).drop("rn")


def clip_to_limit(frames: DataFrame, limits: DataFrame, tolerance: float = 1e-6, time: str = "timestamp", episode: str = "episode_index") -> DataFrame:
    """Frames not later than the smallest of their episode's limits (episode, limit). An episode without a limit raises,
    and so does one that would lose all its frames."""
    least = limits.groupBy(episode).agg(F.min("limit").alias("limit"))
    starts = frames.groupBy(episode).agg(F.min(time).alias("_start")).join(least, episode, "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col(episode).cast("string"), F.lit("null")))).cast("double")
    limit = F.when(F.col("limit").isNull(), fail("no limit of episode ")).when(F.col("_start") > F.col("limit") + tolerance, fail("no frame is left of episode ")).otherwise(F.col("limit"))
    known = starts.select(F.col(episode).alias("_of"), limit.alias("_limit"))
    rows = frames.join(known, F.col(episode).eqNullSafe(F.col("_of")), "left")
    return rows.where(F.col(time) <= F.col("_limit") + tolerance).select(*frames.columns)


def clip_to_intervals(frames: DataFrame, slices: DataFrame, tolerance: float = 1e-4, time: str = "timestamp", episode: str = "episode_index") -> DataFrame:
    """Frames whose time falls into every slice of their episode (episode, from_ts, to_ts, low, high).

    An episode's slices, one a camera, come as one array, so frames are neither multiplied nor grouped: equal frames stay.
    """
    own = slices.groupBy(episode).agg(F.collect_list(F.struct("from_ts", "to_ts", "low", "high")).alias("_slices"))
    at = lambda s: s["from_ts"] + F.col(time)
    inside = lambda s: (at(s) >= s["low"] - tolerance) & (at(s) <= F.least(s["high"], s["to_ts"]) + tolerance)
    return frames.join(own, episode).where(F.forall("_slices", inside)).select(*frames.columns)


def rebase(frames: DataFrame, tolerance: float = 1e-4, time: str = "timestamp", order="index", episode: str = "episode_index") -> DataFrame:
    """Times from the first frame that is left, where that is later than the tolerance; `shift` says by how much."""
    first = F.first(time).over(Window.partitionBy(episode).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = frames.withColumn("shift", F.when(F.abs(first) > tolerance, first).otherwise(0.0))
    return rows.withColumn(time, F.col(time) - F.col("shift"))


def deduplicate(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order: a policy such as last, matching or best-scoring."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")

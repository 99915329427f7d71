"""Edits that make a whole new dataset: trimmed, thinned out, repaired, relabelled and merged.

Each takes and returns a TrajectoryDataset; frames move by episode only, and new ids come from two-level prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import replace_values
from ..model import TrajectoryDataset, normalise_videos, require_columns, video_keys, without_stats
from . import edit, joins, keys, sample, stats, trim

#: Frame features whose statistics an episode row carries.
FEATURES = ["action", "observation.state", "timestamp", "frame_index", "episode_index", "index", "task_index"]


def regrown(ds: TrajectoryDataset, frames: DataFrame, episodes: DataFrame, fps: float | None = None) -> TrajectoryDataset:
    """Frames that are left and their episodes with dense ids; times start anew if a rate is given. Episodes that lost
    all frames go."""
    rows = keys.reindex(frames)
    changed = {"episode_index": F.col("new_episode"), "index": F.col("new_index"), "frame_index": F.col("frame_index").cast("long")}
    if fps is not None:
        changed["timestamp"] = (F.col("frame_index") / fps).cast("float")
    out = rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in ds.frames.columns])
    spans = keys.episode_spans(frames)
    rest = episodes.drop("length", "dataset_from_index", "dataset_to_index").join(spans, "episode_index").drop("episode_index")
    return TrajectoryDataset(out, rest.withColumnRenamed("new_episode", "episode_index"), ds.tasks, dict(ds.info)).with_totals()


def own_files(episodes: DataFrame, fps: float) -> DataFrame:
    """Episodes that have a data file and a video of each camera for themselves: numbers and times follow."""
    number, zero = F.col("episode_index"), F.lit(0).cast("long")
    out = {"data/chunk_index": zero, "data/file_index": number, "meta/episodes/chunk_index": zero, "meta/episodes/file_index": zero}
    for key in video_keys(episodes.columns):
        out |= {f"videos/{key}/chunk_index": zero, f"videos/{key}/file_index": number}
        out |= {f"videos/{key}/from_timestamp": F.lit(0.0), f"videos/{key}/to_timestamp": F.round(F.col("length") / fps, 6)}
    return episodes.withColumns(out)


def trim_plan(
    frames: DataFrame, signal: str, full_ratio: float = 0.0, seed: int = 42, cache: DataFrame | None = None, mode: str = "all", **closing
) -> DataFrame:
    """episode_index, n, keep_full, trim_start, auto_trim_start, validated: where each episode starts.

    A seeded share stays whole; others start where the gripper has closed. A cache (episode_index, keep_full,
    trim_start, auto_trim_start, validated) of earlier decisions wins. mode: "all"; "trim_validated" trims validated
    entries and keeps all else whole; "only_validated" keeps validated entries alone.
    """
    if mode not in ("all", "trim_validated", "only_validated"):
        raise ValueError(mode)
    plan = trim.closing_plan(frames, signal, **closing).select("episode_index", "n", F.col("trim_start").alias("_auto"))
    full = sample.fraction(plan.select("episode_index"), "episode_index", full_ratio, seed).withColumn("_full", F.lit(True))
    kind = "episode_index long, keep_full boolean, trim_start long, auto_trim_start long, validated boolean"
    known = frames.sparkSession.createDataFrame([], kind) if cache is None else cache
    known = known.select("episode_index", F.struct("keep_full", "trim_start", "auto_trim_start", "validated").alias("_c"))
    rows = plan.join(full, "episode_index", "left").join(known, "episode_index", "left")
    there, c = F.col("_c").isNotNull(), F.col("_c")
    valid, drawn, none = F.coalesce(c["validated"], F.lit(False)), F.coalesce("_full", F.lit(False)), F.lit(0).cast("long")
    auto = F.when(drawn, none).otherwise(F.col("_auto"))
    if mode == "all":
        whole = F.when(there, F.coalesce(c["keep_full"], drawn)).otherwise(drawn)
        usual = F.when(whole, none).otherwise(F.coalesce(c["auto_trim_start"], none))
        start = F.when(there, F.coalesce(c["trim_start"], usual)).otherwise(auto)
    else:
        whole, start = ~valid, F.when(valid, F.coalesce(c["trim_start"], none)).otherwise(none)
        rows = rows.where(valid) if mode == "only_validated" else rows
    start = F.greatest(none, F.least(start, F.col("n") - 1))
    auto = F.when(there, c["auto_trim_start"]).otherwise(auto)
    return rows.select("episode_index", "n", whole.alias("keep_full"), start.alias("trim_start"), auto.alias("auto_trim_start"), valid.alias("validated"))


def start_at(ds: TrajectoryDataset, plan: DataFrame) -> TrajectoryDataset:
    """The episodes of a plan (episode_index, trim_start) from there on, each with files of its own and times from 0."""
    fps = float(ds.info["fps"])
    rows = ds.frames.withColumn("_rn", keys.frame_index("index")).join(plan.select("episode_index", "trim_start"), "episode_index")
    left = rows.where(F.col("_rn") >= F.col("trim_start")).select(*ds.frames.columns)
    out = regrown(ds, left, ds.episodes, fps)
    return TrajectoryDataset(out.frames, own_files(without_stats(out.episodes), fps), out.tasks, out.info)


def with_episode_stats(ds: TrajectoryDataset, features: list[str] | None = None) -> TrajectoryDataset:
    """Episodes with columns stats/<feature>/<statistic> (arrays of doubles) of the features that frames have."""
    names = [c for c in (features or FEATURES) if c in ds.frames.columns]
    episodes = without_stats(ds.episodes)
    for name in names:
        rows = ds.frames.select("episode_index", F.col("frame_index").alias("_at"), F.col(f"`{name}`").alias("v"))
        if dict(rows.dtypes)["v"].startswith("array"):
            dims = rows.select("episode_index", "_at", F.posexplode("v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
            own = stats.as_arrays(stats.scalar_stats(dims, "x", ["episode_index", "dim"], "_at"), ["episode_index"])
        else:
            own = stats.scalar_stats(rows.withColumn("v", F.col("v").cast("double")), "v", ["episode_index"], "_at")
            own = own.select("episode_index", *[F.array(c).alias(c) for c in own.columns if c != "episode_index"])
        # The count is one number, also of a vector.
        own = own.withColumn("count", F.slice("count", 1, 1))
        cells = [F.col(c).cast("array<double>").alias(f"stats/{name}/{c}") for c in own.columns if c != "episode_index"]
        episodes = episodes.join(own.select("episode_index", *cells), "episode_index", "left")
    return TrajectoryDataset(ds.frames, episodes, ds.tasks, ds.info)


def nested_stats(episodes: DataFrame) -> DataFrame:
    """episode_index and its stats/<feature>/<statistic> columns as a map of maps."""
    found: dict[str, list[str]] = {}
    for c in episodes.columns:
        if c.startswith("stats/"):
            feature, name = c.removeprefix("stats/").rsplit("/", 1)
            found.setdefault(feature, []).append(name)
    cell = lambda f, n: F.col(f"`stats/{f}/{n}`").cast("array<double>")
    inner = lambda f, own: F.create_map(*[x for n in own for x in (F.lit(n), cell(f, n))])
    parts = [x for f, own in found.items() for x in (F.lit(f), inner(f, own))]
    empty = F.create_map().cast("map<string, map<string, array<double>>>")
    return episodes.select("episode_index", (F.create_map(*parts) if parts else empty).alias("stats"))


def downsampled(ds: TrajectoryDataset, target_fps: float) -> TrajectoryDataset:
    """Fewer frames a second in either layout: frames nearest to the target's times, header, and video slices that
    follow each other in their files. Statistics stay those of the source, near enough."""
    fps = float(ds.info["fps"])
    left = trim.downsample(ds.frames, fps, target_fps).select(*ds.frames.columns)
    out = regrown(ds, left, ds.episodes, target_fps)
    features = {}
    for name, own in ds.info.get("features", {}).items():
        parts = {k: own[k] | {"video.fps": target_fps} for k in ("info", "video_info") if "video.fps" in (own.get(k) or {})}
        features[name] = own | parts if own.get("dtype") == "video" else own
    info = out.info | {"fps": target_fps} | ({"features": features} if features else {})
    return TrajectoryDataset(out.frames, in_file_order(out.episodes, target_fps), out.tasks, info)


def in_file_order(episodes: DataFrame, fps: float) -> DataFrame:
    """Video slices that follow each other in their files, in the order of episodes, from the first frame to the last."""
    times = {}
    for key in video_keys(episodes.columns):
        file = Window.partitionBy(f"videos/{key}/chunk_index", f"videos/{key}/file_index").orderBy("episode_index")
        before = F.sum("length").over(file.rowsBetween(Window.unboundedPreceding, -1))
        begin = F.coalesce(before, F.lit(0)) / fps
        times[f"videos/{key}/from_timestamp"] = begin
        times[f"videos/{key}/to_timestamp"] = begin + (F.col("length") - 1) / fps
    return episodes.withColumns(times) if times else episodes


def trimmed_frozen(ds: TrajectoryDataset, signal: str, threshold: float = 0.02, keep: int = 50) -> TrajectoryDataset:
    """A dataset without the frames at the ends of its episodes in which nothing moves.

    Of several rows of an episode the one with the largest `row` counts, if there is such a column. Frames take the
    prompt of their episode's row, whatever theirs was. What is left has dense ids, times from 0, slices that follow each
    other in the video files, and statistics of its own. Data files keep their episodes.
    """
    episodes = ds.episodes
    if "row" in episodes.columns:
        episodes = trim.deduplicate(episodes, "episode_index", [F.col("row").desc()]).drop("row")
    clean = retasked(TrajectoryDataset(ds.frames, without_stats(episodes), ds.tasks, ds.info))
    bounds = trim.frozen_bounds(clean.frames, signal, threshold, keep)
    left = trim.cut_ends(clean.frames, bounds).select(*[F.col(f"`{c}`") for c in ds.frames.columns])
    fps = float(ds.info["fps"])
    out = regrown(clean, left, clean.episodes, fps)
    return with_episode_stats(TrajectoryDataset(out.frames, in_file_order(out.episodes, fps), out.tasks, out.info), [signal])


def clipped_to_limits(ds: TrajectoryDataset, tolerance: float = 1e-6) -> TrajectoryDataset:
    """Frames up to the end that the episode's video slices state, the shortest of its cameras; an episode that would lose
    all its frames raises. Ids are dense again; slices keep their starts and end at the last frame that is left."""
    slices = normalise_videos(ds.episodes).select("episode_index", F.explode("videos").alias("v"))
    limits = slices.select("episode_index", (F.col("v.to_ts") - F.col("v.from_ts")).alias("limit"))
    left = trim.clip_to_limit(ds.frames, limits, tolerance)
    out = regrown(ds, left, without_stats(ds.episodes))
    ends = out.frames.groupBy("episode_index").agg(F.max("timestamp").cast("double").alias("_last"))
    rows = out.episodes.join(ends, "episode_index")
    to = {f"videos/{k}/to_timestamp": F.col(f"`videos/{k}/from_timestamp`") + F.col("_last") for k in video_keys(rows.columns)}
    return TrajectoryDataset(out.frames, rows.withColumns(to).drop("_last"), out.tasks, out.info)


def timed(frames: DataFrame, episodes: DataFrame, times: DataFrame, tolerance: float, rest: list[str] | None = None) -> DataFrame:
    """episode_index, `rest` of the episode's row, index, key, valid: whether a video time (key, chunk, file, t) is near
    each frame, for each camera."""
    rest = rest or []
    slices = normalise_videos(episodes).select("episode_index", *rest, F.explode("videos").alias("v"))
    rows = frames.select("episode_index", "index", F.col("timestamp").cast("double").alias("timestamp")).join(slices, "episode_index")
    file = lambda key, chunk, number: F.concat_ws("/", key, F.col(chunk).cast("string"), F.col(number).cast("string"))
    rows = rows.select("episode_index", *rest, "index", "v.key", file("v.key", "v.chunk", "v.file").alias("_file"), (F.col("v.from_ts") + F.col("timestamp")).alias("t"))
    own = times.select(file("key", "chunk", "file").alias("_file"), F.col("t").cast("double").alias("t"))
    return joins.nearest(rows, own, "_file", "t", tolerance).select("episode_index", *rest, "index", "key", "valid")


def repaired(ds: TrajectoryDataset, times: DataFrame, tolerance: float) -> tuple[TrajectoryDataset, DataFrame]:
    """One row for each episode, the one that the videos bear out best, and its frames that have a video time.

    episodes may have several rows of an id, told apart by a column `row`. The row with the most frames near a video
    time is taken; then one that all frames fit, whose range is the frames', the smallest `row`. Times and slices
    start at the first frame that is left. Also: episode_index, row, n, valid (0: dropped) of every episode.
    """
    require_columns(ds.episodes, ["row", "dataset_from_index", "dataset_to_index"])
    cameras = video_keys(ds.episodes.columns)
    if not cameras:
        raise ValueError("episodes have no video slices")
    near = timed(ds.frames, ds.episodes, times, tolerance, ["row"]).groupBy("episode_index", "row", "index").agg(F.bool_and("valid").alias("valid"))
    score = near.groupBy("episode_index", "row").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.min("index").alias("low"), F.max("index").alias("high")
    )
    score = score.join(ds.episodes.select("episode_index", "row", "dataset_from_index", "dataset_to_index"), ["episode_index", "row"])
    fits = (F.col("low") == F.col("dataset_from_index")) & (F.col("high") + 1 == F.col("dataset_to_index"))
    order = [F.col("valid").desc(), (F.col("valid") == F.col("n")).desc(), fits.desc(), F.col("row")]
    best = trim.deduplicate(score, "episode_index", order).select("episode_index", "row", "n", "valid")
    kept = near.where("valid").join(best.select("episode_index", "row"), ["episode_index", "row"]).select("episode_index", "index")
    frames = trim.rebase(ds.frames.join(kept, ["episode_index", "index"]), tolerance)
    ends = frames.groupBy("episode_index").agg(F.max("shift").alias("_shift"), F.max("timestamp").alias("_last"))
    episodes = without_stats(ds.episodes).join(best.select("episode_index", "row"), ["episode_index", "row"]).join(ends, "episode_index")
    moved = {f"videos/{k}/from_timestamp": F.col(f"`videos/{k}/from_timestamp`") + F.col("_shift") for k in cameras}
    episodes = episodes.withColumns(moved)
    ends = {f"videos/{k}/to_timestamp": F.col(f"`videos/{k}/from_timestamp`") + F.col("_last") for k in cameras}
    episodes = episodes.withColumns(ends).drop("row", "_shift", "_last")
    out = regrown(ds, frames.select(*ds.frames.columns), episodes)
    own = {"data/chunk_index": F.lit(0).cast("long"), "data/file_index": F.col("episode_index")}
    return TrajectoryDataset(out.frames, out.episodes.withColumns(own), out.tasks, out.info), best


def authoritative_tasks(episodes: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary with the prompts that only episodes name, numbered on in the order of their first episode, and
    (episode_index, task_index) by the episodes' own prompt. An episode must have exactly one."""
    count = F.concat(F.lit("episodes must have one prompt, not "), F.coalesce(F.size("tasks"), F.lit(0)).cast("string"))
    name = F.when(F.size("tasks") == 1, F.get("tasks", F.lit(0))).otherwise(F.raise_error(count).cast("string"))
    named = episodes.select("episode_index", name.alias("task"))
    new = keys.first_seen(named.join(tasks.select("task"), "task", "left_anti"), "task", ["episode_index"], "_n")
    top = tasks.agg((F.coalesce(F.max("task_index"), F.lit(-1)) + 1).alias("_top"))
    added = new.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("task_index"), "task")  # one row
    every = tasks.select("task_index", "task").unionByName(added)
    return every, named.join(every, "task").select("episode_index", "task_index")


def retasked(ds: TrajectoryDataset) -> TrajectoryDataset:
    """Frames whose task_index follows the episodes' prompts."""
    tasks, mapping = authoritative_tasks(ds.episodes, ds.tasks)
    frames = ds.frames.drop("task_index").join(mapping, "episode_index").select(*ds.frames.columns)
    return TrajectoryDataset(frames, ds.episodes, tasks, ds.info).with_totals()


def negated_share(ds: TrajectoryDataset, share: float, seed: int = 42, allow_unchanged: bool = False) -> TrajectoryDataset:
    """Colour prompts of a seeded share of the episodes (one at least) made exclusions; the others keep theirs. The
    dictionary keeps its entries and gains the new ones behind them."""
    new = ds.tasks.withColumn("new", X.negated(F.col("task")))
    same = [] if allow_unchanged else [r[0] for r in new.where("new = task").select("task").limit(5).collect()]
    if same:
        raise ValueError(f"prompts without a match: {same}")
    fresh = keys.first_seen(new.join(ds.tasks.select(F.col("task").alias("new")), "new", "left_anti"), "new", ["task_index"], "_n")
    top = ds.tasks.agg((F.coalesce(F.max("task_index"), F.lit(-1)) + 1).alias("_top"))
    added = fresh.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).alias("task_index"), F.col("new").alias("task"))  # one row
    tasks = ds.tasks.select("task_index", "task").unionByName(added)
    remap = new.join(tasks.select(F.col("task").alias("new"), F.col("task_index").alias("_to")), "new").select("task_index", "_to")
    chosen = sample.fraction(ds.episodes.select("episode_index"), "episode_index", share, seed, least=1).withColumn("_hit", F.lit(True))
    frames = ds.frames.join(chosen, "episode_index", "left").join(remap, "task_index", "left")
    index = F.when(F.col("_hit"), F.coalesce("_to", "task_index")).otherwise(F.col("task_index"))
    frames = frames.select(*[index.alias(c) if c == "task_index" else F.col(f"`{c}`") for c in ds.frames.columns])
    words = new.agg(F.map_from_entries(F.collect_list(F.struct("task", "new"))).alias("_words"))  # an entry a prompt
    episodes = ds.episodes.join(chosen, "episode_index", "left").crossJoin(F.broadcast(words))
    said = F.when(F.col("_hit"), replace_values(F.col("tasks"), F.col("_words"))).otherwise(F.col("tasks"))
    return TrajectoryDataset(frames, episodes.withColumn("tasks", said).drop("_hit", "_words"), tasks, ds.info).with_totals()


def relabelled_and_merged(sources: list[TrajectoryDataset], rewrites: list, allow_unchanged: bool = False) -> TrajectoryDataset:
    """Each source with its prompts rewritten by its own function (Column to Column), then all as one dataset."""
    return edit.merge([edit.relabel(ds, f, allow_unchanged) for ds, f in zip(sources, rewrites, strict=True)])


def expanded_and_merged(sources: list[TrajectoryDataset], prompts: list) -> TrajectoryDataset:
    """Each source with an episode for each of its prompts (a function of the episode's first prompt to an array), then
    all as one dataset."""
    from ..plans.augment import expand_prompts

    parts = []
    for ds, own in zip(sources, prompts, strict=True):
        frames, episodes, tasks = expand_prompts(ds.frames, ds.episodes.withColumn("_said", own(F.get("tasks", F.lit(0)))), "_said")
        parts.append(TrajectoryDataset(frames, episodes, tasks, dict(ds.info)))
    return edit.merge(parts)


def colour_dataset(sources: list[TrajectoryDataset], colors: list[list[str]], seed: int = 42) -> TrajectoryDataset:
    """Ordinal prompts made colour prompts by each source's bowls, merged, and a seeded brightness level for every
    episode."""
    from ..plans.augment import brightness_levels

    rewrite = lambda own: lambda t: X.ordinal_to_color(t, [F.lit(c) for c in own])
    out = relabelled_and_merged(sources, [rewrite(own) for own in colors], allow_unchanged=True)
    return TrajectoryDataset(out.frames, brightness_levels(out.episodes, seed), out.tasks, out.info)


def sequential_files(episodes: DataFrame, prefix: str = "data/") -> DataFrame:
    """Episodes of several sources (column source) whose files are numbered on in order of source, chunk and file.

    There is one row a file where they are numbered, and episodes meet it again by (source, chunk, file).
    """
    chunk, file = f"{prefix}chunk_index", f"{prefix}file_index"
    files = episodes.select("source", F.col(f"`{chunk}`").alias("_c"), F.col(f"`{file}`").alias("_f")).distinct()
    files = files.withColumn("_new", (F.row_number().over(Window.orderBy("source", "_c", "_f")) - 1).cast("long"))
    rows = episodes.withColumns({"_c": F.col(f"`{chunk}`"), "_f": F.col(f"`{file}`")}).join(files, ["source", "_c", "_f"])
    return rows.withColumns({chunk: F.lit(0).cast("long"), file: F.col("_new")}).drop("_c", "_f", "_new").select(*episodes.columns)


def first_and_last(frames: DataFrame, columns: list[str], order: str = "index", episode: str = "episode_index") -> DataFrame:
    """Each episode's first and last value of the columns."""
    own = [f(F.col(c), F.col(order)).alias(f"{name}_{c}") for c in columns for name, f in (("first", F.min_by), ("last", F.max_by))]
    return frames.groupBy(episode).agg(*own)


def steadiest(frames: DataFrame, signal: str, scan: int = 15, order: str = "index", episode: str = "episode_index") -> DataFrame:
    """Of each episode's first `scan` frames, the one after which the signal changes least (the first of equal ones),
    and that change; the only frame of a short episode, without a change."""
    w = Window.partitionBy(episode).orderBy(order)
    change = F.abs(F.lead(signal).over(w) - F.col(signal))
    rows = frames.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(episode)), "change": change})
    seen = rows.where(F.col("_rn") < F.greatest(F.least(F.lit(scan), F.col("_n")) - 1, F.lit(1)))
    key = F.struct(F.coalesce("change", F.lit(float("inf"))).alias("c"), F.col("_rn").alias("rn"))
    return seen.groupBy(episode).agg(F.min_by(order, key).alias(order), F.min_by("_rn", key).cast("long").alias("frame_index"), F.min("change").alias("change"))


"""Readers and writers of the two on-disk layouts, of plans and of side files. Paths are whatever Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.values import suffixed_keys
from ..model import TrajectoryDataset, features_of, harmonised_stats, normalise_tasks, video_keys
from ..operators import keys
from ..storage import Scratch, write_text
from . import sink


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def files(spark: SparkSession, root: str, suffix: str = "") -> list[str]:
    """All files below a folder, sorted."""
    p, fs = _path(spark, root)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(x for x in out if x.endswith(suffix))


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_info(spark: SparkSession, root: str) -> dict:
    return json.loads(read_text(spark, f"{root}/meta/info.json"))


def version(spark: SparkSession, root: str) -> str:
    """2 keeps episodes as JSON lines, 3 as Parquet."""
    return "2" if exists(spark, f"{root}/meta/episodes.jsonl") else "3"


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def read_episodes(spark: SparkSession, root: str, last_wins: bool = False) -> DataFrame:
    """The episode table of either layout; none at all raises. `last_wins`: of several rows of an id, the one in the
    last file by name counts (rows of one file: any of them); else all are returned."""
    if version(spark, root) == "2":
        rows = spark.read.json(f"{root}/meta/episodes.jsonl")
    else:
        if not exists(spark, f"{root}/meta/episodes") or not files(spark, f"{root}/meta/episodes", ".parquet"):
            raise FileNotFoundError(f"no episodes below {root}/meta/episodes")
        rows = _parquet(spark, f"{root}/meta/episodes")
    if not last_wins:
        return rows
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    last = rows.withColumn("_file", F.col("_metadata.file_path")).groupBy("episode_index").agg(F.max_by(every, "_file").alias("_row"))
    return last.select("_row.*")


def read(spark: SparkSession, root: str, columns: list[str] | None = None) -> TrajectoryDataset:
    """A dataset of either layout; `columns` are the frame columns wanted, so that no other is read."""
    info = read_info(spark, root)
    if version(spark, root) == "2":
        tasks = spark.read.json(f"{root}/meta/tasks.jsonl").select("task_index", "task")
    else:
        tasks = normalise_tasks(spark.read.parquet(f"{root}/meta/tasks.parquet"))
    episodes = read_episodes(spark, root)
    try:
        frames = _parquet(spark, f"{root}/data")
    except AnalysisException as error:
        raise FileNotFoundError(f"no frames below {root}/data") from error
    if columns is not None:
        frames = frames.select(*[f"`{c}`" for c in columns])
    return TrajectoryDataset(frames, episodes, tasks, info)


def read_episode(spark: SparkSession, root: str, episode: int) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """One episode: its frames (in layout 2 only its file is opened, in layout 3 the filter reaches the scan), its
    prompts, and the path of each camera's video."""
    ds = read(spark, root)
    here = F.col("episode_index") == episode
    videos = {}
    if version(spark, root) == "2":
        chunk = episode // int(ds.info.get("chunks_size", 1000))
        frames = spark.read.parquet(f"{root}/data/chunk-{chunk:03d}/episode_{episode:06d}.parquet")
        videos = {k: f"{root}/videos/chunk-{chunk:03d}/{k}/episode_{episode:06d}.mp4" for k in features_of(ds.info, "video")}
    else:
        frames = ds.frames.where(here)
        row = ds.episodes.where(here).select(*[c for c in ds.episodes.columns if c.startswith("videos/")]).first()
        for key in video_keys(ds.episodes.columns) if row else []:
            chunk, file = (int(row[f"videos/{key}/{name}_index"]) for name in ("chunk", "file"))
            videos[key] = f"{root}/videos/{key}/chunk-{chunk:03d}/file-{file:03d}.mp4"
    return frames.orderBy("frame_index"), ds.episodes.where(here).select(F.explode("tasks").alias("task")), videos


def _placed(spark: SparkSession, parts: str, target, wanted: str) -> None:
    """Move the single data file of every folder below `parts` to target(folder names), and drop `parts`."""
    at, fs = _path(spark, parts)
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    for file in files(spark, parts, wanted):
        names = [x.split("=", 1)[-1] for x in file.removeprefix(base).split("/")[:-1]]
        to, _ = _path(spark, target(names))
        fs.mkdirs(to.getParent())
        fs.delete(to, False)
        if not fs.rename(_path(spark, file)[0], to):
            raise OSError(f"could not move {file}")
    fs.delete(at, True)


def write_grouped(rows: DataFrame, by: list[str], target, order: list[str], kind: str = "parquet") -> None:
    """One file for each combination of `by`, whose columns are not written, under the name that target(values) gives.

    Files are written by tasks and moved one by one: their number is the layout's, not the rows'.
    """
    spark, wanted = rows.sparkSession, {"parquet": ".parquet", "json": ".json"}[kind]
    parts = target(["_parts"] * len(by)) + ".parts"
    spread = rows.repartition(*by).sortWithinPartitions(*by, *order) if by else rows.coalesce(1)
    writer = spread.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(parts)
    _placed(spark, parts, target, wanted)
    above, fs = _path(spark, parts.rsplit("/", 1)[0])
    if above.getName() == "_parts":
        fs.delete(above, True)


def placed(ds: TrajectoryDataset, layout: str = "3", rows_per_file: int | None = None) -> DataFrame | None:
    """Frames with `_path`, the name of their file below data/. In layout 2 an episode has a file; in layout 3 files have
    `rows_per_file` rows each (the last one fewer), or are those that episodes name; None if they name none."""
    chunks = int(ds.info.get("chunks_size", 1000))
    named = lambda text, *n: F.format_string(text, *[x.cast("long") for x in n])
    if layout == "2":
        number = F.col("episode_index")
        return ds.frames.withColumn("_path", named("chunk-%03d/episode_%06d.parquet", F.floor(number / chunks), number))
    if rows_per_file:
        rows = keys.positions(ds.frames, F.floor(F.col("index") / keys.BUCKET), ["index"], "_place")
        number = F.floor(F.col("_place") / rows_per_file)
        return rows.withColumn("_path", named("chunk-%03d/file-%03d.parquet", F.floor(number / chunks), number % chunks)).drop("_place")
    if "data/file_index" not in ds.episodes.columns:
        return None
    own = ds.episodes.select("episode_index", named("chunk-%03d/file-%03d.parquet", F.col("`data/chunk_index`"), F.col("`data/file_index`")).alias("_path"))
    return ds.frames.join(own, "episode_index").select(*[F.col(f"`{c}`") for c in ds.frames.columns], "_path")


_ORDER = ["episode_index", "frame_index"]


def write(
    ds: TrajectoryDataset, root: str, layout: str = "3", overwrite: bool = False, rows_per_file: int | None = None, tasks_layout: str = "A"
) -> dict:
    """Write a dataset. Layout 2 has a file for each episode; of layout 3, see `placed`. Data files appear together,
    in the place of any old ones. The header as it was written, with totals.

    Episode rows go to the files that their meta/episodes columns name, to one if they name none. tasks_layout: "A" has
    columns task_index and task, "B" keeps prompts as the index column of a data frame.
    """
    spark = ds.frames.sparkSession
    if exists(spark, root) and not overwrite:
        raise FileExistsError(root)
    scratch = Scratch(spark)
    ds = _worked_out(ds, scratch)
    rows = placed(ds, layout, rows_per_file)
    if rows is None:
        ds.frames.repartitionByRange("episode_index").sortWithinPartitions(*_ORDER).write.mode("overwrite").parquet(f"{root}/data")
    else:
        sink.write_files(rows, f"{root}/data", "_path", _ORDER)
    info = write_meta(ds, root, layout, tasks_layout)
    scratch.drop("episodes", "tasks")
    return info


def _worked_out(ds: TrajectoryDataset, scratch: Scratch) -> TrajectoryDataset:
    """The dataset with episodes and prompts as tables, as a writer uses each several times: making them may take a pass
    over all frames."""
    return TrajectoryDataset(ds.frames, scratch.table(ds.episodes, "episodes"), scratch.table(ds.tasks, "tasks"), ds.info)


def write_meta(ds: TrajectoryDataset, root: str, layout: str = "3", tasks_layout: str = "A") -> dict:
    """Everything of a dataset but its frames. The header as it was written, with totals."""
    spark = ds.frames.sparkSession
    stale = ("meta/episodes", "meta/tasks.parquet") if layout == "2" else ("meta/episodes.jsonl", "meta/tasks.jsonl", "meta/tasks.parquet")
    for old in stale:
        path, fs = _path(spark, f"{root}/{old}")
        fs.delete(path, True)
    if layout == "2":
        write_text(spark, f"{root}/meta/tasks.jsonl", _lines(ds.tasks.orderBy("task_index")))
        write_grouped(ds.episodes.orderBy("episode_index"), [], lambda names: f"{root}/meta/episodes.jsonl", [], "json")
    else:
        text = "task" if tasks_layout == "A" else "__index_level_0__"
        ds.tasks.select("task_index", F.col("task").alias(text)).coalesce(1).write.mode("overwrite").parquet(f"{root}/meta/tasks.parquet")
        place = [f"meta/episodes/{x}_index" for x in ("chunk", "file")]
        rows = harmonised_stats(ds.episodes)
        number = [F.col(f"`{c}`").cast("long") if c in rows.columns else F.lit(0).cast("long") for c in place]
        rows = rows.withColumn("_path", F.format_string("chunk-%03d/file-%03d.parquet", *number))
        sink.write_files(rows, f"{root}/meta/episodes", "_path", ["episode_index"])
    info = ds.totals()
    write_text(spark, f"{root}/meta/info.json", json.dumps(info, indent=2, sort_keys=True))
    return info


def rewrite(ds: TrajectoryDataset, source: str, target: str) -> DataFrame:
    """Write an edited dataset of layout 3 of which `source` is the stored origin: only files whose rows have changed are
    written, all others are copied as they are. path, rows, changed of every data file.

    Files are compared by a digest of their rows, so an edit needn't say what it touched.
    """
    spark, scratch = ds.frames.sparkSession, Scratch(ds.frames.sparkSession)
    if exists(spark, target):
        raise FileExistsError(target)
    ds = _worked_out(ds, scratch)
    rows = placed(ds)
    if rows is None:
        raise ValueError("episodes don't name their data files")
    before = _parquet(spark, f"{source}/data")
    before = before.select("*", F.regexp_extract("_metadata.file_path", r"/data/((?:[^/]+/)?[^/]+)$", 1).alias("_path"))
    old = sink.digests(before, "_path").withColumnsRenamed({"rows": "_rows", "digest": "_digest"})
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("rows").eqNullSafe(F.col("_rows"))
    both = sink.digests(rows, "_path").join(old, "path", "left").select("path", "rows", (~same).alias("changed"))
    both = scratch.table(both, "files")
    staging = sink.staging_of(f"{target}/data")
    fresh = rows.join(both.where("changed").select(F.col("path").alias("_path")), "_path", "left_semi")
    sink.write_files(fresh, f"{target}/data", "_path", _ORDER, staging=staging)
    sink.copy_files(both.where("NOT changed"), f"{source}/data", staging)
    sink.published(staging, f"{target}/data")
    write_meta(ds, target)
    copy_siblings(spark, source, target)
    scratch.drop("episodes", "tasks")
    return both


def copy_siblings(spark: SparkSession, source: str, target: str, skip: tuple[str, ...] = ("data/", "meta/episodes", "meta/tasks", "meta/info.json")) -> list[str]:
    """Copy the files of a dataset that an edit doesn't rewrite, by tasks; the copied paths, relative to the dataset.
    Folders that `skip` names are not listed: they hold most of a dataset's files."""
    from pyarrow import fs

    system, base = sink.opened(source)
    done, folders = [], [base]
    while folders:
        for info in system.get_file_info(fs.FileSelector(folders.pop())):
            name = info.path.removeprefix(base.rstrip("/") + "/")
            if info.type == fs.FileType.Directory:
                folders += [] if f"{name}/".startswith(skip) else [info.path]
            elif not name.startswith(skip) and not (info.base_name.startswith(".") and info.base_name.endswith(".crc")):  # Hadoop's own
                done.append(name)
    if done:
        sink.copy_files(spark.createDataFrame([(x,) for x in done], "path string"), source, target)
    return sorted(done)


def write_card(ds: TrajectoryDataset, root: str, title: str, sources: list[str] | None = None, info: dict | None = None) -> None:
    """A dataset card: a head that tools read, the totals, and where the episodes come from. `info` is the header that
    `write` gave; without it, totals are counted again, which may take a pass over all frames."""
    info = ds.totals() if info is None else info
    head = ["---", "task_categories:", "- robotics", "configs:", "- config_name: default", "  data_files: data/*/*.parquet", "---", "", f"# {title}", ""]
    names = ["total_episodes", "total_frames", "total_tasks", "fps", "robot_type"]
    facts = [f"| {k} | {info[k]} |" for k in names if k in info]
    origin = ["", "Sources:", ""] + [f"- {s}" for s in sources] if sources else []
    write_text(ds.frames.sparkSession, f"{root}/README.md", "\n".join([*head, "| field | value |", "|-|-|", *facts, *origin]) + "\n")


def read_image_folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """label and its image paths in order: the label is the folder below `root`, one more level may lie between."""
    names = "|".join(suffixes)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = _path(spark, root)
    inner = F.substring(F.col("path"), len(base[1].makeQualified(base[0]).toString().rstrip("/")) + 2, 1 << 30)
    own = rows.where(F.col("path").rlike(rf"(?i)\.({names})$")).withColumn("inner", inner)
    own = own.where(F.size(F.split("inner", "/")).between(2, 3)).withColumn("label", F.split("inner", "/")[0])
    return own.groupBy("label").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def read_pose(spark: SparkSession, path: str, suffix: str = ".pos") -> dict[str, float] | None:
    """A start pose from JSON, {"joint": degrees}, with keys that all end in `suffix`; None if the file isn't there."""
    if not exists(spark, path):
        return None
    rows = spark.createDataFrame([(read_text(spark, path),)], "value string")
    pose = rows.select(suffixed_keys(F.from_json("value", "map<string, double>"), suffix).alias("pose")).first()["pose"]
    return pose


def write_names(df: DataFrame, path: str) -> None:
    """A name lookup as tab-separated lines without a head."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def _lines(small: DataFrame) -> str:
    """JSON lines of a table that holds one row a prompt."""
    return "".join(x + "\n" for x in small.toJSON().toLocalIterator())


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation table with an array in a CSV cell; paths are made relative to the file's folder."""
    base = path.rsplit("/", 1)[0]
    rows = spark.read.option("escape", '"').csv(path, header=True)
    place = F.when(F.col("scene_path").startswith("/"), F.col("scene_path")).otherwise(F.concat(F.lit(base + "/"), "scene_path"))
    return rows.withColumns({"scene_path": place, "all_celebrities": F.from_json("all_celebrities", "array<string>")})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON side file {"episodes": {"<id>": {...}}} as rows; no rows if it isn't there."""
    kind = "keep_full boolean, trim_start long, auto_trim_start long, original_length long, validated boolean"
    own = read_text(spark, path) if exists(spark, path) else '{"episodes": {}}'
    rows = spark.createDataFrame([(own,)], "value string")
    rows = rows.select(F.explode(F.from_json("value", f"episodes map<string, struct<{kind.replace(' ', ':').replace(',:', ',')}>>")["episodes"]))
    return rows.select(F.col("key").cast("long").alias("episode_index"), "value.*")


def write_cache(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Rows of episode_index and other columns as such a side file. It is one JSON object by its format, so rows pass
    the driver, a partition at a time, and only text is held."""
    names = [c for c in rows.columns if c != "episode_index"]
    entry = F.concat(F.to_json(F.create_map(F.col("episode_index").cast("string"), F.struct(*names))).substr(F.lit(2), F.lit(1 << 30)))
    entries = (r[0][:-1] for r in rows.select(entry).toLocalIterator())
    write_text(spark, path, '{"episodes": {' + ",\n".join(entries) + "}}")


def write_stats(spark: SparkSession, stats: DataFrame, feature: str, path: str) -> None:
    """Dataset statistics (one row a feature) as one JSON object."""
    rows = {r[feature]: {k: v for k, v in r.asDict(True).items() if k != feature} for r in stats.toLocalIterator()}
    write_text(spark, path, json.dumps(rows, indent=2, sort_keys=True))


def resolve(spark: SparkSession, source: str) -> str:
    """An existing path as it is; a bare name or owner/name is no local dataset."""
    if exists(spark, source):
        return source
    raise FileNotFoundError(f"{source}: only paths that Spark reads are sources here")

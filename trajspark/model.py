"""A dataset: lazy tables of frames, episodes and prompts, and a header."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TrajectoryDataset:
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    info: dict = field(default_factory=dict)

    def with_totals(self) -> TrajectoryDataset:
        """Totals and the training split follow the tables only when the header is asked for by `totals`."""
        return TrajectoryDataset(self.frames, self.episodes, self.tasks, {k: v for k, v in self.info.items() if not k.startswith("total_")})

    def totals(self) -> dict:
        """The header with totals counted from the tables: also videos (an episode and camera each) and chunks."""
        episodes, frames = self.episodes.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        tasks = self.tasks.count()
        cameras = len(video_keys(self.episodes.columns))
        chunks = max(1, -(-episodes // int(self.info.get("chunks_size", 1000))))
        own = {"total_episodes": episodes, "total_frames": int(frames), "total_tasks": tasks, "total_videos": episodes * cameras, "total_chunks": chunks}
        own["splits"] = {"train": f"0:{episodes}"}
        return self.info | own


def normalise_tasks(df: DataFrame) -> DataFrame:
    """(task_index, task) from a prompt table in any layout: a column task or tasks, an index column, or the first
    string column; without task_index, rows count in their stored order. Repeated ids raise when rows are read."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    named = [c for c in ("task", "tasks", "__index_level_0__") if c in strings]
    if not (named or strings):
        raise ValueError("no column of prompts")
    text = F.col(f"`{(named or strings)[0]}`").alias("task")
    if "task_index" not in df.columns:
        # Prompt tables hold a row a prompt, so one window over them stays small.
        return df.select(text, F.monotonically_increasing_id().alias("_i")).select(
            (F.row_number().over(Window.orderBy("_i")) - 1).cast("long").alias("task_index"), "task"
        )
    rows = df.select(F.col("task_index").cast("long").alias("task_index"), text)
    twice = F.count("*").over(Window.partitionBy("task_index")) > 1
    checked = F.when(twice, F.raise_error(F.lit("a task_index stands twice")).cast("long")).otherwise(F.col("task_index"))
    return rows.select(checked.alias("task_index"), "task")


def video_keys(columns: list[str]) -> list[str]:
    """Cameras that an episode table has time slices of, by its columns' names."""
    return [c.removeprefix("videos/").removesuffix("/from_timestamp") for c in columns if c.startswith("videos/") and c.endswith("/from_timestamp")]


def normalise_videos(episodes: DataFrame) -> DataFrame:
    """The slices of all cameras as one column videos: array<struct<key, chunk, file, from_ts, to_ts>>."""
    part = lambda key, name, kind: F.col(f"`videos/{key}/{name}`").cast(kind)
    slices = [
        F.struct(
            F.lit(key).alias("key"),
            part(key, "chunk_index", "long").alias("chunk"),
            part(key, "file_index", "long").alias("file"),
            part(key, "from_timestamp", "double").alias("from_ts"),
            part(key, "to_timestamp", "double").alias("to_ts"),
        )
        for key in video_keys(episodes.columns)
    ]
    empty = F.array().cast("array<struct<key:string,chunk:bigint,file:bigint,from_ts:double,to_ts:double>>")
    return episodes.withColumn("videos", F.array(*slices) if slices else empty)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def without_stats(episodes: DataFrame) -> DataFrame:
    return episodes.drop(*[c for c in episodes.columns if c.startswith("stats/")])


def harmonised_stats(episodes: DataFrame) -> DataFrame:
    """Every stats column as an array of doubles: scalars become arrays of one, NaN becomes null."""
    out = {}
    for f in episodes.schema:
        if f.name.startswith("stats/"):
            own = F.col(f"`{f.name}`")
            values = own.cast("array<double>") if isinstance(f.dataType, T.ArrayType) else F.array(own.cast("double"))
            out[f.name] = F.transform(values, lambda x: F.when(~F.isnan(x), x))
    return episodes.withColumns(out) if out else episodes


def features_of(info: dict, *kinds: str, but: tuple[str, ...] = ()) -> list[str]:
    """Names of a header's features of the given dtypes (any if none are given), without those of `but`, in order."""
    own = {k: v.get("dtype") for k, v in info.get("features", {}).items()}
    return [k for k, kind in own.items() if (not kinds or kind in kinds) and kind not in but]


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns (all if none are given) have values."""
    return df.dropna(subset=list(columns) or None)


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order that must decide: for reports and samples."""
    if not order:
        raise ValueError("say in what order")
    return df.orderBy(*order).limit(n)

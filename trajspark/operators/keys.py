"""Dense ids, prefix sums and dictionary encoding without a global sort of frames.

Positions over a whole table come in two levels: inside buckets of neighbouring keys, each a partition of its own
window, and over the buckets' sums, one row for BUCKET keys. So no task sees more than its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

#: Neighbouring integer keys of one bucket.
BUCKET = 4096


def frame_index(order, episode: str = "episode_index") -> Column:
    """0-based position of a frame in its episode."""
    keys = order if isinstance(order, (list, tuple)) else [order]
    return F.row_number().over(Window.partitionBy(episode).orderBy(*keys)) - 1


def prefixes(df: DataFrame, key: str, weights: dict[str, Column], bucket: int = BUCKET, levels: int = 2) -> DataFrame:
    """df with, for each name, the sum of its weight over all rows of smaller integer keys; keys are unique, and a null
    key raises.

    Two levels suit keys that are about dense: the upper one has a row for `bucket` keys. Keys that are spread over a
    far wider range (hashes, say) fill that many more buckets; each further level divides their number by `bucket`.
    """
    names, b = list(weights), f"_b{levels}"
    known = F.coalesce(F.floor(F.col(key) / bucket), F.raise_error(F.lit(f"{key} is null")).cast("long"))
    rows = df.withColumns({f"_w{levels}{i}": w for i, w in enumerate(weights.values())} | {b: known})
    sums = rows.groupBy(b).agg(*[F.sum(f"_w{levels}{i}").alias(f"_s{i}") for i in range(len(names))])
    if levels > 2:
        sums = prefixes(sums, b, {f"_base{levels}{i}": F.col(f"_s{i}") for i in range(len(names))}, bucket, levels - 1)
        sums = sums.drop(*[f"_s{i}" for i in range(len(names))])
    else:
        before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(b, *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_base{levels}{i}") for i in range(len(names))])
    inside = Window.partitionBy(b).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in{levels}{i}": F.coalesce(F.sum(f"_w{levels}{i}").over(inside), F.lit(0)) for i in range(len(names))})
    out = rows.join(sums, b).withColumns({name: F.col(f"_base{levels}{i}") + F.col(f"_in{levels}{i}") for i, name in enumerate(names)})
    return out.drop(b, *[f"_{part}{levels}{i}" for part in ("w", "in", "base") for i in range(len(names))])


def positions(df: DataFrame, bucket: Column, order: list, into: str, by: list[str] | None = None) -> DataFrame:
    """df with each row's 0-based place in (bucket, order), over all rows or within each group of `by`.

    `bucket` must grow with `order`. Places are counted inside buckets and over the buckets' sizes, so no task holds
    more than a bucket, or the sizes of one group's buckets.
    """
    by = by or []
    rows = df.withColumn("_b", bucket)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_b").alias("_of_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1)
    same = F.col("_b") == F.col("_of_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(sizes, same).select(*df.columns, (F.col("_base") + F.col("_in")).alias(into))


def ranked(df: DataFrame, order: list[Column], into: str, scratch: Scratch, name: str, by: list[str] | None = None) -> DataFrame:
    """df with each row's 0-based place in an order of any orderable columns, over all rows or in each group of `by`.

    Rows are range-partitioned by (by, order), and places are counted inside ranges and over the ranges' sizes. Ranges
    are drawn from a sample, so the partitioned rows are written once as table `name` and both steps read that. Rows
    that are equal in the whole order share a range; give the order a column that tells them apart.
    """
    rows = df.repartitionByRange(*(by or []), *order).withColumn("_range", F.spark_partition_id())
    return positions(scratch.table(rows, name), F.col("_range"), order, into, by).drop("_range")


def prefix(df: DataFrame, key: str, weight: Column, into: str, bucket: int = BUCKET) -> DataFrame:
    return prefixes(df, key, {into: weight}, bucket)


def episode_spans(frames: DataFrame, episode: str = "episode_index") -> DataFrame:
    """Per episode: length, its dense new id, and its range of new frame ids [from, to)."""
    lengths = frames.groupBy(episode).agg(F.count("*").alias("length"))
    out = prefixes(lengths, episode, {"new_episode": F.lit(1).cast("long"), "dataset_from_index": F.col("length")})
    return out.withColumn("dataset_to_index", F.col("dataset_from_index") + F.col("length"))


def reindex(frames: DataFrame, order="index", episode: str = "episode_index") -> DataFrame:
    """Frames with dense episode, frame and global ids, in (episode, order) order. A null episode raises."""
    from .scans import number, scan

    spans = episode_spans(frames, episode).select(episode, "new_episode", "dataset_from_index")
    rows = scan(frames, episode, order, {"frame_index": number()}).join(spans, episode)
    return rows.withColumn("new_index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index")


def first_seen(values: DataFrame, value: str, order: list[str], into: str) -> DataFrame:
    """A dictionary: distinct values numbered from 0 in the order of their first row, then of values. `order` ends in
    a number; values are numbered in buckets of its neighbours, as a dictionary may grow with the data."""
    first = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    last = F.coalesce(F.floor(F.col("_first")[order[-1]] / BUCKET), F.lit(-(1 << 60)).cast("long"))
    bucket = F.struct(*[F.col("_first")[c].alias(c) for c in order[:-1]], last.alias("_last"))
    return positions(first, bucket, ["_first", value], into).withColumn(into, F.col(into).cast("long")).drop("_first")

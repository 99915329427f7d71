"""Quantiles that merge: a KLL sketch kept beside each part's statistics, so that a whole is never scanned for them.

A dataset's statistics come from those of its episodes, and a merged dataset's from those of its sources. Weighted means
of quantiles (`stats.merged`) are not quantiles of the whole; sketches give values whose rank is off by a known share.
A sketch has some K numbers, whatever a part's size, is built in map tasks, and merges in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import QUANTILES

#: Numbers of a sketch's largest level.
K = 1024


def rank_error(k: int = K) -> float:
    """The share of rows by which the rank of any one quantile is off, at 99 %; the constants are those that the
    sketch's library publishes."""
    return 2.296 / k**0.9723


def _plain(value: str) -> Column:
    x = F.col(f"`{value}`").cast("double")
    return F.when(~F.isnan(x), x)


def sketched(frames: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """count, min, max, mean, std and sketch of a value by group. Nulls and NaN don't count; a group of nothing else
    has count 0 and nulls."""
    x = F.col("_x")
    rows = frames.select(*[F.col(f"`{c}`") for c in by], _plain(value).alias("_x"))
    sketch = F.kll_sketch_agg_double(x, k)
    return rows.groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.when(F.count(x) > 0, sketch).alias("sketch"),
    )


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Statistics and sketches of parts (as `sketched` returns them) as those of the groups of `by`; no frame is read.

    Parts of count 0 add nothing. Spreads are added as sums of squares about the parts' own means and of the means
    about their mean, which loses no digits to large values."""
    own = parts.withColumns({"_n": F.when(F.col("count") > 0, F.col("count")), "_by": F.struct(*by, F.lit(0))})
    n, mean = F.col("_n"), F.col("mean")
    first = own.groupBy("_by").agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(n * mean) / F.sum(n)).alias("mean"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )
    whole = first.select("_by", F.col("mean").alias("_whole"))
    gap = mean - F.col("_whole")
    spread = own.join(whole, "_by").groupBy("_by").agg(F.sqrt(F.sum(n * (F.col("std") * F.col("std") + gap * gap)) / F.sum(n)).alias("std"))
    out = first.join(spread, "_by")
    known = F.when(F.col("count") > 0, F.col("sketch"))
    return out.select(*[F.col("_by")[c].alias(c) for c in by], "count", "min", "max", "mean", "std", known.alias("sketch"))


def quantiles(stats: DataFrame) -> DataFrame:
    """stats with a column for each of QUANTILES in place of the sketch; null where nothing counted."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, QUANTILES.values())))
    rows = stats.withColumn("_q", F.when(F.col("sketch").isNotNull(), at))
    return rows.select(*[c for c in stats.columns if c != "sketch"], *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(QUANTILES)])


def rank_gaps(frames: DataFrame, value: str, stats: DataFrame, by: list[str]) -> DataFrame:
    """By group, how far the ranks of its quantiles are from what they should be, as a share of its rows: 0 where the
    right rank is among those of rows equal to the quantile. A row of frames meets one row of stats and counts in map tasks."""
    names = list(QUANTILES)
    known = stats.select(F.struct(*by, F.lit(0)).alias("_of"), F.array(*names).alias("_q"))
    rows = frames.select(F.struct(*by, F.lit(0)).alias("_group"), *by, _plain(value).alias("_x")).where("_x IS NOT NULL")
    met = rows.join(known, F.col("_group") == F.col("_of"))
    x, q = F.col("_x"), lambda i: F.col("_q")[i]
    counts = [c for i in range(len(names)) for c in (F.count_if(x < q(i)).alias(f"_b{i}"), F.count_if(x <= q(i)).alias(f"_u{i}"))]
    out = met.groupBy(*by).agg(F.count("*").alias("_n"), *counts)
    gap = lambda i, p: F.greatest(F.col(f"_b{i}") / F.col("_n") - p, p - F.col(f"_u{i}") / F.col("_n"), F.lit(0.0))
    return out.select(*by, F.greatest(*[gap(i, F.lit(p)) for i, p in enumerate(QUANTILES.values())]).alias("gap"))

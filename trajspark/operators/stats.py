"""Statistics of scalar and vector features: exact, merged from parts, or updated without a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of every feature.
QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}


def measures(value: Column) -> list[Column]:
    """min, max, mean, population std, count, and linearly interpolated quantiles."""
    named = {"min": F.min(value), "max": F.max(value), "mean": F.avg(value), "std": F.stddev_pop(value), "count": F.count(value)}
    quantiles = F.percentile(value, F.array(*map(F.lit, QUANTILES.values())))
    return [c.alias(k) for k, c in named.items()] + [quantiles.alias("quantiles")]


def spread_quantiles(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col("quantiles")[i].alias(k) for i, k in enumerate(QUANTILES)]).drop("quantiles")


def scalar_stats(frames: DataFrame, value: str, by: list[str], order: str | None = None) -> DataFrame:
    """Statistics by group. With groups (episodes, say, which a recording bounds) one buffer holds the distinct values
    of a group; over the whole table `ranked_stats` counts ranks instead. With `order`, a group's values are added up in
    it: a mean that is a tie to be rounded then falls the same way in every run, and as in a loop over the frames."""
    if not by:
        return ranked_stats(frames.select(F.col(value).cast("double").alias("x")), [])
    if order is None:
        return spread_quantiles(frames.groupBy(*by).agg(*measures(F.col(value))))
    whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = frames.select(*by, F.col(value).cast("double").alias("_x"), F.sum(F.col(value).cast("double")).over(whole).alias("_total"))
    out = rows.groupBy(*by).agg(*measures(F.col("_x")), F.first("_total").alias("_total"))
    out = out.withColumn("mean", F.when(F.col("count") > 0, F.col("_total") / F.col("count"))).drop("_total")
    return spread_quantiles(out)


def vector_stats(frames: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """One row for each dimension of each group. Where a count shows that no group has more vectors than a sketch would
    hold, buffers are bounded and one pass does; else values are ranked. Both are exact."""
    rows = frames.select(*by, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    largest = frames.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    if largest <= ACCURACY:
        return spread_quantiles(rows.groupBy(*by, "dim").agg(*measures(F.col("x"))))
    return ranked_stats(rows, [*by, "dim"])


#: Rank error of the sketches that find a quantile's surroundings, as one over this; smaller groups are counted whole.
ACCURACY = 20_000


def ranked_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Exact statistics of x by group without a buffer of its values, whatever the group's size.

    A sketch gives two values that enclose each quantile's rank. Rows below are counted, the few between are counted
    by value and ranked, and the two values next to the rank are interpolated.
    """
    levels, margin = list(QUANTILES.values()), 4 / ACCURACY
    ends = [min(1.0, max(0.0, q + side)) for q in levels for side in (-margin, margin)]
    x, n = F.col("x"), F.col("count")
    basic = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_pop(x), "count": F.count(x)}
    sketch = F.percentile_approx("x", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_ends")
    whole = rows.groupBy(*by).agg(*[c.alias(k) for k, c in basic.items()], sketch)

    end = lambda i, low, high: F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"))
    each = F.array(*[end(i, F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]) for i in range(len(levels))])
    # One ranking serves all quantiles of a smaller group.
    near = F.when(n < ACCURACY, F.array(end(-1, F.col("min"), F.col("max")))).otherwise(each)
    near = whole.select(*[F.col(c).alias(f"_of_{c}") for c in by], near.alias("_near"))
    values = rows.where(x.isNotNull())
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        values = values.join(near, same)
    else:
        values = values.crossJoin(F.broadcast(near))  # one row
    # Below the enclosed values only their number counts: map-side they are one row for each quantile.
    spread = values.select(*by, "x", F.explode("_near").alias("e")).where("x <= e.high")
    inside = F.when(F.col("x") >= F.col("e.low"), F.col("x"))
    counted = spread.groupBy(*by, F.col("e.i").alias("i"), inside.alias("v")).agg(F.count("*").alias("c"))
    last = F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("last", last).where(F.col("v").isNotNull())
    sizes = whole.drop("_ends")
    ranked = ranked.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = sizes.join(ranked, same, "left") if by else sizes.join(ranked, how="left", on=F.lit(True))
    at = lambda rank: (F.col("last") - F.col("c") <= rank) & (rank < F.col("last"))
    place = [F.lit(q) * (n - 1) for q in levels]
    pick = lambda i, rank: F.max(F.when(F.col("i").isin(i, -1) & at(rank), F.col("v")))
    out = joined.groupBy(*by, *basic).agg(
        *[c for i, p in enumerate(place) for c in (pick(i, F.floor(p)).alias(f"_l{i}"), pick(i, F.ceil(p)).alias(f"_h{i}"))]
    )
    value = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (place[i] - F.floor(place[i]))
    return out.select(*by, *basic, *[value(i).alias(name) for i, name in enumerate(QUANTILES)])


def as_arrays(stats: DataFrame, by: list[str]) -> DataFrame:
    """Rows of dimensions back to one row of arrays."""
    names = ["min", "max", "mean", "std", "count", *QUANTILES]
    own = F.sort_array(F.collect_list(F.struct("dim", *names)))
    rows = stats.groupBy(*by).agg(own.alias("s")) if by else stats.agg(own.alias("s"))
    return rows.select(*by, *[F.col("s")[n].alias(n) for n in names])


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of parts as one: quantiles are count-weighted means of the parts' quantiles, the rest is exact."""
    n, mean = F.col("count"), F.col("mean")
    first = parts.groupBy(*(by or [])).agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum(n * mean) / F.sum(n)).alias("mean"),
        F.sum(n * (F.col("std") * F.col("std") + mean * mean)).alias("_square"),
        F.sum(n).alias("count"),
        *[(F.sum(n * F.col(q)) / F.sum(n)).alias(q) for q in QUANTILES],
    )
    variance = F.col("_square") / F.col("count") - F.col("mean") * F.col("mean")
    return first.withColumn("std", F.sqrt(F.greatest(variance, F.lit(0.0)))).drop("_square")


def moments(frames: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sums, extremes, mean and std from one pass of sums, as a stream would keep them."""
    x = F.col(value)
    out = frames.groupBy(*by).agg(
        F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")
    )
    mean = F.col("total") / F.col("n")
    return out.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("total_sq") / F.col("n") - mean * mean, F.lit(0.0)))})


def shifted(stats: DataFrame, offset: Column) -> DataFrame:
    """Statistics of a feature that moved by an offset: places move, spread and count stay."""
    return stats.withColumns({k: F.col(k) + offset for k in ("min", "max", "mean", *QUANTILES)})


def constant(value: Column, count: Column) -> list[Column]:
    """Statistics of a feature that is the same in every row."""
    return [value.alias(k) for k in ("min", "max", "mean", *QUANTILES)] + [F.lit(0.0).alias("std"), count.alias("count")]

"""Lookups of whole numbers in ranges of any lengths, nested and overlapping ones too.

A range is at most two aligned cells a level (ids that agree above their lowest `level` bits), so all ranges together are
a dictionary of cells, each with what its ranges come to: no range is spread over its ids, and no cell lists its ranges.
What holds an id can change only at a range's first id and behind its last, so the cells are asked there, one a
level, and at the start of each chunk of WIDTH ids that has points. In a chunk, a window then hands the answer of the last
such edge on to the points. A chunk has WIDTH distinct points and WIDTH edges at most, so no task depends on how many
rows share an id, how long ranges are or how many of them hold one id; points are not multiplied by levels.

As in `scans`, where Spark estimates the points at `scans.SMALL` bytes at most, a window by group does without chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

#: Ids of one chunk, as a power of two.
WIDTH_BITS = 12


def _above(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def cells(low: Column, high: Column) -> Column:
    """The aligned cells (level, cell) that together are the ids from low to high, both long and low <= high."""
    end = high + 1
    top = F.length(F.bin(end - low)) - 1

    def of_level(level: Column) -> Column:
        first, last = -_above(-low, level), _above(end, level)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        cell = lambda taken, at: F.when((first < last) & taken, F.struct(level.alias("level"), at.alias("cell")))
        return F.array(cell(odd(first), first), cell(odd(last), last - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), of_level)), lambda c: c.isNotNull())


def first_cover(points: DataFrame, at: str, ranges: DataFrame, by: list[str] | None = None, value: str = "file", count: str | None = None) -> DataFrame:
    """points with the smallest `value` of the ranges (start, end, both included) that hold `at`, null if none does, and,
    under the name `count` if one is given, the number of those ranges.

    `at`, start and end are whole numbers between -2**62 and 2**62. With `by`, points meet the ranges of their own group
    only; null is a group like others. A range without a start or an end, or that ends before it starts, holds nothing;
    a null value counts, but is never the smallest. Points whose `at` is null are kept, held by none; repeated points stay
    repeated. `ranges` is read three times and `points` twice.
    """
    by = list(by or [])
    new = [value, *([count] if count else [])]
    if set(new) & set(points.columns):
        raise ValueError(f"points have a column named {sorted(set(new) & set(points.columns))}")
    group = lambda: F.struct(F.lit(0).alias("g"), *[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)])
    own = ranges.select(group().alias("group"), F.col("start").cast("long").alias("low"), F.col("end").cast("long").alias("high"), F.col(f"`{value}`").alias("value"))
    own = own.where("low <= high")
    longest = own.agg(F.max(F.col("high") - F.col("low") + 1)).head()[0]
    n_of = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    if longest is None:
        nothing = F.lit(None).cast(ranges.schema[value].dataType)
        return points.select("*", nothing.alias(value), *([n_of(F.lit(None)).alias(count)] if count else []))

    filled = own.select("group", "value", F.explode(cells(F.col("low"), F.col("high"))).alias("c"))
    filled = filled.groupBy("group", "c.level", "c.cell").agg(F.min("value").alias("value"), F.count("*").alias("n"))

    chunk = lambda x: F.shiftright(x, WIDTH_BITS)
    keyed = points.select(group().alias("group"), F.col(f"`{at}`").cast("long").alias("at"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row"))
    small = scans.estimated_bytes(points) <= scans.SMALL
    ids = keyed if small else keyed.where("at IS NOT NULL").select("group", "at").distinct()
    edges = own.select("group", F.explode(F.array("low", F.col("high") + 1)).alias("at"))
    if not small:
        edges = edges.unionByName(ids.select("group", F.shiftleft(chunk(F.col("at")), WIDTH_BITS).alias("at")))
    asked = edges.distinct().select("group", "at", F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))).alias("level"))
    asked = asked.withColumn("cell", _above(F.col("at"), F.col("level")))
    said = asked.join(filled, ["group", "level", "cell"], "left").groupBy("group", "at").agg(F.min("value").alias("value"), F.sum("n").alias("n"))

    both = said.select("group", "at", F.struct("value", "n").alias("held"), F.lit(False).alias("is_point"))
    both = both.unionByName(ids.withColumn("is_point", F.lit(True)), allowMissingColumns=True)
    window = Window.partitionBy("group") if small else Window.partitionBy("group", chunk(F.col("at")))
    last = window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("held", F.last("held", ignorenulls=True).over(last)).where("is_point")
    if not small:
        found = out.select(F.col("group").alias("_group"), F.col("at").alias("_at"), "held")
        out = keyed.join(found, (F.col("group") == F.col("_group")) & (F.col("at") == F.col("_at")), "left")
    row, held = F.col("row"), F.col("held")
    return out.select(*[row[c].alias(c) for c in points.columns], held["value"].alias(value), *([n_of(held["n"]).alias(count)] if count else []))

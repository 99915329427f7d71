"""Ordered scans inside groups of any size: the row before, running sums, last and next known values.

An episode is cut into chunks of neighbouring order keys. Each chunk is a partition of a window of its own, and gives a
summary (its number of rows, sum, last value); summaries, one row for WIDTH keys, are passed on from chunk to chunk
in a second, small window and come back in a join on the chunk, which the frames are already partitioned by. So no task
has more frames than a chunk, an episode that holds most rows is as many chunks as any other rows, and frames move once.

Where Spark's estimate of all rows' size is at most SMALL, no group can be larger, and one window by group does without
chunks and summaries; the results are the same. An estimate counts files as they lie, so what a task then holds is some
times SMALL at most. (Spark's estimate of a join is a product, so what comes from joins is mostly cut into chunks.)

Groups may be null: rows of a null group are one group. The order key must be a number; it needn't be dense. Rows
whose key is null come first, in one chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Neighbouring order keys of one chunk.
WIDTH = 4096

#: Estimated bytes of all rows up to which groups are not cut into chunks.
SMALL = 64 << 20


@dataclass(frozen=True)
class Scan:
    """What a row gets from its own chunk, what a chunk says of itself, what a chunk gets from those before (or
    behind), both together, and what the first chunk gets."""

    inside: Callable[[WindowSpec, WindowSpec], Column]
    summary: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec, WindowSpec], Column]
    both: Callable[[Column, Column], Column]
    start: int | None = None


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rangeBetween(Window.unboundedPreceding, Window.currentRow)


def before(value: Column) -> Scan:
    """The value, null or not, of the row before; null for the first row."""
    held = F.struct(value.alias("v"))
    return Scan(
        lambda up, _: F.lag(held).over(up),
        lambda at: F.max_by(value, at),
        lambda s, up, _: F.lag(s).over(up),
        lambda own, carried: F.when(own.isNull(), carried).otherwise(own["v"]),
    )


def sum_before(value: Column) -> Scan:
    """The sum over all rows before; 0 for the first."""
    return Scan(
        lambda up, _: F.coalesce(F.sum(value).over(_earlier(up)), F.lit(0)),
        lambda at: F.sum(value),
        lambda s, up, _: F.coalesce(F.sum(s).over(_earlier(up)), F.lit(0)),
        lambda own, carried: own + carried,
        0,
    )


def number() -> Scan:
    """The 0-based place of a row in its group."""
    return Scan(
        lambda up, _: (F.row_number().over(up) - 1).cast("long"),
        lambda at: F.count(F.lit(1)),
        lambda s, up, _: F.coalesce(F.sum(s).over(_earlier(up)), F.lit(0)),
        lambda own, carried: own + carried,
        0,
    )


def latest(value: Column) -> Scan:
    """The last value that isn't null among the rows up to this one and its equals; null if there is none."""
    return Scan(
        lambda up, _: F.last(value, ignorenulls=True).over(_upto(up)),
        lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda s, up, _: F.last(s, ignorenulls=True).over(_earlier(up)),
        F.coalesce,
    )


def upcoming(value: Column) -> Scan:
    """The first value that isn't null among this row, its equals and those behind."""
    return Scan(
        lambda _, down: F.last(value, ignorenulls=True).over(_upto(down)),
        lambda at: F.min_by(value, F.when(value.isNotNull(), at)),
        lambda s, _, down: F.last(s, ignorenulls=True).over(_earlier(down)),
        F.coalesce,
    )


def estimated_bytes(rows: DataFrame) -> int:
    """The size that Spark's optimizer expects rows to have; no job is run."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scan(rows: DataFrame, by: str | list[str], order: str | list[str], scans: dict[str, Scan], width: float = WIDTH, small: int | None = None) -> DataFrame:
    """rows with a column for each scan, in `order` (a number, then ties) inside the groups of `by`. `small` stands for
    SMALL; 0 always cuts groups into chunks."""
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    if estimated_bytes(rows) <= (SMALL if small is None else small):
        up, down = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(F.col(order[0]).desc())
        every = {name: s.both(s.inside(up, down), F.lit(s.start)) for name, s in scans.items()}
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in every], *[c.alias(n) for n, c in every.items()])
    least = F.lit(-(1 << 60)).cast("long")
    chunk = F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), least)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], chunk.alias("chunk"))
    keyed = rows.withColumn("_key", key)
    at = F.coalesce(F.col(order[0]), least) if len(order) == 1 else F.struct(*order)
    up, down = Window.partitionBy("_key").orderBy(*order), Window.partitionBy("_key").orderBy(F.col(order[0]).desc())
    own = keyed.withColumns({f"_own{i}": s.inside(up, down) for i, s in enumerate(scans.values())})

    said = keyed.groupBy("_key").agg(*[s.summary(at).alias(f"_s{i}") for i, s in enumerate(scans.values())])
    groups = [F.col("_key")[f"k{i}"] for i in range(len(by))]
    up, down = (Window.partitionBy(*groups).orderBy(c) for c in (F.col("_key")["chunk"], F.col("_key")["chunk"].desc()))
    said = said.select("_key", *[s.carried(F.col(f"_s{i}"), up, down).alias(f"_carried{i}") for i, s in enumerate(scans.values())])
    both = {name: s.both(F.col(f"_own{i}"), F.col(f"_carried{i}")) for i, (name, s) in enumerate(scans.items())}
    return own.join(said, "_key").select(*[F.col(f"`{c}`") for c in rows.columns if c not in both], *[c.alias(n) for n, c in both.items()])

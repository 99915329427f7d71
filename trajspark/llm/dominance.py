"""Dominance counting: for each point, how many points stand at a smaller slot and a strictly higher level.

Points are summed by (level, slot) first, so a hot pair is one cell. Cells are range-partitioned by descending level,
of equal levels by descending slot, so a level of any size may span partitions: what comes before a cell at its own level
is at no smaller slot and can't count. A partition is swept in that order with a Fenwick tree over its slots; cells of
one level are asked before they are inserted. What all earlier, that is higher, partitions add is their cumulative
slot histogram: (partition, slot) sums are themselves range-partitioned, by ascending slot, and swept with a tree over
partitions; what earlier slot ranges add comes from the grid of (partition, range) sums, whose size is that of the
layout and which is summed along both sides by windows. No step has the histogram of all slots, or all of anything
but a few numbers of the layout, in one task, on the driver or in a broadcast.

Points with a null slot or level stand above none, none stands above them, and their sums are null. Equal points have
equal sums and don't count each other, so repeated rows count for others as often as they are there. A null weight
counts as 0. An empty table gives an empty one. The keys that are asked for come back; other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Cells that are compared with each other directly before they enter the tree together.
CHUNK = 256

_P = "_dom_"


class Fenwick:
    """Prefix sums of several weights over places, asked and updated for whole arrays of places."""

    def __init__(self, places: int, weights: int):
        self.size = places
        self.sums = np.zeros((places + 1, weights), np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Sums over places smaller than each of `at`."""
        out, at = np.zeros((len(at), self.sums.shape[1]), np.int64), at.copy()
        while at.any():
            out += self.sums[at]  # place 0 of the tree stays empty
            at &= at - 1
        return out

    def add(self, at: np.ndarray, weights: np.ndarray) -> None:
        at = at + 1
        while len(at):
            np.add.at(self.sums, at, weights)
            at = at + (at & -at)
            inside = at <= self.size
            at, weights = at[inside], weights[inside]


def sweep(rank: np.ndarray, place: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row, the weights of rows with a smaller rank and a smaller place. Rows come by ascending rank.

    Rows go through the tree in chunks. In a chunk they are compared directly, by strict rank and place, so those of
    an equal rank never count each other, wherever chunks begin: a rank that spans chunks must come by descending place.
    """
    known, at = np.unique(place, return_inverse=True)
    tree, out = Fenwick(len(known), weights.shape[1]), np.empty_like(weights)
    for i in range(0, len(rank), CHUNK):
        r, a, w = rank[i : i + CHUNK], at[i : i + CHUNK], weights[i : i + CHUNK]
        above = (r[:, None] > r) & (a[:, None] > a)
        out[i : i + CHUNK] = tree.before(a) + above @ w
        tree.add(a, w)
    return out


def _swept(rows: DataFrame, rank: str, place: str, weights: list[str], into: list[str], part: str) -> DataFrame:
    """rows, which are partitioned and sorted by (rank, place descending), with the sums of each partition's sweep and
    the partition's number."""
    ship(rows.sparkSession)
    names = rows.columns
    kinds = ", ".join([f"`{n}` {k}" for n, k in rows.dtypes] + [f"`{n}` long" for n in into])
    numbered = rows.withColumn(part, F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        own = lambda name: table.column(name).to_numpy().astype(np.int64)
        sums = sweep(own(rank), own(place), np.stack([own(w) for w in weights], 1))
        for k, name in enumerate(into):
            table = table.append_column(name, pa.array(sums[:, k]))
        yield from table.select([*names, *into, part]).to_batches(max_chunksize=1 << 16)

    return numbered.mapInArrow(run, f"{kinds}, `{part}` int")


def dominated(cells: DataFrame, weights: list[str], scratch: Scratch) -> DataFrame:
    """cells (level, slot, weights; one row a pair, all long) with, for each weight, its sum over the cells at a
    smaller slot and a strictly higher level, as above_<weight>."""
    rank, part, span = _P + "rank", _P + "part", _P + "span"
    inside, across = [_P + f"in{i}" for i in range(len(weights))], [_P + f"over{i}" for i in range(len(weights))]
    # Sweeping costs more than its bytes tell, so ranges are as many as the session's shuffle partitions, never merged.
    ranges = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(rank), F.col("slot").desc()]
    rows = cells.select(*["level", "slot", *weights], (-F.col("level")).alias(rank)).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = scratch.table(_swept(rows, rank, "slot", weights, inside, part), "swept_levels")

    histogram = rows.groupBy("slot", part).agg(*[F.sum(w).alias(w) for w in weights])
    order = [F.col("slot"), F.col(part).desc()]
    spans = histogram.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    spans = scratch.table(_swept(spans, "slot", part, weights, across, span), "swept_slots")

    # Sums over earlier partitions and earlier ranges: along the partitions first, then along the ranges.
    last = spans.agg(F.max(part), F.max(span)).head()
    grid = spans.groupBy(part, span).agg(*[F.sum(w).alias(w) for w in weights])
    every = spans.sparkSession.range((last[1] if last[1] is not None else -1) + 1).select(F.col("id").cast("int").alias(span))
    every = every.select(span, F.explode(F.sequence(F.lit(0), F.lit(last[0] or 0))).alias(part))
    before = lambda by, order, w: F.coalesce(F.sum(w).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = every.join(grid, [part, span], "left")
    for by, along in ((span, part), (part, span)):
        grid = grid.select(part, span, *[before(by, along, w).alias(w) for w in weights])
    higher = spans.drop(*weights).join(grid, [part, span])
    higher = higher.select("slot", part, *[(F.col(a) + F.col(w)).alias(a) for a, w in zip(across, weights, strict=True)])
    out = rows.join(higher, ["slot", part])
    return out.select("level", "slot", *weights, *[(F.col(i) + F.col(a)).alias(f"above_{w}") for i, a, w in zip(inside, across, weights, strict=True)])


def count_above(points: DataFrame, keys: list[str], level: Column, slot: Column, weights: dict[str, Column], scratch: Scratch) -> DataFrame:
    """keys, `slot`, `level` (long) and, for each name, the sum of its weight over the points above, of every point.

    Points meet their cell's sums in a join on the pair, whose hot pairs Spark splits; points without a pair are
    spread over the join by a hash.
    """
    if {"slot", "level", *weights} & set(keys):
        raise ValueError("a key has the name of a result")
    names = [_P + f"w{i}" for i in range(len(weights))]
    own = [F.coalesce(w, F.lit(0)).cast("long").alias(n) for w, n in zip(weights.values(), names, strict=True)]
    rows = points.select(*keys, slot.cast("long").alias("slot"), level.cast("long").alias("level"), *own)
    lacks = F.col("slot").isNull() | F.col("level").isNull()
    cells = rows.where(~lacks).groupBy("level", "slot").agg(*[F.sum(n).alias(n) for n in names])
    found = dominated(cells, names, scratch).withColumn(_P + "none", F.lit(0))
    found = scratch.table(found.drop(*names).withColumnsRenamed({"level": _P + "level", "slot": _P + "slot"}), "cells")
    rows = rows.withColumn(_P + "at", F.when(lacks, F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("int") + 1).otherwise(0))
    same = [F.col(a) == F.col(_P + b) for a, b in (("level", "level"), ("slot", "slot"), (_P + "at", "none"))]
    out = rows.join(found, same, "left")
    return out.select(*keys, "slot", "level", *[F.col(f"above_{n}").alias(name) for n, name in zip(names, weights, strict=True)])


def utc_days(at: Column, kind: str) -> Column:
    """Whole days since 1970 in UTC of a timestamp with or without a zone, in any session zone."""
    if kind == "timestamp_ntz":
        return F.unix_date(at.cast("date")).cast("long")
    return F.floor(F.unix_seconds(at) / 86400)


def price_level(total: Column) -> Column:
    """floor(floor(100 x + 0.5) / 1000) in doubles; null where x is null, no number, or too large for a long."""
    cents = total.cast("double") * 100 + 0.5
    inside = ~F.isnan(cents) & (F.abs(cents) < 9.0e18)
    return F.when(inside, F.floor(F.floor(cents).cast("double") / 1000)).cast("long")

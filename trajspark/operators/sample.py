"""Seeded choices by md5 of seed and key: the same on any cluster, without a random stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import positions
from .scans import estimated_bytes


def seeded_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw(key: Column, seed: int) -> Column:
    """32 random bits of a key as a long."""
    return F.conv(F.substring(seeded_key(key, seed), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(low) + (high - low) * draw(key, seed) / float(1 << 32)


def choice(key: Column, seed: int, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(key, seed) % len(values) + 1).cast("int"))


def shuffled(rows: DataFrame, key: str, seed: int, into: str = "position") -> DataFrame:
    """Rows numbered from 1 in a seeded order of their keys.

    The order is that of hashes, so their first three digits are 4096 buckets of about equal size; no task sorts more.
    """
    hashed = rows.withColumn("_hash", seeded_key(F.col(key), seed))
    out = positions(hashed, F.substring("_hash", 1, 3), ["_hash", key], into).drop("_hash")
    return out.withColumn(into, F.col(into) + 1)


def fraction(rows: DataFrame, key: str, share: float, seed: int, least: int = 0) -> DataFrame:
    """rint(n * share) of the rows without replacement, `least` at least: those whose keys' hashes are smallest.

    The same rows come either way: few rows are numbered in the order of hashes, many are selected (`smallest`).
    """
    take = lambda n: F.greatest(F.rint(n * F.lit(share)).cast("long"), F.lit(least))
    if estimated_bytes(rows) > SMALL:
        return smallest(rows, key, take, seed)
    total = rows.agg(take(F.count("*")).alias("_take"))
    return shuffled(rows, key, seed, "_n").crossJoin(F.broadcast(total)).where("_n <= _take").drop("_n", "_take")


#: Estimated bytes up to which `fraction` numbers all rows.
SMALL = 64 << 20


def smallest(rows: DataFrame, key: str, take: Callable[[Column], Column], seed: int, levels: int = 2) -> DataFrame:
    """The take(n) of n rows that are first in the seeded order of their keys, all if there are fewer.

    Hashes are counted by their first three digits, in map tasks: 4096 counts tell which digits hold the last row that
    is taken. Only hashes with these digits are counted by the next three, and so on. Rows below the edge are kept by a
    filter, those at the edge, one in 4096 ** levels, are numbered; no other row is moved. Keys are distinct: rows of a
    repeated key that stand at the edge meet in one task. The edge is one row, so it is broadcast.
    """
    hashed = rows.withColumn("_hash", seeded_key(F.col(key), seed))
    edge = None
    for i in range(levels):
        own = hashed.select("_hash") if edge is None else hashed.select("_hash").crossJoin(F.broadcast(edge)).where(F.substring("_hash", 1, 3 * i) == F.col("_edge"))
        by = [] if edge is None else ["_edge", "_left"]
        counts = own.groupBy(*by, F.substring("_hash", 3 * i + 1, 3).alias("_d")).agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        left = F.col("_left") if by else F.least(take(F.col("_n")), F.col("_n"))
        counts = counts.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*by))}).withColumn("_want", left)
        here = counts.where((F.col("_upto") - F.col("_c") < F.col("_want")) & (F.col("_want") <= F.col("_upto")))
        prefix = F.concat("_edge", "_d") if by else F.col("_d")
        edge = here.select(prefix.alias("_edge"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_left"))
    near, place = hashed.crossJoin(F.broadcast(edge)), F.substring("_hash", 1, 3 * levels)
    at = near.where(place == F.col("_edge")).withColumn("_n", F.row_number().over(Window.partitionBy("_edge").orderBy("_hash", key)))
    return near.where(place < F.col("_edge")).select(*rows.columns).unionByName(at.where("_n <= _left").select(*rows.columns))


def balanced(rows: DataFrame, key: str, values: list, seed: int, into: str = "value") -> DataFrame:
    """Each value for an equal share of the rows, at most one more."""
    return shuffled(rows, key, seed, "_n").withColumn(into, F.element_at(F.array(*map(F.lit, values)), ((F.col("_n") - 1) % len(values) + 1).cast("int"))).drop("_n")


def stride(rn: Column, n: Column, target: int) -> Column:
    """Whether a row is one of about `target` at equal distances."""
    return rn % F.greatest(F.lit(1), F.floor(n / target)) == 0


def linspace(n: Column, count: int = 5) -> Column:
    """Distinct indices at equal distances from the first to the last of n rows."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - 1) / (count - 1)).cast("long")))


def replacements(rows: DataFrame, names: str, target: str, new: str, pool: list[str], seed: int, key: str) -> DataFrame:
    """rows with `replacement`: for each name of an array column another one of the pool. The target becomes `new`; the
    others draw, in a seeded order of the pool, one that no name before them got; if none is left, any but `new`."""
    first = F.struct(F.array(F.col(new)).alias("used"), F.array().cast("array<string>").alias("out"))
    everyone = F.array(*map(F.lit, pool))

    def ordered(name: Column) -> Column:
        own = lambda c: seeded_key(F.concat_ws(":", F.col(key).cast("string"), name, c), seed)
        return F.transform(F.array_sort(F.transform(everyone, lambda c: F.struct(own(c).alias("k"), c.alias("c")))), lambda s: s["c"])

    def step(state: Column, name: Column) -> Column:
        free = F.array_except(ordered(name), state["used"])
        drawn = F.coalesce(F.get(free, F.lit(0)), F.get(F.array_except(ordered(name), F.array(F.col(new))), F.lit(0)))
        chosen = F.when(name == F.col(target), F.col(new)).otherwise(drawn)
        return F.struct(F.array_append(state["used"], chosen).alias("used"), F.array_append(state["out"], chosen).alias("out"))

    return rows.withColumn("replacement", F.aggregate(names, first, step, lambda state: state["out"]))


def scenes(ids: DataFrame, names: list[str], places: list[str], seed: int) -> DataFrame:
    """For each scene_id, distinct names in seeded places: scene_id, target, position, everyone (in the order of places)."""
    keyed = lambda c: F.struct(seeded_key(F.concat(F.col("scene_id").cast("string"), F.lit(":"), c), seed).alias("k"), c.alias("c"))
    order = F.transform(F.slice(F.array_sort(F.transform(F.array(*map(F.lit, names)), keyed)), 1, len(places)), lambda s: s["c"])
    rows = ids.select("scene_id").withColumn("everyone", order)
    rows = rows.select("scene_id", "everyone", F.posexplode("everyone").alias("at", "target"))
    return rows.select("scene_id", "target", F.get(F.array(*map(F.lit, places)), F.col("at")).alias("position"), "everyone")


def combinations(names: DataFrame, name: str, into: str) -> DataFrame:
    """All combinations of distinct values, in order, as many as `into` has letters (its columns). The values are a
    dictionary; they are one array from which later places are listed, so only combinations are made."""
    rows = names.agg(F.array_sort(F.collect_set(name)).alias("_all"))
    last = F.lit(0)
    for c in into:
        rows = rows.withColumn(f"_{c}", F.explode(F.when(last < F.size("_all"), F.sequence(last + 1, F.size("_all")))))
        last = F.col(f"_{c}")
    return rows.select(*[F.get("_all", F.col(f"_{c}") - 1).alias(c) for c in into])

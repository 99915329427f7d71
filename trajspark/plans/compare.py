"""Which episodes of two datasets differ, by digests: only the rows of unequal buckets meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbouring episodes of one bucket of the upper level.
BUCKET = 256


def _hashable(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.simpleString()
    own = F.col(f"`{name}`")
    return F.to_json(F.struct(own.alias("v"))) if "map<" in kind or kind == "variant" else own


def digest(rows: DataFrame, columns: list[str]) -> Column:
    """An aggregate that is equal for equal multisets of rows in any order: count and two sums of hashes.

    xxhash64 passes over nulls, so each value comes with whether it is null; sums are decimals and can't overflow.
    """
    values = [x for c in columns for x in (_hashable(rows, c), F.col(f"`{c}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")) for seed in (0, 1)]
    return F.concat_ws(":", F.count(F.lit(1)), *sums)


def _digests(rows: DataFrame, by: Column, columns: dict[str, list[str]], side: str) -> DataFrame:
    own = [digest(rows, names).alias(f"{side}{i}") for i, names in enumerate(columns.values())]
    return rows.groupBy(by.alias("_at")).agg(F.lit(True).alias(f"_{side}"), *own)


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.withColumnRenamed("_at", "_of")
    return left.join(other, F.col("_at").eqNullSafe(F.col("_of")), "full").withColumn("_at", F.coalesce("_at", "_of"))


def unequal_buckets(left: DataFrame, right: DataFrame, key: str, columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """Buckets of neighbouring ids (`_at`; null for rows without an id) whose rows differ.

    Map tasks add the hashes up, so what is shuffled is a row a bucket and task.
    """
    at, all_ = F.floor(F.col(key) / bucket), {"all": [key, *columns]}
    both = _joined(_digests(left, at, all_, "l"), _digests(right, at, all_, "r"))
    return both.where(~F.col("l0").eqNullSafe(F.col("r0"))).select("_at")


def differences(left: DataFrame, right: DataFrame, key: str, columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """A row an episode that differs: (key, what, columns), what is `left only`, `right only` or `differs`; then the
    columns whose values, as multisets, differ, or `rows` if each column agrees and only their pairing doesn't.

    Rows of equal buckets are read, hashed and dropped; those of unequal ones are hashed again by episode and column.
    Types must agree; null ids are one episode.
    """
    for c in (key, *columns):
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"{c} has types {left.schema[c].dataType.simpleString()} and {right.schema[c].dataType.simpleString()}")
    open_ = unequal_buckets(left, right, key, columns, bucket).withColumnRenamed("_at", "_bucket")
    split = {"all": columns} | {c: [c] for c in columns}
    found = []
    for side, rows in (("l", left), ("r", right)):
        met = rows.select(key, *columns).join(open_, F.floor(F.col(key) / bucket).eqNullSafe(F.col("_bucket")), "left_semi")
        found.append(_digests(met, F.col(key), split, side))
    both = _joined(*found).where(~F.col("l0").eqNullSafe(F.col("r0")))
    names = [F.when(F.col(f"l{i}") != F.col(f"r{i}"), F.lit(c)) for i, c in enumerate(split) if i]
    inside = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    what = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").otherwise("differs")
    paired = F.when((F.size(inside) == 0) & (what == "differs"), F.array(F.lit("rows"))).otherwise(inside)
    return both.select(F.col("_at").alias(key), what.alias("what"), paired.alias("columns"))


def agreement(datasets: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Per episode over any number of datasets: in how many it is, in how many states, and whether all agree."""
    parts = [rows.groupBy(key).agg(digest(rows, columns).alias("_state")) for rows in datasets.values()]
    out = reduce(DataFrame.unionByName, parts).groupBy(key)
    out = out.agg(F.count(F.lit(1)).alias("n_datasets"), F.count_distinct("_state").alias("n_states"))
    return out.withColumn("agrees", (F.col("n_datasets") == len(datasets)) & (F.col("n_states") == 1))

"""Nearest, self and all-sides joins; lookups in ranges are in `intervals`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import latest, scan, upcoming


def nearest(queries: DataFrame, times: DataFrame, by: str, at: str, tolerance: float, width: float = 400.0) -> DataFrame:
    """queries with the distance to the nearest time of their group, and whether it is within the tolerance.

    Both tables are one sequence, cut into chunks of `width` units of time. A scan brings each query the last time
    before it and the first one after it, from other chunks too, so a group may hold any share of the rows.
    """
    q = queries.select("*", F.lit(False).alias("_is"), F.lit(None).cast("double").alias("_t"))
    t = times.select(by, F.col(at), F.lit(True).alias("_is"), F.col(at).cast("double").alias("_t"))
    both = q.unionByName(t, allowMissingColumns=True)
    found = scan(both, by, at, {"_last": latest(F.col("_t")), "_next": upcoming(F.col("_t"))}, width)
    gap = F.least(F.abs(F.col(at) - F.col("_last")), F.abs(F.col("_next") - F.col(at)))
    out = found.withColumn("gap", gap).where(~F.col("_is")).drop("_is", "_t", "_last", "_next")
    return out.withColumn("valid", F.coalesce(F.col("gap") <= tolerance, F.lit(False)))


def pair_with_offset(rows: DataFrame, key: str, offset: int, columns: list[str]) -> DataFrame:
    """Each row beside the row whose key is larger by `offset`; null where there is none."""
    other = rows.select((F.col(key) - offset).alias(key), *[F.col(c).alias(f"other_{c}") for c in columns])
    return rows.join(other, key, "left")


def presence(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Per key over all tables: how many have it, in how many values, and whether all agree."""
    parts = [df.select(F.lit(name).alias("source"), key, value) for name, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    out = rows.groupBy(key).agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(value).alias("n_values"))
    return out.withColumn("agrees", (F.col("n_sources") == len(tables)) & (F.col("n_values") <= 1))


def strict_map(rows: DataFrame, column: str, mapping: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """rows with a dictionary's value; a value that isn't in the dictionary raises."""
    known = mapping.select(F.col(key).alias(column), F.col(value).alias(into), F.lit(True).alias("_hit"))
    joined = rows.join(known, column, "left")
    miss = F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    checked = F.when(F.col("_hit"), F.col(into)).otherwise(miss.cast(joined.schema[into].dataType))
    return joined.withColumn(into, checked).drop("_hit")


def nearest_by_cosine(rows: DataFrame, row_key: str, row_vector: str, names: list[tuple[str, list[float]]]) -> DataFrame:
    """rows with the best of a few given vectors (a literal list, so its size is the query's): name and similarity."""
    from ..functions.values import cosine

    scored = [
        F.struct(cosine(F.col(row_vector), F.array(*map(F.lit, v))).alias("similarity"), F.lit(-i).alias("tie"), F.lit(n).alias("name"))
        for i, (n, v) in enumerate(names)
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return rows.withColumn("_best", best).select(row_key, F.col("_best.name").alias("name"), F.col("_best.similarity").alias("similarity"))


def overlapping_boxes(boxes: DataFrame, by: str, overlap: float = 0.35, cell: float = 50.0) -> DataFrame:
    """Pairs (id < other) of a group's boxes (id, x, y, w, h) that overlap by `overlap` at least, with their iou.

    Boxes meet on the grid cells that they touch, and a pair counts in the cell of its common corner, so boxes that
    are apart never meet.
    """
    from ..functions.values import iou

    cells = lambda low, size: F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size)) / cell))
    rows = boxes.select(by, "id", *"xywh").withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    other = rows.select(by, "cx", "cy", *[F.col(c).alias(f"o{c}") for c in ("id", *"xywh")])
    met = rows.join(other, [by, "cx", "cy"]).where(F.col("id") < F.col("oid"))
    first = (F.col("cx") == F.floor(F.greatest("x", "ox") / cell)) & (F.col("cy") == F.floor(F.greatest("y", "oy") / cell))
    value = iou(tuple(map(F.col, "xywh")), tuple(F.col(f"o{c}") for c in "xywh"))
    return met.where(first).select(by, "id", F.col("oid").alias("other"), value.alias("iou")).where(F.col("iou") >= overlap)


def by_file(rows: DataFrame, files: DataFrame, value: str) -> DataFrame:
    """rows (key, chunk, file, ..) with a value of their file from a dictionary (key, chunk, file, value); a file that
    isn't in it raises."""
    at = ["key", "chunk", "file"]
    joined = rows.join(files.select(*at, F.col(value).alias(value), F.lit(True).alias("_hit")), at, "left")
    name = F.concat_ws("/", F.col("key"), F.col("chunk").cast("string"), F.col("file").cast("string"))
    lost = F.raise_error(F.concat(F.lit("no such file: "), name)).cast(joined.schema[value].dataType)
    return joined.withColumn(value, F.when(F.col("_hit"), F.col(value)).otherwise(lost)).drop("_hit")

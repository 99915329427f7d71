"""Sets of ids as bits: how many distinct ones there are, and which are missing, without moving the rows.

Ids of a whole table become bitmaps of 32 768 neighbours, which each map task builds for itself; only bitmaps are
shuffled. Ids inside short groups (frames of an episode) become 64-bit words in the same way, so a group of a hundred
frames is two words. Rows of neighbouring ids stand together in files, so a task has few bitmaps or words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of one bitmap: what Spark's bitmap functions hold.
BITS = 32_768


def word(key: str) -> Column:
    """The number of the 64-bit word of an id."""
    return F.floor(F.col(key) / 64)


def bits_of(key: str) -> Column:
    """An aggregate: the ids of one word as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) AS int))"))


def bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """bucket, bits (4 KB), n (rows), low, high of every bucket of neighbouring ids; null ids are left out."""
    own = rows.select(F.col(key).cast("long").alias("id")).where(F.col("id").isNotNull())
    return own.groupBy(F.floor(F.col("id") / BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("id", F.lit(BITS))).alias("bits"), F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")
    )


def unset(bits: Column, size: Column) -> Column:
    """The places below `size` that a bitmap lacks, in order; of none at all, every place. Full bytes are passed over."""
    hexed = F.hex(bits)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    bytes_ = F.transform(F.sequence(F.lit(0), F.ceil(size / 8).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.coalesce(byte(i), F.lit(0)).alias("b")))
    open_ = F.filter(bytes_, lambda x: x["b"] != 255)
    free = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.floor(x["b"] / F.pow(F.lit(2), k)) % 2 == 0, x["i"] * 8 + k)), lambda p: p < size)
    return F.flatten(F.transform(open_, free))


def missing(rows: DataFrame, key: str) -> DataFrame:
    """missing_id: ids between 0 and the largest that no row has. Buckets without rows are found by their number."""
    own = bitmaps(rows.where(F.col(key) >= 0), key)
    top = own.agg(F.max("high")).head()[0]
    every = rows.sparkSession.range(0 if top is None else top // BITS + 1).select(F.col("id").alias("bucket"))
    found = every.join(own.select("bucket", "bits"), "bucket", "left")
    size = F.least(F.lit(BITS).cast("long"), F.lit(top or 0) + 1 - F.col("bucket") * BITS)
    lacking = found.withColumn("size", size).where(F.coalesce(F.bitmap_count("bits"), F.lit(0)) < F.col("size"))
    return lacking.select(F.col("bucket"), F.explode(unset(F.col("bits"), F.col("size"))).alias("place")).select((F.col("bucket") * BITS + F.col("place")).alias("missing_id"))


def dense(rows: DataFrame, key: str) -> DataFrame:
    """One row of counts (n, n_distinct, low, high, dense): a key is dense from 0 if all agree."""
    found = bitmaps(rows, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_distinct"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    ends = (F.coalesce("low", F.lit(0)) == 0) & (F.coalesce("high", F.lit(-1)) == F.col("n") - 1)
    return found.withColumn("dense", (F.col("n") == F.col("n_distinct")) & ends)

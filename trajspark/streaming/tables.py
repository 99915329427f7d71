"""Streams into tables of the shared folder, by batches that count once.

A table is a folder `{at}/{name}/batch=N`. A batch overwrites its own folders and is then committed by a small file that
is replaced whole, so a batch that Spark repeats after a failure is written again, or left out if it was committed, and
readers never see one that is half written. Spark's checkpoint is beside the tables; `run` takes what has come since
the last run and ends, so stop and restart are the usual case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.layouts import exists, read_text
from ..storage import remove, write_text


class BatchTables:
    """Tables that a stream writes batch by batch below the folder `at`."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def last(self) -> int:
        """The last committed batch; -1 if there is none."""
        path = f"{self.at}/committed"
        return int(read_text(self.spark, path)) if exists(self.spark, path) else -1

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}/batch={batch}")

    def drop(self, name: str, batch: int) -> None:
        """Delete a batch's part of a table that no later batch reads."""
        remove(self.spark, f"{self.at}/{name}/batch={batch}")

    def commit(self, batch: int) -> None:
        write_text(self.spark, f"{self.at}/committed", str(batch))

    def batch(self, name: str, batch: int, schema: T.StructType) -> DataFrame:
        """The rows of one batch; none before the first."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}/batch={batch}")

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of all committed batches, with `batch`."""
        last = self.last()
        own = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if last < 0:
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).parquet(f"{self.at}/{name}").where(F.col("batch") <= last)

    def latest(self, name: str, schema: T.StructType, keys: list[str]) -> DataFrame:
        """For a table in update mode: each key's row of the last batch that changed it."""
        rest = [f.name for f in schema.fields if f.name not in keys]
        newest = self.read(name, schema).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        return newest.select(*keys, "_row.*").select(*schema.names)


def run(stream: DataFrame, at: str, each: Callable[[DataFrame, BatchTables, int], None], mode: str = "append") -> None:
    """Give `each` what has come to the stream since the last run, by batches; returns when all is committed."""

    def once(rows: DataFrame, batch: int) -> None:
        tables = BatchTables(rows.sparkSession, at)
        if batch > tables.last():
            each(rows, tables, batch)
            tables.commit(batch)

    writer = stream.writeStream.outputMode(mode).foreachBatch(once).option("checkpointLocation", f"{at}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def into(name: str) -> Callable[[DataFrame, BatchTables, int], None]:
    """For `run`: a batch's rows as they are into one table."""
    return lambda rows, tables, batch: tables.write(rows, name, batch)


def replayed(rows: DataFrame, at: str, part: Column, parts: int, each: Callable[[DataFrame, BatchTables, int], None], mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> BatchTables:
    """A stored table as a stream that stops and starts again: its rows come as files of part 0, 1, .., a run for each.

    `prepare` makes the stream that is run (watermarks, groups) from the stream of files.
    """
    spark, source = rows.sparkSession, f"{at}/source"
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run(prepare(stream) if prepare else stream, at, each, mode)
    return BatchTables(spark, at)

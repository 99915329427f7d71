"""Incremental versions of counts and moments; over a finished stream they equal the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def task_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and moments in tumbling or sliding windows; sums merge, so late rows within the watermark fit in."""
    own = F.window("ts", length, slide) if slide else F.window("ts", length)
    x = F.col("value")
    out = events.groupBy(own.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("total_sq"), F.min(x).alias("low"), F.max(x).alias("high")
    )
    return out.select("w.start", "w.end", *out.columns[1:])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("w.start", "w.end", "user_id", "n")


def counted(rows: DataFrame, at: str, parts: int, late: str = "10 minutes", groups=task_counts, keys: list[str] | None = None) -> DataFrame:
    """The groups of an aggregation that runs in update mode over rows that come in `parts` parts by time.

    Each batch writes the groups that it changed; the last change of each counts. Windows leave the state when the
    watermark has passed them.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    own = groups(rows)
    done = tables.replayed(rows, at, by_time(rows, parts), parts, tables.into("groups"), "update", lambda s: groups(s.withWatermark("ts", late)))
    return done.latest("groups", own.schema, keys or ["event_type"])


def closed_sessions(rows: DataFrame, at: str, parts: int, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions in append mode: one is written, and leaves the state, when the watermark has passed its end. A last part
    holds one row without a user, far behind all others, which closes all sessions; its own is never written."""
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    end = end.select(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), F.expr(f"ts + 2 * INTERVAL {gap} + 2 * INTERVAL {late}").alias("ts"), F.lit(parts).alias("_part"))
    every = rows.withColumn("_part", by_time(rows, parts)).unionByName(end)
    own = sessions(rows, gap)
    done = tables.replayed(every, at, F.col("_part"), parts + 1, tables.into("sessions"), "append", lambda s: sessions(s.withWatermark("ts", late), gap))
    return done.read("sessions", own.schema).drop("batch")


def by_time(rows: DataFrame, parts: int) -> Column:
    """The number of a row's part, of equal lengths of time; rows without a time are in the first."""
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    if ends["low"] is None:
        return F.lit(0)
    length = (ends["high"] - ends["low"]) // parts + 1
    return F.coalesce(F.floor((F.unix_micros("ts") - ends["low"]) / length).cast("int"), F.lit(0))

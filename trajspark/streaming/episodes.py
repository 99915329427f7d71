"""Recording by transactions: frames count only when their episode is saved.

Each station sends frames and controls. A save makes all frames since its last control one episode; a re-record drops
them; frames that no control has followed yet are never shown. Rows may come late by up to `late` and more than once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import latest, number, scan, upcoming
from .tables import BatchTables

HORIZON = T.StructType([T.StructField("horizon", T.StringType())])


@dataclass(frozen=True)
class Recorder:
    """For `tables.run`: the table `frames` holds the saved frames with `episode`, the id of their save, and frame_index.

    A batch joins its rows to those that the batches before left open, in a table of the shared folder, so what is
    carried is what is open and no more. Rows before the horizon, the latest time seen less `late`, are settled: they
    are put in order of (time, id), in chunks (a station may hold any share of the rows). A row that comes when the
    horizon has passed its time is dropped, and so is a second row of an id: its twin is open still, or it is late.
    A row without station, time or id takes no part; one without kind is a frame. A save with no frames makes no episode.
    """

    schema: T.StructType
    station: str
    time: str
    id: str
    kind: str
    save: str
    again: str
    late: str = "1 hour"
    width: float = field(default=3.6e9)  # microseconds of a chunk when rows are first numbered

    @property
    def saved(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("episode", self.schema[self.id].dataType), T.StructField("frame_index", T.LongType())])

    def __call__(self, rows: DataFrame, tables: BatchTables, batch: int) -> None:
        before = tables.batch("horizon", batch - 1, HORIZON).first()
        before, type_ = before and before["horizon"], self.schema[self.time].dataType
        rows = rows.where(F.col(self.station).isNotNull() & F.col(self.time).isNotNull() & F.col(self.id).isNotNull())
        came = rows if before is None else rows.where(F.col(self.time) >= F.lit(before).cast(type_))
        seen = came.agg((F.max(self.time) - F.expr(f"INTERVAL {self.late}")).cast("string").alias("horizon")).first()["horizon"]
        horizon = max((x for x in (before, seen) if x is not None), default=None)
        every = tables.batch("open", batch - 1, self.schema).unionByName(came.select(*self.schema.names))
        self._settle(every, tables, batch, F.lit(False) if horizon is None else F.col(self.time) < F.lit(horizon).cast(type_))
        own = tables.spark.createDataFrame([(horizon,)], HORIZON)
        tables.write(own, "horizon", batch)

    def close(self, tables: BatchTables) -> None:
        """End the recording: every row that has come is settled, and what no save has followed is lost."""
        last = tables.last()
        self._settle(tables.batch("open", last, self.schema), tables, last + 1, F.lit(True))
        tables.commit(last + 1)

    def _settle(self, rows: DataFrame, tables: BatchTables, batch: int, settled: Column) -> None:
        rows = rows.dropDuplicates([self.id]).withColumn("_settled", settled)
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(self.schema[self.time].dataType), F.col(self.time))
        placed = rows.where("_settled").withColumn("_us", micros)
        placed = scan(placed, self.station, ["_us", self.id], {"_place": number()}, self.width)
        control = F.coalesce(F.col(self.kind).isin(self.save, self.again), F.lit(False))
        ends = F.when(control, F.struct((F.col(self.kind) == self.save).alias("save"), F.col(self.id).alias("id")))
        marked = scan(placed, self.station, "_place", {"_since": latest(F.when(control, F.col("_place"))), "_end": upcoming(ends)})
        marked = marked.where(~control).drop("_us")
        every = marked.unionByName(rows.where("NOT _settled"), allowMissingColumns=True)
        tables.write(every, "marked", batch)
        every = tables.batch("marked", batch, every.schema)
        index = F.col("_place") - F.coalesce(F.col("_since") + 1, F.lit(0))
        saved = every.where("_end.save").select(*self.schema.names, F.col("_end.id").alias("episode"), index.alias("frame_index"))
        tables.write(saved, "frames", batch)
        tables.write(every.where("_end IS NULL").select(*self.schema.names), "open", batch)
        tables.drop("marked", batch)
        tables.drop("open", batch - 2)

    def read(self, tables: BatchTables) -> DataFrame:
        """All saved frames."""
        return tables.read("frames", self.saved).drop("batch")

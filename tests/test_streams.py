"""Streams into tables: repeated batches, late rows, stops; the recorder beside plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trajspark.streaming import episodes, tables

SCHEMA = "station string, id long, at timestamp_ntz, kind string"
START = datetime(2024, 1, 1)


def recorder(spark, late="10 minutes"):
    return episodes.Recorder(spark.createDataFrame([], SCHEMA).schema, "station", "at", "id", "kind", "save", "again", late, width=3e8)


def expected(batches, late=timedelta(minutes=10)):
    seen, horizon = {}, None
    for batch in batches:
        came = [r for r in batch if r[0] is not None and r[1] is not None and r[2] is not None and (horizon is None or r[2] >= horizon)]
        seen |= {r[1]: r for r in came}
        horizon = max([x for x in (horizon, *(r[2] - late for r in came)) if x is not None], default=None)
    out = set()
    for station in {r[0] for r in seen.values()}:
        held = []
        for r in sorted((r for r in seen.values() if r[0] == station), key=lambda r: (r[2], r[1])):
            if r[3] == "save":
                out |= {(station, r[1], i, f[1]) for i, f in enumerate(held)}
            held = [] if r[3] in ("save", "again") else [*held, r]
    return out


def batches_of(r, n, parts, hot=0.8):
    items = []
    for i in range(n):
        kind = r.choice(["frame", "frame", "frame", None, "save", "again"])
        station = "hot" if r.random() < hot else r.choice(["a", "b", None])
        items.append((station, i, START + timedelta(seconds=r.randrange(3 * n) // 2), kind))
    items += r.sample(items, n // 10) + [("a", None, START, "save"), ("a", n, None, "save")]
    arrival = sorted(items, key=lambda x: (x[2] or START) + timedelta(minutes=r.choice([0, 0, 0, 2, 9, 40])))
    size = len(arrival) // parts + 1
    return [arrival[i * size : (i + 1) * size] for i in range(parts)]


def saved(table):
    return {(x.station, x.episode, x.frame_index, x.id) for x in table.collect()}


def test_recorder_with_late_and_repeated_rows_over_restarts(spark, tmp_path):
    batches = batches_of(random.Random(3), 900, 3)
    own = recorder(spark)
    rows = spark.createDataFrame([(*x, i) for i, batch in enumerate(batches) for x in batch], f"{SCHEMA}, part int")
    done = tables.replayed(rows, f"file://{tmp_path}/t", F.col("part"), 3, own)
    assert done.last() == 2 and saved(own.read(done)) < expected(batches)
    own.close(done)
    out = own.read(done)
    assert saved(out) == expected(batches) and out.count() == len(expected(batches)) > 200


def test_a_batch_that_failed_before_its_commit_counts_once(spark, tmp_path):
    first, second = batches_of(random.Random(4), 200, 2)
    own, at = recorder(spark), tables.BatchTables(spark, f"file://{tmp_path}/t")
    one, two = (spark.createDataFrame(x, SCHEMA) for x in (first, second))
    own(one, at, 0)
    assert at.last() == -1 and own.read(at).count() == 0
    own(one, at, 0)
    at.commit(0)
    own(two, at, 1)
    assert saved(own.read(at)) <= expected([first])
    own(two, at, 1)
    at.commit(1)
    own.close(at)
    assert saved(own.read(at)) == expected([first, second])
    assert own.read(at).count() == len(expected([first, second]))


def test_recording_of_nothing(spark, tmp_path):
    own, at = recorder(spark), tables.BatchTables(spark, f"file://{tmp_path}/t")
    for i in range(2):
        own(spark.createDataFrame([], SCHEMA), at, i)
        at.commit(i)
    own.close(at)
    assert own.read(at).collect() == []


def test_committed_batches_are_left_out_when_they_are_repeated(spark, tmp_path):
    at, calls = f"file://{tmp_path}/t", []
    rows = spark.range(10).withColumn("part", (F.col("id") % 2).cast("int"))

    def each(batch, own, i):
        calls.append(i)
        own.write(batch.select("id"), "ids", i)

    done = tables.replayed(rows, at, F.col("part"), 2, each)
    done.commit(5)
    spark.range(100, 103).withColumn("part", F.lit(0)).write.mode("append").parquet(f"{at}/source")
    tables.run(spark.readStream.schema(rows.schema).parquet(f"{at}/source"), at, each)
    assert calls == [0, 1] and sorted(x.id for x in done.read("ids", spark.range(1).schema).collect()) == list(range(10))

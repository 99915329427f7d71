"""Lookups in ranges: cells of ranges, and points against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import intervals, scans

RANGES = "lane int, start long, end long, file int"


def held_by(points, ranges):
    """(point, smallest file, number of ranges), each range looked at for each point."""
    out = []
    for lane, at in points:
        own = [f for g, low, high, f in ranges if g == lane and None not in (at, low, high) and low <= at <= high]
        out.append((lane, at, min([f for f in own if f is not None], default=None), len(own)))
    return sorted(out, key=repr)


def looked_up(spark, points, ranges, **options):
    p = spark.createDataFrame(points, "lane int, at long")
    found = intervals.first_cover(p, "at", spark.createDataFrame(ranges, RANGES), by=["lane"], count="n", **options)
    return sorted((tuple(r) for r in found.select("lane", "at", "file", "n").collect()), key=repr)


def test_cells_are_the_range(spark):
    random.seed(3)
    pairs = [(a, a + random.choice([0, 1, 2, 7, 8, 100, 511])) for a in random.sample(range(-600, 600), 150)]
    pairs += [(0, (1 << 40) - 1), (-(1 << 40), -1), (-5, -5)]
    rows = spark.createDataFrame(pairs, "low long, high long").select("low", "high", intervals.cells(F.col("low"), F.col("high")).alias("c"))
    for low, high, own in rows.collect():
        spans = sorted((c["cell"] << c["level"], (c["cell"] + 1 << c["level"]) - 1) for c in own)
        assert spans[0][0] == low and spans[-1][1] == high
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (high - low + 1).bit_length()


@pytest.mark.parametrize(("bits", "small"), [(2, 0), (12, 0), (12, scans.SMALL)])
def test_lookup_equals_brute_force(spark, monkeypatch, bits, small):
    monkeypatch.setattr(intervals, "WIDTH_BITS", bits)
    monkeypatch.setattr(scans, "SMALL", small)
    random.seed(bits)
    lane = lambda: random.choice([0, 0, 0, 1, None])
    ranges = []
    for i in range(300):
        low = random.randint(-9000, 9000)
        ranges.append((lane(), low, low + random.choice([0, 0, 3, 64, 1000, 9000, -1]), random.randint(0, 99)))
    ranges += [(0, -(1 << 50), 1 << 50, 98), (0, 5, None, 1), (0, None, 5, 1), (1, 0, 100, None), ranges[0], ranges[0]]
    points = [(lane(), random.randint(-10_000, 10_000)) for _ in range(700)] + [(0, 17)] * 200 + [(0, None), (None, None), (2, 5)]
    assert looked_up(spark, points, ranges) == held_by(points, ranges)


@pytest.mark.parametrize("small", [0, scans.SMALL])
def test_no_ranges_and_no_points(spark, monkeypatch, small):
    monkeypatch.setattr(scans, "SMALL", small)
    assert looked_up(spark, [(0, 1), (None, None)], []) == [(0, 1, None, 0), (None, None, None, 0)]
    assert looked_up(spark, [(0, 1)], [(0, 5, 4, 7), (0, None, None, 7)]) == [(0, 1, None, 0)]
    assert looked_up(spark, [], [(0, 5, 9, 7)]) == []


def test_names_that_clash(spark):
    ranges = spark.createDataFrame([(0, 3, 9, 7)], RANGES)
    points = spark.createDataFrame([(4, "a", "b", "c")], "at long, value string, `low.x` string, group string")
    assert [tuple(r) for r in intervals.first_cover(points, "at", ranges).collect()] == [(4, "a", "b", "c", 7)]
    with pytest.raises(ValueError, match="file"):
        intervals.first_cover(points.withColumn("file", F.lit(0)), "at", ranges)


def test_hundred_thousand_overlapping_ranges(spark, monkeypatch):
    """All hold the middle; the answer is known in closed form."""
    monkeypatch.setattr(scans, "SMALL", 0)
    n = 100_000
    ranges = spark.range(n).select((-F.col("id")).alias("start"), F.col("id").alias("end"), F.col("id").alias("file"))
    points = spark.createDataFrame([(0,), (1,), (-1,), (500,), (-99_999,), (99_999,), (100_000,), (-100_000,)], "at long")
    got = {r.at: (r.file, r.n) for r in intervals.first_cover(points, "at", ranges, count="n").collect()}
    assert got == {at: (abs(at), n - abs(at)) if abs(at) < n else (None, 0) for at in (0, 1, -1, 500, -99_999, 99_999, 100_000, -100_000)}

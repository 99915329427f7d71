"""Sketches of parts against exact ranks of the whole."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import sketches
from trajspark.operators.stats import QUANTILES
from trajspark.storage import Scratch


def rank_gap(values, at, share):
    below, upto = sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)
    return max(below - share, share - upto, 0.0)


def test_merged_parts_are_the_whole(spark):
    """Parts of very unequal sizes and ranges, so that means of quantiles would be far off."""
    random.seed(1)
    rows = [(0, i, float(i)) for i in range(20_000)] + [(1, 20_000 + i, 1e6 + random.gauss(0, 5)) for i in range(700)]
    rows += [(2, 30_000 + i, 7.0) for i in range(300)] + [(2, 40_000, None), (2, 40_001, float("nan")), (3, 40_002, None), (None, 40_003, 5.0)]
    frames = spark.createDataFrame(rows, "part int, id int, value double").repartition(7)
    parts = Scratch(spark).table(sketches.sketched(frames, "value", ["part"]), "parts")
    by_part = {r.part: r for r in sketches.quantiles(parts).collect()}
    assert by_part[3]["count"] == 0 and by_part[3].q50 is None and by_part[None].q50 == 5.0 and by_part[2].q01 == by_part[2].q99 == 7.0
    whole = sketches.quantiles(sketches.merged(parts, [])).collect()
    assert len(whole) == 1
    values = [v for _, _, v in rows if v is not None and not math.isnan(v)]
    got = whole[0]
    assert (got["count"], got["min"], got["max"]) == (len(values), min(values), max(values))
    assert got["mean"] == pytest.approx(np.mean(values)) and got["std"] == pytest.approx(np.std(values))
    for name, share in QUANTILES.items():
        assert rank_gap(values, got[name], share) <= 2 * sketches.rank_error()
    # By halves first and then together: the order of merging is free.
    half = sketches.merged(parts.withColumn("half", F.col("part") % 2), ["half"])
    again = sketches.quantiles(sketches.merged(half, [])).head()
    assert again["count"] == len(values) and again["std"] == pytest.approx(np.std(values))
    for name, share in QUANTILES.items():
        assert rank_gap(values, again[name], share) <= 2 * sketches.rank_error()


def test_gaps_are_measured(spark):
    frames = spark.createDataFrame([("a", float(i)) for i in range(1000)] + [("b", 1.0)] * 10 + [(None, 4.0)], "g string, value double")
    stats = spark.createDataFrame([("a", 0.0, 100.0, 600.0, 900.0, 990.0), ("b", 1.0, 1.0, 1.0, 1.0, 1.0), (None, 4.0, 4.0, 4.0, 4.0, 4.0)], ["g", *QUANTILES])
    got = {r.g: round(r.gap, 6) for r in sketches.rank_gaps(frames, "value", stats, ["g"]).collect()}
    assert got == {"a": 0.1, "b": 0.0, None: 0.0}


def test_nothing_at_all(spark):
    empty = spark.createDataFrame([], "part int, value double")
    assert sketches.sketched(empty, "value", ["part"]).count() == 0
    parts = sketches.sketched(spark.createDataFrame([(1, None)], "part int, value double"), "value", ["part"])
    row = sketches.quantiles(sketches.merged(parts, ["part"])).collect()
    assert [(r.part, r["count"], r["mean"], r["std"], r.q50) for r in row] == [(1, 0, None, None, None)]

"""Every engine query beside its SQL on the smallest test tables, and operators at sizes that small tables don't reach."""

import glob
import math
import os
import subprocess
import sys
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import queries
from trajspark.operators import joins, keys, sample, scans, stats, trim
from trajspark.storage import Scratch, scratch_root, write_text

TABLES = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.8g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value if isinstance(value, str) else str(value)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, TABLES)
    result = tables.execute(queries.SQL[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    expected = sorted(repr([plain(row[i]) for i in at]) for row in result.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == expected


ORDERED = ["velocity", "frozen_bounds", "trim_frozen", "first_stable_run", "post_grasp_plan", "reindex_dense", "nearest_timestamp", "downsample_frames", "range_lookup_file", "nested_range_lookup"]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_by_chunks(spark, tables, name, monkeypatch):
    monkeypatch.setattr(scans, "SMALL", 0)
    test_query_equals_its_sql(spark, tables, name)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_equal_frames_survive_clipping(spark):
    frames = spark.createDataFrame([(0, 0.5, {"a": 1}), (0, 0.5, {"a": 1}), (0, 9.0, {"a": 2}), (1, 0.5, {"a": 3})], "episode_index long, timestamp double, extra map<string, int>")
    slices = spark.createDataFrame([(0, 0.0, 5.0, 0.0, 9.0), (0, 1.0, 5.0, 1.0, 9.0)], "episode_index long, from_ts double, to_ts double, low double, high double")
    out = trim.clip_to_intervals(frames, slices)
    assert out.columns == frames.columns and [tuple(r) for r in out.collect()] == [(0, 0.5, {"a": 1})] * 2


def test_nearest_times_of_one_long_episode(spark):
    n = 64_000
    queries_ = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / 10 + 0.03).alias("t"))
    times = spark.range(n // 2).select(F.lit(1).alias("g"), (F.col("id") / 5).alias("t"))
    began = time.perf_counter()
    out = joins.nearest(queries_, times, "g", "t", 0.04).groupBy("valid").count().collect()
    assert {r["valid"]: r["count"] for r in out} == {True: n // 2, False: n // 2}
    assert time.perf_counter() - began < 40


def test_ranked_statistics_of_more_values_than_a_sketch_holds(spark):
    n = 3 * stats.ACCURACY
    rows = spark.range(n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000.0).alias("x"))
    values = {g: np.array([r.x for r in rows.where(f"g = {g} AND x IS NOT NULL").collect()]) for g in (0, 1)}
    got = {r.g: r for r in stats.ranked_stats(rows, ["g"]).collect()}
    whole = stats.ranked_stats(rows.drop("g"), []).first()
    for own, x in [*((got[g], values[g]) for g in (0, 1)), (whole, np.concatenate(list(values.values())))]:
        assert own["count"] == len(x) and own["min"] == x.min() and own["max"] == x.max()
        for name, level in stats.QUANTILES.items():
            assert own[name] == pytest.approx(np.quantile(x, level), rel=1e-12)


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "g long, x double")
    assert stats.ranked_stats(empty, ["g"]).collect() == []
    one = stats.ranked_stats(empty.drop("g"), []).first()
    assert one["count"] == 0 and one["q50"] is None
    ties = stats.ranked_stats(spark.createDataFrame([(1.0,), (1.0,), (float("nan"),)], "x double"), []).first()
    assert ties["q10"] == 1.0 and ties["count"] == 3


def test_prefixes_of_sparse_keys_by_levels(spark):
    ids = [0, 5, 4096, 10**6, 10**9, 10**12, 2**50]
    df = spark.createDataFrame([(i, 1) for i in ids], "k long, w long")
    for levels in (2, 3, 5):
        out = keys.prefixes(df, "k", {"n": F.col("w"), "m": 2 * F.col("w")}, levels=levels)
        assert sorted((r.k, r.n, r.m) for r in out.collect()) == [(k, i, 2 * i) for i, k in enumerate(ids)]


def test_places_within_groups_of_null_too(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9000), (None, 5), (None, 5000), ("a", 4000)], "g string, i long")
    out = keys.positions(df, F.floor(F.col("i") / 4096), ["i"], "n", ["g"])
    assert sorted((r.g or "", r.i, r.n) for r in out.collect()) == [("", 5, 0), ("", 5000, 1), ("a", 1, 0), ("a", 4000, 1), ("a", 9000, 2)]


def test_no_window_holds_all_keys_of_a_sample(spark):
    plan = sample.fraction(spark.range(10).withColumnRenamed("id", "k"), "k", 0.5, 1)
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in shown.splitlines() if "row_number()" in x and "windowspecdefinition" in x]
    assert windows and all("windowspecdefinition(_b" in x for x in windows) and plan.count() == 5


@pytest.mark.parametrize("share, least", [(0.3, 0), (0.0, 0), (1.0, 0), (0.0, 1), (0.0001, 0), (0.5, 10**6), (0.77777, 3)])
def test_selection_takes_the_rows_of_the_order(spark, share, least, monkeypatch):
    rows = spark.range(0, 30_000, 3).withColumnRenamed("id", "k").withColumn("more", F.col("k") % 7)
    want = sample.fraction(rows, "k", share, 5, least)
    monkeypatch.setattr(sample, "SMALL", 0)
    got = sample.fraction(rows, "k", share, 5, least)
    shown = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_b" not in shown and got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sample.fraction(rows.limit(0), "k", share, 5, least).collect() == []


def test_dictionaries_are_numbered_in_buckets(spark):
    rows = spark.createDataFrame([("b", 9000), ("a", 9000), ("c", 5), ("c", 1), (None, 0), ("d", None), ("e", 10**12)], "v string, i long")
    out = keys.first_seen(rows, "v", ["i"], "n")
    assert sorted((r.n, r.v) for r in out.collect()) == [(0, "d"), (1, "c"), (2, "a"), (3, "b"), (4, "e")]
    assert keys.first_seen(rows.limit(0), "v", ["i"], "n").collect() == []
    parts = spark.createDataFrame([("x", 1, 9000), ("y", 0, 9999), ("x", 0, 9999), ("z", 1, 3), ("w", None, 7)], "v string, s int, i long")
    assert sorted((r.n, r.v) for r in keys.first_seen(parts, "v", ["s", "i"], "n").collect()) == [(0, "w"), (1, "x"), (2, "y"), (3, "z")]


def test_result_is_the_only_table_left(spark):
    scratch = Scratch(spark)
    scratch.table(spark.range(3), "first")
    out = scratch.finish(scratch.table(spark.range(4), "second"))
    assert out.count() == 4 and os.listdir(scratch.at.removeprefix("file://")) == ["result"]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Cluster())


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    write_text(spark, path, "one")
    write_text(spark, path, "two")
    assert (tmp_path / "a.json").read_text() == "two" and [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["a.json"]


def test_entry_module_without_the_optional_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "corpus_pipeline" or name.startswith("trajspark.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and len(names) > 100
assert set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

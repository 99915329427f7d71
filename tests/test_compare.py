"""Differences of datasets by digests beside a plain comparison."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trajspark.plans import compare

SCHEMA = "e long, a double, b string, m map<string, int>"


def plain(left, right):
    out = {}
    sides = [defaultdict(list), defaultdict(list)]
    for own, rows in zip(sides, (left, right)):
        for r in rows:
            own[r[0]].append((*r[1:3], tuple(sorted((r[3] or {}).items())) if r[3] is not None else None))
    for e in set(sides[0]) | set(sides[1]):
        x, y = (s.get(e, []) for s in sides)
        if Counter(x) == Counter(y):
            continue
        names = [n for i, n in enumerate("abm") if x and y and Counter(r[i] for r in x) != Counter(r[i] for r in y)]
        out[e] = ("left only" if not y else "right only" if not x else "differs", tuple(names) or (("rows",) if x and y else ()))
    return out


def test_differences_equal_a_plain_comparison(spark):
    r = random.Random(5)
    left = [(r.choice([None, *range(40)]), r.choice([None, 0.5, 1.5]), r.choice([None, "x", "y"]), r.choice([None, {"k": 1}, {"k": 2}])) for _ in range(400)]
    right = list(left)
    r.shuffle(right)
    i = next(i for i, x in enumerate(right) if x[0] == 3)
    right[i] = (3, 99.0, *right[i][2:])
    right = [x for x in right if x[0] != 17] + [(17000, None, None, None)] + [x for x in left if x[0] == 30][:1]
    right.append((None, 7.0, None, None))
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    for bucket in (1, 8, 10**6):
        got = {x.e: (x.what, tuple(x.columns)) for x in compare.differences(a, b, "e", ["a", "b", "m"], bucket).collect()}
        assert got == plain(left, right) and {3, 17, 17000, 30, None} == set(got)
    assert compare.differences(a, a.repartition(5), "e", ["a", "b", "m"]).collect() == []
    assert sorted(x[0] for x in compare.unequal_buckets(a, b, "e", ["a", "b", "m"], 8).where("_at IS NOT NULL").collect()) == [0, 2, 3, 2125]


def test_nulls_are_told_apart_and_pairings_too(spark):
    a = spark.createDataFrame([(1, None, "x", None), (2, 1.0, "x", None), (2, 2.0, "y", None)], SCHEMA)
    b = spark.createDataFrame([(1, 1.0, None, None), (2, 1.0, "y", None), (2, 2.0, "x", None)], SCHEMA)
    got = {x.e: x.columns for x in compare.differences(a, b, "e", ["a", "b"]).collect()}
    assert got == {1: ["a", "b"], 2: ["rows"]}
    with pytest.raises(ValueError, match="a has types"):
        compare.differences(a, b.withColumn("a", F.lit(1)), "e", ["a"])
    empty = a.limit(0)
    assert compare.differences(empty, empty, "e", ["a"]).collect() == [] and compare.differences(empty, b, "e", ["a"]).count() == 2


def test_agreement_of_many(spark):
    a = spark.createDataFrame([(1, 1.0, "x", None), (2, 1.0, "x", None)], SCHEMA)
    out = {x.e: (x.n_datasets, x.n_states, x.agrees) for x in compare.agreement({"a": a, "b": a, "c": a.where("e = 1")}, "e", ["a", "b"]).collect()}
    assert out == {1: (3, 1, True), 2: (2, 1, False)}


def test_headers_as_rows(spark):
    from trajspark.plans import report

    texts = [
        ("a", '{"fps": 10, "robot_type": "arm", "features": {"v": {"dtype": "f", "shape": [1.0, 20]}, "w": {"video_info": {"video.codec": "av1", "video.fps": 30.0}}}}'),
        ("b", '{"fps": 10.0, "codebase_version": "v2.0, 1.0", "chunks_size": 1000, "features": {"v": {"shape": [1,20]}}}'),
        ("c", None), ("d", "{broken"),
    ]
    got = {(r.dataset, r.field): r.value for r in report.header_rows(spark.createDataFrame(texts, "dataset string, info string")).collect()}
    assert got["a", "fps"] == got["b", "fps"] == "10" and got["a", "features.v.shape"] == got["b", "features.v.shape"] == "[1,20]"
    assert got["b", "codebase_version"] == "v2.0, 1.0" and got["a", "codebase_version"] == "null" and got["b", "chunks_size"] == "1000"
    assert got["a", "features.w.video.codec"] == "av1" and got["a", "features.w.video.fps"] == "30" and got["a", "features.w.dtype"] == "null"
    assert {k[1]: v for k, v in got.items() if k[0] == "c"} == dict.fromkeys(report.HEADER, "null") == {k[1]: v for k, v in got.items() if k[0] == "d"}
    assert len(got) == 4 * 4 + 5 * 3

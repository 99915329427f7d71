"""Mixing, dominance counting and whitening against plain versions, on small, awkward and hot tables."""

import hashlib
import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import dominance, mixing, whitening
from trajspark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture()
def many_ranges(spark):
    """Small tables keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Reshare what is above a stop, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = min(share, repeats) * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if repeats * sizes[s] <= weight[s] * level}
        if not full:
            return target | {s: weight[s] * level for s in open_}, names
        target |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        open_ -= full
    return target, names


def highest_quotients(votes, seats):
    """One seat after another to the largest votes / (2 k + 1), ties to the first."""
    given = [0] * len(votes)
    if any(votes):
        for _ in range(seats):
            given[max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
    return given


def plain_mix(rows, block, shard_rows, repeats=2, share=1.5, seed="mix"):
    rows = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, names = plain_targets(sizes, share=share, repeats=repeats)
    seats = math.floor(min(share, repeats) * sum(sizes.values()) / block + 0.5)
    out = []
    for name, quota in zip(names, highest_quotients([target[s] for s in names], seats), strict=True):
        own = [(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n, i) for i, s, n in rows if s == name]
        shards = [[] for _ in range(math.ceil(len(own) / shard_rows))]
        for row in sorted(own, key=lambda r: r[:3]):
            shards[int(row[0][:8], 16) % len(shards)].append(row)
        votes = [sum(r[2] for r in shard) for shard in shards]
        for shard, n, q in zip(shards, votes, highest_quotients(votes, quota), strict=True):
            given, at = min(q * block, repeats * n), 0
            for _, _, size, i in shard:
                whole, rest = divmod(given, n) if n else (0, 0)
                out.append((i, size, sizes[name], whole * size + max(0, min(size, rest - at))))
                at += size
    return out, target


def documents(n, hot, seed):
    r = random.Random(seed)
    names = ["b", "é", "Z", "😀", None, "a b", ""]
    text = lambda: r.choice(["", " ", "\n"]) + " ".join("w" for _ in range(r.choice([0, 1, 3, 20, 60]))) + r.choice(["", "\t"])
    rows = [(i, "hot" if r.random() < hot else r.choice(names), text()) for i in range(n)]
    return rows + [(None, "b", "one two"), (0, "tiny", "x"), (1, "none", None), (2, None, None), (3, "long", "long word " * 9000), *rows[:5]]


@pytest.mark.parametrize(("n", "hot", "block", "shard_rows"), [(60, 0.0, 16, 1024), (300, 0.4, 4, 16), (300, 0.9, 64, 7)])
def test_mix(spark, n, hot, block, shard_rows):
    rows = documents(n, hot, n + block)
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id long, source string, text string, size int, place string").repartition(3)
    mixed = mixing.mix(docs, Scratch(spark), block=block, shard_rows=shard_rows)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.whole * r["size"] + r.extra) for r in mixed.collect()), key=repr)
    want, target = plain_mix(rows, block, shard_rows)
    assert got == sorted(want, key=repr)
    taken = {}
    for r in mixed.collect():
        assert r.target == pytest.approx(target[r.source], abs=1e-6) and r.whole * r["size"] + r.extra <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.whole * r["size"] + r.extra
    shards = {s: math.ceil(sum(r[1] == s for r in rows) / shard_rows) for s in taken}
    assert all(abs(taken[s] - target[s]) <= block * (2 + shards[s]) for s in taken)
    again = mixing.mix(docs.repartition(5), Scratch(spark), block=block, shard_rows=shard_rows)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr)


def test_mixed_texts_are_what_the_mix_takes(spark):
    rows = documents(80, 0.3, 5)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, Scratch(spark), block=4, shard_rows=16)
    taken = sum(r.whole * r["size"] + r.extra for r in mixed.collect())
    texts = mixing.texts(docs, mixed).collect()
    assert sum(len(WORD.findall(r.text)) for r in texts) == taken
    known = {}
    for i, s, t in rows:
        known.setdefault((i, s), set()).add(" ".join(WORD.findall(t or "")))
    assert all(any(t.startswith(" ".join(WORD.findall(r.text))) for t in known[r.doc_id, r.source]) for r in texts)


def test_mix_beyond_what_there_is_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "x y z"), (2, "b", "u")], "doc_id long, source string, text string")
    got = {r.doc_id: (r.target, r.whole, r.extra) for r in mixing.mix(docs, Scratch(spark), share=(5, 1), block=1).collect()}
    assert got == {1: (6.0, 2, 0), 2: (2.0, 2, 0)}
    assert mixing.mix(docs.limit(0), Scratch(spark)).collect() == []
    empty = docs.select("doc_id", "source", F.lit(None).cast("string").alias("text"))
    assert {(r["size"], r.target, r.whole, r.extra) for r in mixing.mix(empty, Scratch(spark)).collect()} == {(0, 0.0, 0, 0)}


# Dominance


def brute_dominance(rows):
    out = []
    for _, level, slot, _ in rows:
        none = level is None or slot is None
        above = [] if none else [w for _, x, s, w in rows if x is not None and s is not None and s < slot and x > level]
        out.append(None if none else (len(above), sum(above)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sweep(seed):
    r = np.random.default_rng(seed)
    n = [0, 1, dominance.CHUNK, 5 * dominance.CHUNK + 3][seed]
    rank, place = r.integers(-20, 20, n), r.integers(0, 60, n)
    order = np.lexsort([-place, rank])
    rank, place, w = rank[order], place[order], r.integers(0, 9, (n, 2))
    want = [w[(rank < a) & (place < b)].sum(0) for a, b in zip(rank, place, strict=True)]
    assert (dominance.sweep(rank, place, w) == np.array(want).reshape(-1, 2)).all()


@pytest.mark.parametrize("hot", [None, "level", "slot", "both"])
def test_dominance(spark, many_ranges, hot):
    r = random.Random(7)
    rows = [(i, r.choice([None, *range(-6, 30)]), r.choice([None, *range(-40, 400)]), r.choice([1, 2, 3])) for i in range(900)]
    rows = [(i, 5 if hot in ("level", "both") and i % 3 else x, 9 if hot in ("slot", "both") and i % 3 else s, w) for i, x, s, w in rows]
    rows += [(None, 1, 300, 2), *rows[:7]]
    points = spark.createDataFrame([(*x, "clash", 0) for x in rows], "id long, lv long, sl long, w long, level string, slot int").repartition(5)
    got = dominance.count_above(points, ["id"], F.col("lv"), F.col("sl"), {"n": F.lit(1), "m": F.col("w")}, Scratch(spark)).collect()
    want = [(i, s, x, *(b or (None, None))) for (i, x, s, _), b in zip(rows, brute_dominance(rows), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_dominance_of_nothing_and_of_nulls(spark):
    points = spark.createDataFrame([(1, None), (2, None)], "id long, lv long")
    count = lambda df: dominance.count_above(df, ["id"], F.col("lv"), F.lit(1), {"n": F.lit(1)}, Scratch(spark)).collect()
    assert [r.n for r in count(points)] == [None, None] and count(points.limit(0)) == []
    with pytest.raises(ValueError, match="name of a result"):
        dominance.count_above(points.withColumn("slot", F.lit(1)), ["slot"], F.col("lv"), F.lit(1), {"n": F.lit(1)}, Scratch(spark))


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland", "America/Los_Angeles"])
def test_days_and_levels(spark, zone):
    times = [datetime(1969, 12, 31, 23, 59, 59), datetime(1970, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1, 23, 59, 59)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.sql(" UNION ALL ".join(f"SELECT TIMESTAMP_NTZ '{t}' AS a, TIMESTAMP '{t} UTC' AS b" for t in times))
        kinds = dict(rows.dtypes)
        got = rows.select(*[dominance.utc_days(F.col(c), kinds[c]).alias(c) for c in "ab"]).collect()
        assert [tuple(r) for r in got] == [(-1, -1), (0, 0), (19723, 19723), (19723, 19723)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    totals = [None, math.nan, math.inf, 1e300, 0.0, 9.994, 9.995, -0.004, -0.006, -10.01, 74.19]
    want = [None if t is None or not abs(t) < 1e17 else math.floor(math.floor(100 * t + 0.5) / 1000) for t in totals]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(totals)], "i int, t double")
    assert [r.v for r in rows.select(dominance.price_level(F.col("t")).alias("v"), "i").orderBy("i").collect()] == want


# Whitening


def plain_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    exact = n * x - sums
    c = exact.astype(float) / n
    values, parts = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)
    values, parts = values[order][:k], parts[:, order][:, :k]
    return [int(d) for d in (exact**2).sum(1)], c @ parts / np.sqrt(values), values / np.trace(c.T @ c / n)


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.5, d)) + 2).astype(np.float32)


@pytest.mark.parametrize(("n", "d", "parts"), [(200, 6, 40), (90, 40, 3), (3000, 5, 17)])
def test_whitening(spark, n, d, parts):
    x = vectors(n, d, n)
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)]
    dropped = [(-1, None), (-2, [math.nan] * d), (-3, [math.inf] + [1.0] * (d - 1)), (-4, [None] + [1.0] * (d - 1)), (-5, [1.0]), (-6, []), (-7, [1e30] * d)]
    table = spark.createDataFrame(rows + [(*x, "clash", 1) for x in dropped], "vec_id long, embedding array<float>, n string, component int").repartition(parts)
    out = whitening.whiten(table, "embedding", ["vec_id"], Scratch(spark)).toPandas()
    k = min(32, d)
    deviations, white, explained = plain_whitening(x)
    assert len(out) == n * k and sorted(out.vec_id.unique()) == list(range(n)) and set(out.n) == {n}
    own = out.pivot(index="vec_id", columns="component", values="whitened").loc[range(n)].to_numpy().astype(float)
    assert own.shape == (n, k)
    for j in range(k):
        assert min(abs(own[:, j] - white[:, j]).max(), abs(own[:, j] + white[:, j]).max()) < 1e-9
    assert [int(v) for v in out.groupby("vec_id").deviation.first().loc[range(n)]] == deviations
    assert out.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9)
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-9


def test_whitening_without_spread(spark):
    """A constant dimension, fewer vectors than dimensions, one vector, repeated rows, null ids."""
    rows = [(i, [float(i % 3), 5.0, float(i)]) for i in range(20)] + [(None, [0.0, 5.0, 1.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(table, "embedding", ["vec_id"], Scratch(spark)).collect()
    assert len(out) == 3 * 22 and all((r.whitened is None) == (r.component == 3) for r in out) and out[0].identity_error < 1e-9
    few = whitening.whiten(table.where("vec_id < 2"), "embedding", ["vec_id"], Scratch(spark)).collect()
    assert len(few) == 6 and all((r.whitened is None) == (r.component > 1) for r in few)
    one = whitening.whiten(table.where("vec_id = 4"), "embedding", ["vec_id"], Scratch(spark)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, None)] * 3
    assert whitening.whiten(table.limit(0), "embedding", ["vec_id"], Scratch(spark)).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(i) * 1e9, -1e12 if i % 2 else 1e12]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(table, "embedding", ["vec_id"], Scratch(spark)).toPandas()
    want, _, _ = plain_whitening([v for _, v in rows])
    assert [int(v) for v in out.groupby("vec_id").deviation.first().loc[range(50)]] == want and max(want) > 1 << 63

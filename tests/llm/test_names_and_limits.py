"""Clashing names, the order of a cascade, chances of banding, vectors of several lengths, sets cut by bins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_near
from trajspark.llm import near_duplicates, neighbours, quality
from trajspark.llm.common import Scratch

CLASHES = ("_q_text", "_q_words", "_q_row", "_q_whole", "_q_failed", "_q_copy", "_pipeline_tie", "row", "of_text", "id", "tie", "a.b")


def prose(n, seed=0):
    r = random.Random(seed)
    return [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(r.randrange(60)) for _ in range(r.choice([30, 60, 200]))) for _ in range(n)]


def test_names_of_rules_and_stages_pass_through(spark):
    import corpus_pipeline

    texts = prose(12)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[0], "too short"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    values = lambda df: {tuple(r)[5:] for r in df.collect()}
    for out in (quality.keep(docs), corpus_pipeline.near_dedup(spark, quality.keep(docs), ""), corpus_pipeline.substring_dedup(spark, docs, "")):
        assert out.columns == docs.columns and values(out) == values(docs)
    assert quality.keep(docs).count() == 13 and corpus_pipeline.near_dedup(spark, quality.keep(docs), "").count() == 12
    failed = quality.apply_rules(docs.withColumn("failed_rule", F.lit(3)))
    assert failed.columns == [*docs.columns, "failed_rule"] and {r.failed_rule for r in failed.collect()} == {None, "few_words"}


def test_a_costly_rule_that_rejects_little_comes_last(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose(400, 1))], "doc_id long, text string")
    costly = lambda: F.aggregate(F.transform(quality._own("words"), lambda w: F.levenshtein(w, F.reverse(F.concat(w, w, w, w)))), F.lit(0), lambda a, x: a + x) < -1
    rules = {"costly": costly, "few": lambda: quality.n_words() < 3, "many": lambda: quality.n_words() > 100}
    for _ in range(3):
        assert quality.plan(docs, rules) == ["many", "few", "costly"] or quality.plan(docs, rules)[-1] == "costly"


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 85, 90, 95, 100])
def test_bands_miss_almost_nothing(percent):
    bands, rows = near_duplicates.layout(percent)
    assert bands * rows == near_duplicates.COORDINATES and (1 - (percent / 100) ** rows) ** bands <= near_duplicates.MISS
    keys = near_duplicates.band_keys(near_duplicates.signatures([np.arange(9, dtype=np.uint64)]), bands, rows)
    assert keys.shape == (1, bands)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_whose_members_only_partly_agree(spark, percent):
    """Rings of variants: neighbours are linked, others share bands but not enough, so buckets stay open to the end."""
    r, texts = random.Random(percent), []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(60)]
        for i in range(25):
            own = list(base)
            for k in range(i * 2, i * 2 + r.choice([1, 2, 9])):
                own[k % 60] = f"x{group}i{i}k{k}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_duplicates.near_duplicates(docs, Scratch(spark), size=3, percent=percent)
    assert sorted(tuple(x) for x in out.select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(brute_near(rows, 3, percent))


def test_vectors_of_several_lengths_are_searched_among_their_like(spark):
    r = np.random.default_rng(0)
    vectors = [(i, r.normal(size=3 if i % 3 else 5).tolist()) for i in range(150)] + [(200, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = neighbours.search(df, 50, 5, Scratch(spark)).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    for q in (0, 50, 100):
        near = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q and len(unit[i]) == len(unit[q]))[:5]
        assert [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])] == [i for _, i in near]
    assert {x.query_id for x in got} == {0, 50, 100}

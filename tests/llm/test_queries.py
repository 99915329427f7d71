"""The registered queries and the pipeline themselves, on awkward and on empty tables, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import P, WORD, brute_near, brute_substrings, corpus, encoded, measures
from tests.llm.test_mix_dominate_whiten import brute_dominance, plain_mix, plain_whitening
from trajspark.llm import language, queries, toxicity

#: Columns that clash with those that operators make.
CLASHES = "words string, tie long, score double, rank int, kept boolean, label string, failed_rule string, node string"
CLASH = ("clash", 1, 0.5, 7, True, "clash", "clash", "clash")

EXTRA = [
    "hello <|endoftext|> there <|startoftext|>", "½ ² ① ⅷ 12", "<|ENDOFTEXT|> upper", "a" * 70_000, "long text of words " * 6000, "\x1c\x1d a \x85 b\xa0c", "été naïve ÿ Ÿ",
    "vizzard quagbog " * 12, "one two\tthree\x0bfour\x0cfive\rsix",
]


def awkward() -> list[tuple]:
    rows = [(r[0], r[1]) for r in corpus()]
    return rows + [(1000 + i, t) for i, t in enumerate(EXTRA)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    rows = awkward()
    lang = ["xx", "yy", None]
    docs = [(i, t, lang[k % 3], None if k % 5 == 0 else "s", len(t or ""), *CLASH) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i, _ in rows if i is not None] + [(None, 1, 1), (5000, 1, 1), (0, None, None), (3, 0, 1)]
    labels = [(*r, *CLASH) for r in labels]
    spark.createDataFrame(labels, f"doc_id long, quality int, toxic int, {CLASHES}").write.parquet(f"{at}/labels.parquet")
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "</s>~0"), (2, 0, "assistant", "x" * 70_000), (None, 0, "user", "null id"), (3, None, "user", "null turn"), (3, 0, "assistant", "~1[INST]")]
    said += [(4, t, "assistant" if t % 2 else "user", f"{t} " * (t % 7)) for t in range(300)]
    said = [(*r, "clash", 1, 0.5, 3) for r in said]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string, leaf string, above int, score double, rank int").write.parquet(f"{at}/conversations.parquet")
    random_ = np.random.default_rng(0)
    x = random_.normal(size=(120, 6)) * np.array([1.0, 1e200, 1e-200])[np.arange(120) % 3][:, None]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(150, None), (200, [0.0] * 6), (201, [None] + [1.0] * 5), (250, [math.nan] * 6), (202, [1.0]), (None, x[0].tolist()), (50, x[50].tolist())]
    vectors = [(*r, "clash", 1, 0.5, b"v") for r in vectors]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, query_id string, rank int, score double, vector binary").write.parquet(f"{at}/embeddings.parquet")
    at_day = lambda d: None if d is None else datetime(2024, 1, 1) + timedelta(days=d, hours=d % 24)
    sales = [(i if i % 50 else None, [None, 12.345, 9.995, 1e300, math.nan, -3.0][i % 6] if i % 4 == 0 else i % 97 * 3.5, at_day(None if i % 31 == 0 else i * 7 % 150), *CLASH) for i in range(400)]
    sales += sales[:4]
    spark.createDataFrame(sales, f"sale_id long, total double, sold_at timestamp_ntz, {CLASHES}").write.parquet(f"{at}/sales.parquet")
    return at


@pytest.fixture(scope="module")
def plain():
    return [(i, t or "") for i, t in awkward()]


def rows_of(spark, folder, name, *columns):
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()), key=repr)


def expected(rows):
    return sorted(map(tuple, rows), key=repr)


def crc(i, n):
    return 0 if i is None else zlib.crc32(str(i).encode()) % n


def passes(text):
    n, chars, symbols, dup, repeated = measures(text)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    upper = sum(len(w) > 1 and w.upper() == w and w.lower() != w for w in words)
    bad = n < 20 or 100 * repeated > 30 * n or 10 * symbols > 3 * n or 10 * dup > 3 * len(lines) or chars < 2 * n or chars > 25 * n
    return not (bad or 10 * upper > 4 * n or (n >= 50 and 20 * len(set(words)) < n))


def test_op1(spark, folder, plain):
    want = []
    for i, t in plain:
        m = measures(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((i, *m, failed, passes(t)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows_of(spark, folder, "op1_quality_rules", *names) == expected(want)


def test_op2(spark, folder, plain):
    got = queries.op2_token_binary(spark, folder).collect()
    ids = [np.array(x + [2], "<u4") for x in encoded("word_bpe_49k.json", [t for _, t in plain])]
    want = [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(plain, ids, strict=True)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == expected(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert 49407 in encoded("word_bpe_49k.json", [EXTRA[0]])[0]  # the library's default


def test_op3(spark, folder):
    said = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in said:
        talks.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    want = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        want.append((i, len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(learned), sha(learned)))
    assert rows_of(spark, folder, "op3_chat_formatting", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == expected(want)


def test_op4(spark, folder, plain):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in plain:
        ids = own.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert rows_of(spark, folder, "op4_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)


def pieces(plain, size=2048):
    out = []
    for (i, _), ids in zip(plain, encoded("byte_bpe_50k.json", [t for _, t in plain]), strict=True):
        ids = np.array(ids + [0], "<u4")
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        starts = [0, *range(first, len(ids), size)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    return out


def gapless(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_op5(spark, folder, plain):
    got = queries.op5_best_fit_packing(spark, folder).collect()
    want = pieces(plain)
    assert sorted((tuple(r[:5]) for r in got), key=repr) == expected(want)
    tasks = spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions()
    assert gapless(got) <= -(-sum(r.length for r in got) // 2048) + tasks + 1


def plain_scores(model, plain):
    out = []
    for _, t in plain:
        words = toxicity._WORD.findall(t.lower())
        each = [float(model.weights[toxicity.buckets(w)].mean(dtype=np.float64)) for w in words]
        x = model.bias + (sum(each) / len(words) if words else 0.0)
        out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))))
    return out


def test_op6(spark, folder, plain):
    """Scores are those of a model that the same rows give, and labels held out change nothing."""
    got = {}
    for r in queries.op6_toxicity(spark, folder).collect():
        assert r.held_out == (crc(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append(r.score)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.where("doc_id IS NOT NULL").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, turned.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    want = {}
    for (i, _), s in zip(plain, plain_scores(model, plain), strict=True):
        want.setdefault(i, []).append(s)
    assert got.keys() == want.keys()
    for i in got:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), abs=1e-9)


def test_op7(spark, folder, plain):
    assert rows_of(spark, folder, "op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == expected(brute_substrings(plain, 20))


def test_op8(spark, folder, plain):
    got = queries.op8_language_id(spark, folder).collect()
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1"))
    want = []
    for i, t in plain:
        words = language._WORD.findall(t.lower())
        places = [b for w in words for b in language.buckets(w)]
        name, score = "und", 0.0
        if places:
            p = model.probabilities(model.weights[places].sum(0, dtype=np.float64), len(places))
            name, score = model.languages[int(p.argmax())], float(p.max())
        assert (name == "und") == (not any(c.isalpha() for c in t))
        want.append((i, crc(i, 3) == 1, name, round(score, 6)))
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got), key=repr) == expected(want)


def test_op9(spark, folder):
    got = queries.op9_ann_hilbert(spark, folder).collect()
    random_ = np.random.default_rng(0)
    x = random_.normal(size=(120, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted({r.query_id for r in got}) == [0, 50, 100]
    for q in (0, 50, 100):
        order = [i for i in np.argsort(-(unit @ unit[q])).tolist() if i != q][:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == order and [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - float(unit[q] @ unit[r.vec_id])) < 1e-12 for r in own)


def test_op10(spark, folder, plain):
    assert rows_of(spark, folder, "op10_minhash_circulant", "doc_id", "n_shingles", "component_id", "kept") == expected(brute_near(plain, 3, 85))


def test_op11(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text").collect()]
    want, target = plain_mix(rows, 16, 1024)
    assert rows_of(spark, folder, "op11_source_mixing", "doc_id", "size", "source_size", "taken") == expected(want)
    assert {round(r.target, 6) for r in queries.op11_source_mixing(spark, folder).collect()} == {round(t, 6) for t in target.values()}


def test_op12(spark, folder):
    sales = [tuple(r) for r in spark.read.parquet(f"{folder}/sales.parquet").select("sale_id", "total", "sold_at").collect()]
    level = lambda t: None if t is None or not abs(t) < 1e17 else math.floor(math.floor(100 * t + 0.5) / 1000)
    rows = [(i, level(t), None if at is None else (at - datetime(1970, 1, 1)).days, 1 + (0 if i is None else crc(i, 3))) for i, t, at in sales]
    want = [(i, s, x, *(b or (None, None))) for (i, x, s, _), b in zip(rows, brute_dominance(rows), strict=True)]
    assert rows_of(spark, folder, "op12_dominance_counting", "sale_id", "slot", "level", "n_sales", "n_rows") == expected(want)


def test_op13(spark, folder, tmp_path):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(300, 40)).astype(np.float32)
    at = str(tmp_path)
    rows = [(i, v.tolist(), *CLASH) for i, v in enumerate(x)] + [(300, None, *CLASH), (301, [math.nan] * 40, *CLASH)]
    spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {CLASHES}").repartition(4).write.parquet(f"{at}/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, at).toPandas()
    deviations, white, explained = plain_whitening(x)
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    assert own.shape == (300, 32) and str(got.deviation.dtype) == "int64"
    assert all(min(abs(own[:, j] - white[:, j]).max(), abs(own[:, j] + white[:, j]).max()) < 1e-9 for j in range(32))
    assert got.groupby("vec_id").deviation.first().tolist() == deviations
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9)
    queries.op13_embedding_whitening(spark, folder).collect()  # entries of 1e200 take no part


def test_pipeline_against_plain_stages(spark, folder, plain):
    """Each stage in plain Python on what the plain stage before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, [(i, t) for i, t in plain if passes(t)]
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality_rules"](spark, docs, folder)
    check = lambda: sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr) == expected(left) and docs.columns == columns
    assert check()

    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    left = [row for row, s in zip(left, plain_scores(model, left), strict=True) if s < 0.5]
    docs = stages["toxicity"](spark, docs, folder)
    assert check() and left

    left = list(dict.fromkeys(row for row, found in zip(left, brute_near(left, 5, 80), strict=True) if found[3]))
    docs = stages["minhash_near_dedup"](spark, docs, folder)
    assert check() and left

    new, places = [], {}
    split = [(i, WORD.findall(t)) for i, t in left]
    for i, words in split:
        for k in range(len(words) - 19):
            key, at = tuple(words[k : k + 20]), ((i is not None, i or 0), k)
            places[key] = min(places.get(key, at), at)
    for (i, t), (_, words) in zip(left, split, strict=True):
        gone = set()
        for k in range(len(words) - 19):
            if places[tuple(words[k : k + 20])] < ((i is not None, i or 0), k):
                gone.update(range(k, k + 20))
        new.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t))
    left = new
    docs = stages["substring_dedup"](spark, docs, folder)
    assert check()
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, (r[:5] for r in out))) == Counter(pieces(left))
    gapless(out)


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    at = str(tmp_path)
    for name in ("documents", "labels", "conversations", "embeddings", "sales"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        rows = query(spark, at).collect()
        assert [r.conv_id for r in rows] == [-1] if name.startswith("op3") else rows == [], name
    assert corpus_pipeline.run(spark, at).collect() == []

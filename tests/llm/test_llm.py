"""Operators of the pipeline against plain versions, on small tables with awkward rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import bpe, chat, graph, language, near_duplicates, neighbours, packing, quality, queries, shingles, simple8b, substrings, token_file, toxicity
from trajspark.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, tie long, score double, failed_rule string, key long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    random.seed(5)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    out = [None, "", " \t\n", "one", "Two words", "x" * 3000, "\x00 a b éßİ \U0001f600", base, base, base.upper()]
    for i in range(12):
        own = base.split()
        for j in random.sample(range(120), i // 3):
            own[j] = random.choice(words)
        out.append(" ".join(own))
    out += [f"{text(30)}\n{passage}\n{text(20 + i)}" for i in range(5)]
    out += [" ".join([text(9)] * 12), "a " * 200, text(4000), text(25) + "\n" + "\n".join(["same line of words"] * 6)]
    out += ["### $$$ " * 30, "LOUD WORDS ONLY HERE " * 10 + text(5), text(80)]
    rows = [(i * 3, t) for i, t in enumerate(out)]
    rows += [(None, base), (None, text(40)), (9, text(50)), rows[7], rows[7]]
    return [(i, t, "en", "s", 0, "clash", 1, 0.5, "clash", 2) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1] or "") for r in corpus()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, names, expected):
    def norm(rows):
        return sorted((tuple(r) for r in rows), key=repr)

    assert norm(df.select(*names).collect()) == norm(expected)


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


# Quality rules


def measures(text):
    words, seen, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            for i in starts:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, plain):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    expected = []
    for i, t in plain:
        m = measures(t)
        expected.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    same(quality.report(docs), names, expected)


def test_quality_order_changes_no_verdict(docs):
    orders = [list(quality.RULES), list(quality.RULES)[::-1]]
    kept = [sorted(r[0] or -1 for r in quality.apply_rules(docs, order=o).where("failed_rule IS NULL").select("doc_id").collect()) for o in orders]
    assert kept[0] == kept[1] and kept[0]
    assert quality.keep(docs).columns == docs.columns
    order = ["few_words", "symbols", "upper_case", "duplicate_lines", "few_distinct", "word_length", "repeated_windows"]
    failed = {r.failed_rule for r in quality.apply_rules(docs, order=order).collect()}
    assert {"symbols", "few_words", "upper_case", "duplicate_lines", "repeated_windows"} <= failed


def test_quality_of_nothing(empty):
    assert quality.report(empty).collect() == [] and quality.keep(empty).collect() == []


# Token files


@pytest.mark.parametrize("ids", [[], [0], [5] * 10, [2**60, 1, 2**63], list(range(5000)), [0] * 9000 + [49407]])
def test_simple8b_round_trip(ids):
    own = np.array(ids, np.uint64)
    data = simple8b.pack(own, np.array([len(ids), 0]))
    back, lengths = simple8b.unpack(data)
    assert back.tolist() == ids and lengths.tolist() == [len(ids), 0]
    if len(ids) > simple8b.BLOCK:
        assert simple8b.unpack(data, (1, 2))[0].tolist() == ids[simple8b.BLOCK : 2 * simple8b.BLOCK]


def test_simple8b_random():
    random_ = np.random.default_rng(3)
    for high in (2, 100, 60000, 2**32):
        ids = random_.integers(0, high, 20000).astype(np.uint64)
        ids[random_.integers(0, 20000, 50)] = 2**40
        assert (simple8b.unpack(simple8b.pack(ids, np.array([20000])))[0] == ids).all()


def test_token_file(spark, docs, plain):
    path = f"{Scratch(spark).at}/tokens"
    token_file.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2)
    got = token_file.read_tokens(spark.read.parquet(path)).collect()
    ids = {t: x + [2] for t, x in zip([t for _, t in plain], encoded("word_bpe_49k.json", [t for _, t in plain]), strict=True)}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == sorted((-1 if i is None else i, ids[t]) for i, t in plain)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_file_of_nothing(spark, empty):
    path = f"{Scratch(spark).at}/none"
    token_file.write_tokens(empty, path, P.path("word_bpe_49k.json"), 2)
    assert token_file.read_tokens(spark.read.parquet(path)).collect() == []


# Chat formatting


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 1.5), (1, 5, 9, "user", "orphan", 9.0)]
    rows += [(2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (None, 7, None, None, None, None), (1, 3, 1, "assistant", "b", 3.0)]
    out = chat.conversations(messages(spark, rows), Scratch(spark)).collect()
    got = {(r.tree, r.leaf): (r["rank"], "".join(x for x in re.findall(r"\n(.*?)</s>", r.formatted))) for r in out}
    assert got == {(1, 5): (1, "orphan"), (1, 3): (2, "qb"), (1, 4): (3, "qac"), (None, 7): (1, "")}
    best = chat.conversations(messages(spark, rows), Scratch(spark), best=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {(1, 5), (None, 7)}


def test_long_chain(spark):
    n = 700
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", str(i), 0.0) for i in range(n)]
    out = chat.conversations(messages(spark, rows), Scratch(spark)).select(chat.turns(F.col("formatted")).alias("t")).collect()
    assert [x.text for x in out[0].t] == [str(i) for i in range(n)]


def chat_unescaped(text):
    return text.replace("~2", "[").replace("~1", "<").replace("~0", "~")


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    began = time.perf_counter()
    formatted = chat.chains(rows).selectExpr("tree", "1L AS leaf", "1 AS rank", "0.0 AS score", "-node AS above", "role", "text")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chat, "paths", lambda messages, scratch, best: messages)
        out = Scratch(spark).table(chat.conversations(formatted, None), "long")
    got = chat.read_back(out).orderBy("turn").select("text", "learned").collect()
    assert [(r.text, r.learned) for r in got] == [(f"turn {i}", i % 2 == 1) for i in range(n)]
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "~0~1~2~", "<|user|>\n<s>", "<<SYS>>", "<", "</s></s>\n", "a|>\nb", "é\U0001f600"])
def test_escapes_are_reversible(spark, text):
    rows = [(1, 1, None, "us|>er", text, 0.0), (1, 2, 1, "assistant", text, 0.0)]
    out = chat.conversations(messages(spark, rows), Scratch(spark))
    r = out.first()
    assert [(x.role, x.text, x.learned) for x in chat.read_back(out).orderBy("turn").collect()] == [("us|>er", text, False), ("assistant", text, True)]
    assert [chat_unescaped(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans] == [text]
    assert r.formatted.count("</s>") == 2 and "[INST]" not in r.formatted and r.formatted.count("<|") == 2


def test_no_conversations(spark):
    assert chat.conversations(messages(spark, []), Scratch(spark)).collect() == []


# Byte-level BPE


def test_bpe_ids_and_bytes(spark, docs, plain):
    ranks = P.path("byte_bpe_50k.tiktoken")
    ids = encoded("byte_bpe_50k.json", [t for _, t in plain])
    out = bpe.encode(docs, ranks, P.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    expected = [(i, len(x), x, hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), t.encode(), hashlib.sha256(t.encode()).hexdigest()) for (i, t), x in zip(plain, ids, strict=True)]
    same(out, ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"], expected)
    same(bpe.decode(out, ranks, P.PATTERN), ["doc_id", "decoded"], [(i, t.encode()) for i, t in plain])


def test_bpe_cuts_are_safe():
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    random.seed(1)
    for _ in range(60):
        text = "".join(random.choice(["a", "b", " ", "  ", "\n", "1", "'s", "é", ".", "   \n", " " * 300]) for _ in range(300))
        whole = own.encoding.encode_ordinary(text)
        assert sum((own.encoding.encode_ordinary(x) for x in bpe.cuts(text, 7)), []) == whole
    assert own.decode(own.encode("x" * 200_000)) == b"x" * 200_000
    assert own.decode(own.encode(" " * 100_000 + "x")) == b" " * 100_000 + b"x"


def test_bpe_cuts_keep_runs_of_control_characters():
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for c in "\x1c\x1d\x1e\x1f":
        for text in (f"a{c * 999}b", f"a {c * 300} {c} b", f"a{' ' * 300}\n\n{c}b"):
            whole = own.encoding.encode_ordinary(text)
            assert sum((own.encoding.encode_ordinary(x) for x in bpe.cuts(text, 7)), []) == whole


# Packing


def test_packing(docs, plain):
    ids = {t: x + [0] for t, x in zip([t for _, t in plain], encoded("byte_bpe_50k.json", [t for _, t in plain]), strict=True)}
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), 0, 256).collect()
    assert sum(r.length for r in rows) == sum(len(ids[t]) for _, t in plain)
    by_sequence, by_text = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_text.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in plain:
        own = np.array(ids[t], "<u4").tobytes()
        if sum(j == i for j, _ in plain) == 1:
            assert b"".join(r.ids for r in sorted(by_text[i], key=lambda r: r.piece)) == own
    assert len(by_sequence) <= 1.3 * sum(r.length for r in rows) / 256 + 3


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)  # bin 0 was the fullest of two open ones
    assert bins.place(5) == (2, 5)
    assert bins.place(10) == (4, 0)
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(3, 10) == [(0, 3)]


def test_best_fit_against_a_plain_search():
    random.seed(12)
    for size, limit in ((10, 1), (10, 3), (64, 8), (64, 1000)):
        fast, open_, made = packing.BestFit(size, limit), [], 0  # open_: (bin, free), the last put back at the end
        for _ in range(600):
            n = random.choice([random.randint(1, size), random.randint(1, size // 4), size])
            fits = [(free, -i) for i, (_, free) in enumerate(open_) if free >= n]
            if n == size:
                expected, made = (made, 0), made + 1
            elif fits:
                free, i = min(fits)
                bin_, _ = open_.pop(-i)
                expected = (bin_, size - free)
                if free > n:
                    open_.append((bin_, free - n))
            else:
                if len(open_) == limit:
                    open_.pop(-min((free, -i) for i, (_, free) in enumerate(open_))[1])
                expected, made = (made, 0), made + 1
                open_.append((expected[0], size - n))
            assert fast.place(n) == expected


# Classifiers


def labelled(spark, n=300):
    random.seed(9)
    words = ["".join(random.choice("lmnoprst") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        own = [random.choice(words) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            for j in range(3):
                own[j] = random.choice(["vizzard", "vizzards", "vizzardy", "quagbog", "quagboggy"])
        rows.append((i, " ".join(own), "xx" if i % 2 else "yy"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_meets_unseen_spellings(spark, docs):
    texts, labels = labelled(spark)
    model = toxicity.fit(texts, labels.where("doc_id % 5 <> 0"))
    out = toxicity.score(texts, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in out]) > 0.85
    low, high = toxicity._scored(model, ["lmnops tropst plomsn"]), toxicity._scored(model, ["lmnops vizzzardz plomsn quagbogs"])
    assert high[0] > low[0]
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.keep(docs, model).columns == docs.columns


def test_toxicity_learns_from_few_toxic_labels():
    """What marks the six toxic of 606 documents is rare among all of them."""
    random.seed(4)
    words = ["".join(random.choice("lmnoprst") for _ in range(6)) for _ in range(200)]
    clean = [" ".join(random.choice(words) for _ in range(40)) for _ in range(700)]
    bad = [" ".join(["vizzard", "quagbog"] * 4 + text.split()[8:]) for text in clean[600:620]]
    model = toxicity.train(clean[:600] + bad[:6], [0] * 600 + [1] * 6)
    assert min(toxicity._scored(model, bad[6:])) > max(toxicity._scored(model, clean[620:]))


def test_toxicity_without_both_classes(spark, empty, docs):
    _, labels = labelled(spark, 6)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 5"))).collect()} <= {toxicity.train([], []).score(0, 0)}
    assert toxicity.score(empty, toxicity.train([], [])).collect() == []


def test_language(spark, docs, empty):
    random.seed(2)
    make = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(random.choice(make[k]) for _ in range(5)) for _ in range(20)), k) for i in range(60) for k in [["aa", "bb"][i % 2]]]
    rows += [(100, None, "aa"), (101, "abc", None), (102, "", "bb")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(texts.where("doc_id % 3 <> 1"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(texts, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows[:60]) and got[100] == ("und", 0.0) and got[102] == ("und", 0.0)
    assert (model.weights != 0).mean() < 0.2
    out = language.predict(docs, model).collect()
    assert len(out) == docs.count() and all(r.lang_pred in ("aa", "bb", "und") and 0 <= r.score <= 1 for r in out)
    nothing = language.fit(texts.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.predict(texts, nothing).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


# Substrings


def brute_substrings(plain, window):
    """Windows in order of (doc_id, start), nulls first; rows of equal place don't count for each other."""
    places = {}
    split = [(i, WORD.findall(t)) for i, t in plain]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key, at = tuple(words[k : k + window]), ((i is not None, i or 0), k)
            places[key] = min(places.get(key, at), at)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if places[tuple(words[k : k + window])] < ((i is not None, i or 0), k):
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,block", [(8, 4096), (20, 4096), (8, 2)])
def test_substrings_against_brute_force(spark, docs, plain, window, block):
    out = substrings.remove_duplicates(docs, Scratch(spark), window, block)
    same(out, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute_substrings(plain, window))
    words = {i: WORD.findall(t) for i, t in plain}
    for r in out.where("doc_id > 9 AND n_removed > 0").collect():
        for f in r.factors:
            if f.ref_doc not in (None, 9, 21):
                assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]


def test_substrings_of_low_variety(spark):
    random.seed(4)
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for i in range(40)] + [(99, "a " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 3):
        out = substrings.remove_duplicates(df, Scratch(spark), 8, block)
        same(out, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute_substrings(rows, 8))


def test_what_is_removed_comes_from_the_parse(spark, monkeypatch):
    """Two documents share a passage in different surroundings; without factors nothing of it is found."""
    random.seed(6)
    words = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    passage = words(24)
    df = spark.createDataFrame([(i, f"{words(30)} {passage} {words(30)}") for i in range(2)], "doc_id long, text string")
    out = substrings.remove_duplicates(df, Scratch(spark), 20).orderBy("doc_id").collect()
    assert [r.n_removed for r in out] == [0, 24]
    assert [tuple(f) for f in out[1].factors] == [(30, 24, 0, 30)]
    anchors_split = len(set(substrings.anchors(shingles.hashed(passage.encode().split()), 20)[1].tolist()))
    monkeypatch.setattr(substrings, "_factored", lambda blocks, own=substrings._factored: own(blocks).where("false"))
    left = substrings.remove_duplicates(df, Scratch(spark), 20).agg(F.sum("n_removed")).first()[0]
    assert left < 24 and anchors_split >= 1


def test_longest_matches_against_brute_force():
    random_ = np.random.default_rng(2)
    for _ in range(60):
        n = int(random_.integers(1, 9))
        sizes, block = random_.integers(1, 8, n), np.sort(random_.integers(0, 3, n))
        texts = [random_.integers(0, 3, k) for k in sizes]
        first = random_.permutation(n) * 100
        length, source = substrings.longest_matches(block, sizes, np.concatenate(texts), first)
        at = 0
        for i in range(n):
            for k in range(sizes[i]):
                best = (0, 0)
                for j in range(n):
                    for m in range(sizes[j]):
                        place = int(first[j]) + m
                        if block[j] == block[i] and place < first[i] + k:
                            same_ = 0
                            while k + same_ < sizes[i] and m + same_ < sizes[j] and texts[i][k + same_] == texts[j][m + same_]:
                                same_ += 1
                            if same_ and (same_, -place) > (best[0], -best[1] if best[0] else -(10**9)):
                                best = (same_, place)
                assert (int(length[at]), int(source[at])) == best
                at += 1


def test_a_factor_goes_on_over_segments():
    import pyarrow as pa

    spans = pa.array([dict(start=40, windows=3, ref_doc=None, ref_start=7), dict(start=0, windows=4, ref_doc=1, ref_start=10), dict(start=4, windows=6, ref_doc=1, ref_start=14)])
    factors = substrings._joined(spans, 5)
    assert [tuple(f.values()) for f in factors] == [(0, 14, 1, 10), (40, 7, None, 7)]
    assert np.flatnonzero(substrings.covered(50, factors)).tolist() == [*range(14), *range(40, 47)]


def test_substrings_of_nothing(spark, empty):
    assert substrings.remove_duplicates(empty, Scratch(spark)).collect() == []


def test_rolling_hashes_tell_windows_apart():
    h = shingles.hashed([b"a", b"b", b"a", b"b", b"a"])
    two = shingles.rolling(h, 2).tolist()
    assert two[0] == two[2] and two[1] == two[3] and two[0] != two[1]
    for n in range(1, 6):
        assert len(shingles.rolling(h, n)) == 6 - n


# Near-duplicates


def brute_near(plain, size, percent):
    sets = []
    for i, t in plain:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t)]
        sets.append((i, {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    lowest = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            lowest[find(a)] = min(lowest.get(find(a), i), i)
    out = []
    for a, (i, s) in enumerate(sets):
        component = lowest.get(find(a)) if s else i
        out.append((i, len(s), component, i == component))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, docs, plain, size, percent):
    out = near_duplicates.near_duplicates(docs, Scratch(spark), size, percent)
    same(out, ["doc_id", "n_shingles", "component_id", "kept"], brute_near(plain, size, percent))


def test_near_duplicates_of_a_borderline_group(spark):
    """Copies around the limit of one text: links between copies matter, not only those to one of them."""
    random.seed(8)
    words = [f"w{i}" for i in range(1000)]
    base = random.sample(words, 90)
    rows = []
    for i in range(120):
        own = list(base)
        for j in random.sample(range(90), random.randint(0, 4)):
            own[j] = random.choice(words)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates.near_duplicates(df, Scratch(spark), 3, 85)
    same(out, ["doc_id", "n_shingles", "component_id", "kept"], brute_near(rows, 3, 85))


def test_near_duplicates_in_a_chain_of_three(spark):
    """Both ends are alike to the middle only, whose digest is the largest of the three."""
    random.seed(0)
    middle = random.sample([f"w{i}" for i in range(1000)], 120)
    ends = [list(middle), list(middle)]
    ends[0][20] = ends[0][60] = "left"
    ends[1][40] = ends[1][90] = "right"
    rows = [(i, " ".join(own)) for i, own in enumerate([*ends, middle])]
    digests = [near_duplicates._digest(x) for x in near_duplicates.shingle_sets([t for _, t in rows], 3)]
    assert digests[2] == max(digests)
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 85)
    same(out, ["doc_id", "component_id", "kept"], [(0, 0, True), (1, 0, False), (2, 0, False)])


def test_near_duplicates_of_nothing(spark, empty):
    assert near_duplicates.near_duplicates(empty, Scratch(spark)).collect() == []


def test_circulant_signature_estimates_similarity():
    random_ = np.random.default_rng(1)
    a = random_.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], random_.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_duplicates.signatures([np.unique(a), np.unique(b)], 512)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    out = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 41)] + [(101, 100)]


def test_components_of_a_node_with_two_roots(spark):
    for edges in ([(0, 2), (1, 2)], [(0, 3), (1, 3), (2, 3)]):
        out = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
        assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, edges[-1][1] + 1)]


# Neighbours


def test_neighbours_of_a_small_table_are_exact(spark):
    random_ = np.random.default_rng(0)
    x = random_.normal(size=(300, 8))
    x[100:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (950, [0.0] * 8), (901, [None] + [1.0] * 7), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0]), (None, x[0].tolist()), rows[50], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, 50, 5, Scratch(spark)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250}
    for q in (0, 50, 100, 150, 200, 250):
        near = [(-round(float(s), 12), i) for i, s in enumerate(unit @ unit[q]) if i != q]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [i for _, i in sorted(near)[:5]]
        assert all(abs(r.score + s) < 1e-9 for r, (s, _) in zip(own, sorted(near), strict=False))


def clustered(n, width=16, size=50):
    """n vectors in n / size clusters around random centres."""
    random_ = np.random.default_rng(n)
    centres = random_.normal(size=(n // size, width))
    return np.repeat(centres, size, 0) + 0.05 * random_.normal(size=(n // size * size, width))


def test_many_blocks_find_what_was_not_fitted_and_the_work_grows_with_the_rows(spark):
    asked = {}
    for n in (5000, 20000):
        x = clustered(n)
        order = np.random.default_rng(1).permutation(len(x))
        df = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>").repartition(4)
        scratch = Scratch(spark)
        found = scratch.table(neighbours.search(df, 20, 5, scratch, block=64), "found")
        assert neighbours.recall(found, df, 20, 5, scratch) >= 0.9
        rows = spark.read.parquet(f"{scratch.at}/asked")
        asked[n] = 64 * rows.count() / (n // 20)  # vectors that a query is compared with
    assert asked[20000] < 2 * asked[5000] and asked[20000] < 20000 / 4


def test_vectors_of_extreme_size(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(60, 6))
    size = np.array([1.0, 1e200, 1e-200, 1e300, 1e-300, 2.0])[np.arange(60) % 6]
    df = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, size, strict=True))], "vec_id long, embedding array<double>")
    got = neighbours.search(df, 50, 5, Scratch(spark)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50):
        order = [i for i in np.argsort(-(unit @ unit[q])).tolist() if i != q][:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == order
        assert all(abs(r.score - float(unit[q] @ unit[r.vec_id])) < 1e-12 for r in own)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, 50, 5, Scratch(spark)).collect()] == [(0, 1, 1)]
    assert neighbours.search(df.where("vec_id > 5"), 50, 5, Scratch(spark)).collect() == []


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert len(set(neighbours.hilbert(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, labels = labelled(spark, 120)
    extra = [(1000, texts.first().text + " end", "xx"), (1001, "few words", "xx")]
    texts = texts.union(spark.createDataFrame(extra, texts.schema))
    texts.selectExpr("doc_id", "text", "lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "1 AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        kept = {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert 1001 not in kept and 1000 in kept
        if name == "toxicity":
            assert not {i for i in kept if i < 1000 and i % 3 == 0} or len(kept) > 60
        if name == "minhash_near_dedup":
            assert 1000 not in kept
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in out.select("doc_id").collect()} == kept


def test_pipeline_rejects_what_op6_calls_toxic(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    texts, labels = labelled(spark, 6)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for share, n in ((0.55, 0), (0.45, 6)):
        model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), float(np.log(share / (1 - share))))
        monkeypatch.setattr(toxicity, "fit", lambda docs, labels, model=model: model)
        assert corpus_pipeline.toxicity_filter(spark, texts, str(tmp_path)).count() == n


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)

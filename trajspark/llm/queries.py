"""One query for each operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dominance, language, mixing, near_duplicates, neighbours, packing, quality, substrings, token_file, toxicity, whitening
from .common import Scratch, documents


def tokenizer_path(name: str) -> str:
    """A vocabulary file, by the same package on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_hash(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id gives 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).at}/tokens"
    token_file.write_tokens(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_file.read_tokens(spark.read.parquet(path), with_ids=False)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) t(conv_id, turn, role, text)")
    scratch = Scratch(spark)
    written = scratch.finish(chat.conversations(chat.chains(rows.union(extra)), scratch), "formatted")
    own = F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.when(F.col("learned"), F.col("text")).alias("learned"))
    read = chat.read_back(written).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(own)).alias("turns"),
        F.count_if("learned").alias("n_learned"),
        F.first("n_spans").alias("n_spans"),
        F.first("formatted_chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")  # nulls are left out
    lost = F.raise_error(F.lit("a span of the loss mask is no turn's text")).cast("string")
    read = read.withColumn("learned", F.when(F.col("n_learned") == F.col("n_spans"), learned).otherwise(lost))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, outputs)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("doc_id").isNotNull() & (id_hash(5) != 0))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", (id_hash(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    out = substrings.remove_duplicates(documents(spark, sf_dir), scratch, window=20)
    return scratch.finish(out.select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & (id_hash(3) != 1)))
    return language.predict(docs, model).select("doc_id", (id_hash(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_ann_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scratch=scratch))


def op10_minhash_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(near_duplicates.near_duplicates(documents(spark, sf_dir), scratch, size=3, percent=85).drop("tie"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    mixed = mixing.mix(documents(spark, sf_dir), scratch)
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return scratch.finish(mixed.select("doc_id", "size", "source_size", "target", taken))


def op12_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").select("sale_id", "total", "sold_at")
    copies = 1 + F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 3, F.lit(0))
    slot = dominance.utc_days(F.col("sold_at"), dict(sales.dtypes)["sold_at"])
    scratch = Scratch(spark)
    counted = dominance.count_above(sales, ["sale_id"], dominance.price_level(F.col("total")), slot, {"n_sales": F.lit(1), "n_rows": copies}, scratch)
    return scratch.finish(counted)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", ["vec_id"], Scratch(spark))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_binary": op2_token_binary,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_ann_hilbert": op9_ann_hilbert,
    "op10_minhash_circulant": op10_minhash_circulant,
    "op11_source_mixing": op11_source_mixing,
    "op12_dominance_counting": op12_dominance_counting,
    "op13_embedding_whitening": op13_embedding_whitening,
}

WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, t, {WORDS} AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
s AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS k FROM c WHERE n > 1),
v AS (SELECT r, sum(k)::BIGINT AS k FROM s GROUP BY r),
m AS (SELECT doc_id, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.k, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper,
             len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN v USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * len(ls)
           OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_upper > 4 * n_words
           OR (n_words >= 50 AND 20 * n_distinct < n_words)) AS kept
FROM f
"""


def _escaped(text: str) -> str:
    """What a text becomes, written out for this engine."""
    text = f"replace(replace({text}, '~', '~0'), '<|', '~1|')"
    text = f"replace(replace({text}, '</s>', '~1/s>'), '<s>', '~1s>')"
    return f"replace(replace(replace({text}, '<<', '~1~1'), '[INST]', '~2INST]'), '[/INST]', '~2/INST]')"


OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<|' || replace({_escaped("role")}, '|', '~3') || '|>' || chr(10) || {_escaped("text")} || '</s>' || chr(10) AS f,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
       sum(length(f))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: A word is covered if a window that starts at it or up to 19 words before it also starts earlier.
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w,
             unnest(list_transform(generate_series(1, len(ws)), lambda k: CASE WHEN k + 19 <= len(ws) THEN md5(array_to_string(ws[k:k + 19], ' ')) END)) AS g FROM d),
h AS (SELECT *, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: All pairs that share a shingle, whole intersections, and the smallest id reachable over links.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 2], ' '))
                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2) p
                   JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * c >= 85 * (u.n + v.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, reached) AS (SELECT a, a FROM both_ways UNION SELECT e.b, reach.reached FROM reach JOIN both_ways e ON e.a = reach.doc_id AND reach.reached < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS low FROM reach GROUP BY doc_id) m USING (doc_id)
"""

#: The level by cumulated stops, and all quotients listed and ranked.
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({WORDS})::BIGINT AS size, md5(concat('mix:', doc_id)) AS h FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[place % 3 + 1] AS weight, 2 * source_size AS stop, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, stop / weight AS ratio, coalesce(sum(stop) OVER (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stops,
             sum(weight) OVER (ORDER BY stop / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM w),
v AS (SELECT coalesce(arg_min((3 * total - 2 * stops) / (2 * open), ratio) FILTER (ratio > (3 * total - 2 * stops) / (2 * open)), 0.0) AS level FROM o),
t AS (SELECT w.*, least(stop::DOUBLE, weight * level) AS target, count(*) OVER () AS n_sources, ceil(n_docs / 1024)::BIGINT AS n_shards, (6 * total + 32) // 64 AS blocks FROM w, v),
q AS (SELECT place, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS i, blocks
      FROM (SELECT *, unnest(range(0, (target / 16)::BIGINT + n_sources + 3)) AS k FROM t)),
b AS (SELECT place, count(*) AS quota FROM q WHERE i <= blocks GROUP BY place),
f AS (SELECT t.*, coalesce(quota, 0) AS quota FROM t LEFT JOIN b USING (place)),
x AS (SELECT d.*, f.place, f.source_size, f.target, f.n_shards, f.quota, concat('0x', substr(h, 1, 8))::BIGINT % f.n_shards AS shard FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
y AS (SELECT place, shard, sum(size)::BIGINT AS votes, max(quota) AS quota, max(source_size) AS source_size, max(n_shards) AS n_shards FROM x GROUP BY 1, 2),
z AS (SELECT place, shard, votes, quota, row_number() OVER (PARTITION BY place ORDER BY votes / (2 * k + 1) DESC, shard, k) AS i
      FROM (SELECT *, unnest(range(0, CASE WHEN votes = 0 THEN 0 ELSE (quota * (votes / source_size))::BIGINT + n_shards + 3 END)) AS k FROM y)),
g AS (SELECT place, shard, least(16 * count(*) FILTER (i <= quota), 2 * max(votes)) AS given, max(votes) AS votes FROM z GROUP BY 1, 2),
l AS (SELECT x.*, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT doc_id, size, source_size, target, CASE WHEN g.votes IS NULL THEN 0 ELSE size * (given // g.votes) + greatest(0, least(size, given % g.votes - before)) END::BIGINT AS taken
FROM l LEFT JOIN g USING (place, shard)
"""

#: crc32 digit by digit over a table that its own rule makes; cells against cells.
OP12_SQL = """
WITH c AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda x, k: xor(x // 2, 3988292384 * (x % 2)))) AS t),
w AS (SELECT sale_id, 1 + CASE WHEN sale_id IS NULL THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(sale_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda x, d: xor(x // 256, c.t[xor(x % 256, d) + 1])), 4294967295) % 3 END AS copies, floor(epoch(sold_at) / 86400)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 1000)::BIGINT AS level FROM sales, c),
g AS (SELECT level, slot, count(*) AS n, sum(copies) AS m FROM w WHERE level IS NOT NULL AND slot IS NOT NULL GROUP BY 1, 2),
a AS (SELECT x.level, x.slot, coalesce(sum(y.n), 0)::BIGINT AS n_sales, coalesce(sum(y.m), 0)::BIGINT AS n_rows FROM g x LEFT JOIN g y ON y.slot < x.slot AND y.level > x.level GROUP BY 1, 2)
SELECT sale_id, w.slot, w.level, n_sales, n_rows FROM w LEFT JOIN a ON w.slot = a.slot AND w.level = a.level
"""

SQL = {"op1_quality_rules": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op10_minhash_circulant": OP10_SQL, "op11_source_mixing": OP11_SQL, "op12_dominance_counting": OP12_SQL}

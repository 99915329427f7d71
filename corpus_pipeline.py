"""A corpus from raw documents: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes all that the one before kept; all but the last return the columns of documents.

Null and empty texts have no words, so the first stage rejects them; what a later stage would do with them its
operator's docstring says. Very long texts go through whole. Rows are told apart by doc_id and text: repeated rows are
one document from the third stage on, different texts of one doc_id or of a null one stay apart. An empty table gives
empty tables. Other columns pass through all stages but the last, also where their names clash with those of an
operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import near_duplicates, packing, quality, substrings, toxicity
from trajspark.llm.common import Scratch
from trajspark.llm.queries import tokenizer_path

def _tied(docs: DataFrame) -> DataFrame:
    """Every row whole, as one struct, so that no name of its columns can clash; rows of one doc_id are told apart by a
    hash of their text."""
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), tie.alias("of_text"))


def _same(found: DataFrame):
    return F.col("id").eqNullSafe(found["doc_id"]) & (F.col("of_text") == found["tie"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep(docs, toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, of repeated rows too."""
    scratch = Scratch(spark)
    found = near_duplicates.near_duplicates(docs, scratch, size=5, percent=80)
    stay = scratch.finish(found.where("kept").select("doc_id", "tie").distinct(), "stay")
    rows = _tied(docs).join(stay, _same(stay), "left_semi").dropDuplicates(["id", "of_text"])
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that stand earlier; n_chars follows them. No document goes."""
    scratch = Scratch(spark)
    found = substrings.remove_duplicates(docs, scratch, window=20)
    lost = found.where(F.col("kept").isNotNull()).select("doc_id", "tie", "kept").dropDuplicates(["doc_id", "tie"])
    lost = scratch.finish(lost, "lost")
    rows = _tied(docs).join(lost, _same(lost), "left")
    row, kept = F.col("row"), F.col("kept")
    changed = {"text": F.coalesce(kept, row["text"]), "n_chars": F.coalesce(F.length(kept), row["n_chars"])}
    return rows.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else row[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Trained scores and tokenizers can't be said in SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs

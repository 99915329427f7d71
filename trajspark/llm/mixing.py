"""Sources mixed to target weights by highest quotients, with DataFrame functions only.

Sources in code point order, null last, weigh the given weights in turn and share a multiple of all words. A target
stops at `repeats` times its source's words; what it can't take is reshared by weight until no target is above. Equal
blocks of `block` words then go to sources one by one, each to the highest quotient target / (2 k + 1) of a source that
has k blocks (Sainte-Lague), and a source's blocks go to its shards in the same way, by the shards' words. A shard is a
seeded set of about `shard_rows` documents, so a source of any size is many groups. A shard's documents stand in a
seeded order and form one line of words, cut into blocks; the quota takes blocks from the line's start, and
begins again where it holds more than the line.

No quotient is listed that can't decide: a divisor a little too large gives every part its sure blocks, and only the
quotients between that and a divisor a little too small, two for a part on average, are ranked.

A null text has no words: its size is 0 and nothing of it is taken. A very long text is one document, of which a part
may be taken. Equal quotients go to the source, or shard, that comes first; equal draws of documents go by doc_id and
size. Repeated rows are documents of their own. An empty table gives an empty one. Other columns are not read, so their
names can't clash. A null doc_id is drawn as an empty text. Reruns agree: draws are hashes of the seed and doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import ranked
from .common import SPACE_CLASS, Scratch


def word_count(text: Column) -> Column:
    """Words of a text that isn't null: pieces between runs of white space, without the empty ones at the ends."""
    ends = F.when(text.rlike(rf"^{SPACE_CLASS}"), 1).otherwise(0) + F.when(text.rlike(rf"{SPACE_CLASS}\z"), 1).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(text, SPACE_CLASS)) - ends).otherwise(0).cast("long")


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every whole text."""
    return with_text(docs).select("doc_id", "source", word_count(F.col("text")).alias("size"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], repeats: int) -> tuple[DataFrame, int]:
    """sources (place, source_size, ..) with weight and target, and the number of all words.

    The level is what a weight of one gets. It only rises from round to round, as sources reach their stop, and needs
    sums of whole numbers over the sources, so it is the same in every run.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")).cast("long")
    rows = sources.withColumns({"weight": weight, "stop": F.col("source_size") * repeats})
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    level, stopped = 0.0, -1
    while True:
        full = F.col("stop") / F.col("weight") <= level
        had = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("stop"))), F.lit(0)).alias("stops"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")
        ).head()
        if not had["open"]:
            level = math.inf  # every source is at its stop
        if had["stops"] == stopped or not had["open"]:
            break
        stopped, level = had["stops"], (share[0] * total - share[1] * had["stops"]) / (share[1] * had["open"])
    target = F.least(F.col("stop").cast("double"), F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).drop("stop"), total


def apportion(parts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """parts (group, part, votes, seats, all_votes, n_parts) with `quota`: the seats of the group by highest quotients.

    seats, all_votes and n_parts are the group's; parts of a group have different numbers. A group without votes
    gives no seats.
    """
    margin = F.col("n_parts") / 2 + 1
    upto = lambda seats: F.floor(F.coalesce(F.try_divide(F.col("votes") * F.greatest(F.lit(0.0), seats), F.col("all_votes").cast("double")), F.lit(0.0)) + 0.5)
    rows = parts.withColumns({"sure": upto(F.col("seats") - margin), "most": upto(F.col("seats") + margin)})
    left = rows.groupBy("group").agg((F.max("seats") - F.sum("sure")).alias("left"))
    open_ = rows.where("most > sure").select("group", "part", "votes", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("k"))
    open_ = open_.withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    placed = ranked(open_, [F.col("quotient").desc(), F.col("part"), F.col("k")], "rank", scratch, name, ["group"])
    won = placed.join(left, "group").where(F.col("rank") < F.col("left")).groupBy("group", "part").agg(F.count("*").alias("won"))
    out = rows.join(won, ["group", "part"], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
    return out.select(*parts.columns, "quota")


def draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), repeats: int = 2,
    block: int = 16, shard_rows: int = 1024, seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (how often the whole text is taken) and extra (how many of its
    first words are taken once more) of every document. share: the mix in words, as a fraction of all words."""
    rows = scratch.table(sizes(docs), "sizes")
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    each = scratch.table(ranked(each, [F.col("source").asc_nulls_last()], "place", scratch, "ordered"), "sources")
    share = min(share, (repeats, 1), key=lambda s: s[0] / s[1])
    each, total = with_targets(each, weights, share, repeats)
    blocks = (2 * share[0] * total + share[1] * block) // (2 * share[1] * block)
    voted = each.select(F.lit(0).alias("group"), F.col("place").alias("part"), F.col("target").alias("votes"))
    n = each.count()
    voted = voted.withColumns({"seats": F.lit(blocks), "all_votes": F.lit(total * share[0] / share[1]), "n_parts": F.lit(n)})
    quotas = apportion(voted, scratch, "source_quotients").select(F.col("part").alias("place"), F.col("quota").alias("source_quota"))
    n_shards = F.ceil(F.col("n_docs") / shard_rows)
    each = scratch.table(each.join(quotas, "place").withColumn("n_shards", n_shards), "targets")

    known = each.withColumnRenamed("source", "_source")
    drawn = rows.withColumn("draw", draw(seed)).join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shard = F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("n_shards"))
    drawn = scratch.table(drawn.withColumn("shard", shard).select("doc_id", "source", "size", "source_size", "target", "draw", "place", "shard"), "drawn")
    shards = drawn.groupBy("place", "shard").agg(F.sum("size").alias("votes")).join(each, "place")
    shards = shards.select(
        F.col("place").alias("group"), F.col("shard").alias("part"), "votes", F.col("source_quota").alias("seats"),
        F.col("source_size").alias("all_votes"), F.col("n_shards").alias("n_parts"),
    )
    quotas = apportion(shards, scratch, "shard_quotients")
    quotas = quotas.withColumn("given", F.least(F.col("quota") * block, F.col("votes") * repeats)).select(
        F.col("group").alias("place"), F.col("part").alias("shard"),
        F.expr("given div greatest(votes, 1)").alias("whole"), F.expr("given % greatest(votes, 1)").alias("rest"),
    )
    line = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = drawn.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    out = laid.join(quotas, ["place", "shard"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", extra.alias("extra"))


def texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, source, copy (from 0) and text of all that the mix takes: whole texts, then the first words, joined by
    one space, of those of which a part is taken. Each row of docs gets one row of the mix of equal doc_id, source
    and size."""
    own = ["doc_id", "source", "size"]
    nth = lambda *order: F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    rows = with_text(docs).withColumn("size", word_count(F.col("text"))).withColumn("nth", nth("text"))
    plan = mixed.select(*own, "whole", "extra").withColumn("nth", nth("whole", "extra")).withColumnsRenamed({c: f"_{c}" for c in (*own, "nth")})
    same = F.lit(True)
    for c in (*own, "nth"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    words = F.filter(F.split("text", SPACE_CLASS), lambda w: w != "")
    first = F.when(F.col("extra") > 0, F.array(F.array_join(F.slice(words, 1, F.col("extra").cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat("text", F.col("whole").cast("int")), first)
    return rows.join(plan, same).select("doc_id", "source", F.posexplode(copies).alias("copy", "text"))

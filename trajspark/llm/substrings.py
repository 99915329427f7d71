"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is everything before it. It is indexed in blocks, spread over the cluster by content:
every window of WINDOW words belongs to the block named by the smallest hash of the GRAM-word runs inside it (its
anchor), so equal windows meet in one block wherever they stand. A document is factored against every block that it
has an anchor in; no other block can hold a factor of WINDOW words.

1. Each document's windows are cut into segments of one anchor (a segment has WINDOW - GRAM + 1 windows at most).
2. Anchors are counted with map-side combining; those met once end here, which is nearly all.
3. Segments of other anchors become classes of equal words. Every occurrence but the first is one factor.
4. The first segments of the classes of an anchor are its block. A task sorts the suffixes of a block's segments by
   ever longer prefixes and so knows the longest match of every suffix that starts earlier. A segment is parsed from
   left to right: the longest match at a place is a factor; the windows over the factor's end are then checked one by
   one, and the first that has a match of its own starts the next factor.
5. A block of more than about BLOCK segments is cut into several, each factored alone; the windows that are met for
   the first time in one of them are then looked up in the others, at most one row for a window and part.
6. The factors of a document's segments are joined where one goes on in the next; the words that they cover go.

Hashes have 64 bits and are compared only inside one anchor of 64 bits.

"Earlier" is by (doc_id, first word); a null doc_id comes before all others. Null and empty texts have no words, an
empty table no rows. Documents of one doc_id are one place: rows that are equal don't make each other duplicates,
different rows do at different places. Of equally long matches the earliest place is the reference. A very long
text is one row of its sketch for a segment and is joined whole, once to be cut up and once to be shortened. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, fields, id_and_text, per_batch, to_arrow
from .shingles import hashed, in_chunks, mixed, rolling, words_of

#: Words of the runs whose smallest hash is a window's anchor.
GRAM = 5

#: Segments of one block that are factored together, about, and rows that a task takes up at a time.
BLOCK, ROWS = 1024, 16384


def anchors(hashes: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window: the smallest hash of its runs, and where the first such run starts."""
    low = mixed(rolling(hashes, gram))
    at = np.arange(len(low))
    span, done = window - gram + 1, 1
    while done < span:
        step = min(done, span - done)
        n = len(low) - step
        if n <= 0:
            return low[:0], at[:0]
        later = low[step:] < low[:n]
        low, at = np.where(later, low[step:], low[:n]), np.where(later, at[step:], at[:n])
        done += step
    return low, at


def segments(counts: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document, first word in it, number of windows, and anchor of every segment of concatenated documents."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    low, at = anchors(hashes, window)
    document = np.repeat(np.arange(len(counts)), counts)
    own = document[: len(low)]
    inside = own == document[window - 1 :]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(starts)
    edge = np.append(np.flatnonzero(starts | ~inside), len(low))
    length = edge[np.searchsorted(edge, first, "right")] - first
    begin = np.cumsum(counts) - counts
    return own[first], first - begin[own[first]], length, low[first].view(np.int64)


def _sketch(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, first word, number of windows, anchor of every segment of every document."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "start": [], "windows": [], "anchor": []}
        for a, b in in_chunks(rows["text"]):
            words = [words_of(t) for t in rows["text"][a:b]]
            counts = np.array([len(w) for w in words], np.int64)
            document, start, length, anchor = segments(counts, hashed([w for own in words for w in own]), window)
            ids = rows["doc_id"][a:b]
            out["doc_id"] += [ids[i] for i in document.tolist()]
            out["start"].append(start)
            out["windows"].append(length)
            out["anchor"].append(anchor)
        for name in ("start", "windows", "anchor"):
            out[name] = np.concatenate(out[name]) if out[name] else []
        return out

    schema = fields(docs, ("start", "int"), ("windows", "smallint"), ("anchor", "bigint"))
    return per_batch(docs, run, schema)


def _window_hashes(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tie, start, anchor, hashes of its windows, for every segment that `found` asks for."""
    schema = fields(docs, ("tie", "bigint"), ("start", "int"), ("anchor", "bigint"), ("hashes", "array<bigint>"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {f.name: [] for f in schema}
        for doc_id, tie, text, found in zip(rows["doc_id"], rows["tie"], rows["text"], rows["found"], strict=True):
            whole = rolling(hashed(words_of(text)), window).view(np.int64)
            # Of several rows of one doc_id, a shorter one doesn't have every place that is asked for.
            own = [x for x in found if x["start"] + x["windows"] <= len(whole)]
            out["doc_id"] += [doc_id] * len(own)
            out["tie"] += [tie] * len(own)
            out["start"] += [x["start"] for x in own]
            out["anchor"] += [x["anchor"] for x in own]
            out["hashes"] += [whole[x["start"] : x["start"] + x["windows"]] for x in own]
        return out

    return per_batch(docs.select("doc_id", "tie", "text", "found"), run, schema)


def longest_matches(block: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of every segment: how many windows its longest match with an earlier place has, and the
    smallest such place (0 and 0 if none).

    Segments are given by block, number of windows, all windows' hashes in a row, and the place of the first window.
    Suffixes are ranked by their first window, then by ever longer prefixes; only those that share one go on.
    """
    segment = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[segment]
    place, left = first[segment] + inside, sizes[segment] - inside
    length, source = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    order = np.lexsort((hashes, block[segment]))
    own, part = hashes[order], block[segment][order]
    single = np.empty(len(hashes), np.int64)
    single[order] = np.cumsum(np.append(False, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))[: len(hashes)]
    alive, rank, done = np.arange(len(hashes)), single, 1
    while len(alive):
        order = np.lexsort((place[alive], rank))
        alive, rank = alive[order], rank[order]
        starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        group = np.cumsum(np.append(False, rank[1:] != rank[:-1]))
        low = place[alive[starts]][group]
        later = place[alive] > low
        length[alive[later]], source[alive[later]] = done, low[later]
        stay = (np.diff(np.append(starts, len(alive)))[group] > 1) & (left[alive] > done)
        alive, group = alive[stay], group[stay]
        rank = group * (len(hashes) + 1) + single[alive + done] if len(alive) else rank[:0]
        done += 1
    return length, source


def parsed(sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The suffixes at which the greedy parse of every segment starts a factor.

    After a factor the parse goes on with the windows over its end; those without a match are passed one by one.
    """
    end = np.cumsum(sizes)
    at, out = end - sizes, []
    while True:
        open_ = at < end
        at, end = at[open_], end[open_]
        if not len(at):
            return np.sort(np.concatenate(out)) if out else at
        out.append(at[length[at] > 0])
        at = at + np.maximum(length[at], 1)


def _factored(classes: DataFrame) -> DataFrame:
    """Factors of the segments of blocks, which stand together in a partition: anchor, content, k (first window of
    the factor in its segment), windows, and the place of its reference.

    Where a block has several parts, windows that its part has for the first time come too, with their hash and
    without a reference.
    """
    place = T.StructType([T.StructField("doc_id", classes.schema["first"].dataType["doc_id"].dataType), T.StructField("start", T.IntegerType())])
    schema = T.StructType(
        [
            classes.schema["anchor"],
            classes.schema["content"],
            T.StructField("k", T.IntegerType()),
            T.StructField("windows", T.IntegerType()),
            T.StructField("hash", T.LongType()),
            T.StructField("first", place),
            T.StructField("source", place),
        ]
    )
    arrow = to_arrow(schema)

    def parse(rows: pa.Table) -> pa.RecordBatch:
        anchor, part = rows["anchor"].to_numpy(), rows["part"].to_numpy()
        block = np.cumsum(np.append(False, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
        lists, at = rows["hashes"].combine_chunks(), rows["first"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        hashes = lists.flatten().to_numpy()
        names = at.field("doc_id")
        rank = pc.rank(names, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        name_of = np.zeros(int(rank.max()) + 1, np.int64)
        name_of[rank] = np.arange(len(rank))
        length, source = longest_matches(block, sizes, hashes, (rank << 32) + at.field("start").to_numpy())
        factor = parsed(sizes, length)
        several = np.repeat(rows["parts"].to_numpy() > 1, sizes)
        fresh = np.flatnonzero(several & (length == 0))
        chosen = np.concatenate([factor, fresh])
        segment = np.repeat(np.arange(len(sizes)), sizes)[chosen]
        k = chosen - (np.cumsum(sizes) - sizes)[segment]
        none = np.arange(len(chosen)) >= len(factor)
        own = names.take(pa.array(segment)), pa.array(at.field("start").to_numpy()[segment] + k, pa.int32())
        of = names.take(pa.array(name_of[source[chosen] >> 32])), pa.array(source[chosen] & 0xFFFFFFFF, pa.int32())
        columns = [
            rows["anchor"].combine_chunks().take(pa.array(segment)),
            rows["content"].combine_chunks().take(pa.array(segment)),
            pa.array(k, pa.int32()),
            pa.array(length[chosen], pa.int32()),
            pa.array(hashes[chosen], pa.int64()),
            pa.StructArray.from_arrays(own, fields=list(arrow.field("first").type)),
            pa.StructArray.from_arrays(of, fields=list(arrow.field("source").type), mask=pa.array(none)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            anchor, part = rows["anchor"].to_numpy(), rows["part"].to_numpy()
            edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))
            if len(edge):  # the last block may go on in the next batch
                cut = int(edge[-1]) + 1
                yield parse(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut).combine_chunks().to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield parse(rows.combine_chunks())

    return classes.mapInArrow(run, schema)


def _joined(spans: pa.StructArray, window: int) -> list[dict]:
    """The factors of a document: spans of its segments in order, those that go on in the same reference as one."""
    start, windows = spans.field("start").to_numpy(), spans.field("windows").to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), (start + windows + window - 1)[order]
    shift = spans.field("ref_start").to_numpy()[order] - start
    names = spans.field("ref_doc").dictionary_encode(null_encoding="encode")
    doc = names.indices.to_numpy()[order]
    again = (doc[1:] == doc[:-1]) & (shift[1:] == shift[:-1]) & (start[1:] <= end[:-1] - window + 1)
    first = np.flatnonzero(np.append(True, ~again))
    length = end[np.append(first[1:], len(end)) - 1] - start[first]
    known = names.dictionary.to_pylist()
    columns = start[first], length, doc[first], (start + shift)[first]
    return [dict(start=a, length=n, ref_doc=known[d], ref_start=r) for a, n, d, r in zip(*(c.tolist() for c in columns), strict=True)]


def covered(n_words: int, factors: list[dict]) -> np.ndarray:
    """Which words the factors cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, [f["start"] for f in factors], 1)
    np.add.at(edge, [f["start"] + f["length"] for f in factors], -1)
    return np.cumsum(edge)[:-1] > 0


def remove_duplicates(docs: DataFrame, scratch: Scratch, window: int = 20, block: int = BLOCK) -> DataFrame:
    """doc_id, tie (hash of the text), n_words, n_removed, factors, kept_sha256 (of the words left, joined by one
    space), and kept (those words; null if the text loses none and so stays as it is).

    factors: array<struct<start, length, ref_doc, ref_start>> in words of the document and of an earlier one.
    """
    docs = id_and_text(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketch = scratch.table(_sketch(docs, window), "sketch")
    # Small tables are written before they are joined, so that Spark can split the most frequent keys of both sides.
    shared = scratch.table(sketch.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    found = sketch.join(shared, "anchor").groupBy(F.col("doc_id").alias("found_id"))
    found = scratch.table(found.agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("found")), "found")
    scratch.drop("sketch", "shared")

    tied = docs.withColumn("tie", F.xxhash64("text"))
    asked = tied.join(found, tied["doc_id"].eqNullSafe(found["found_id"]))
    parts = _window_hashes(asked, window).select(
        F.struct("doc_id", "start").alias("at"),
        "tie",
        "anchor",
        F.struct(F.size("hashes").alias("windows"), F.col("hashes")[0].alias("low"), F.element_at("hashes", -1).alias("high")).alias("content"),
        "hashes",
    )
    parts = scratch.table(parts, "parts")
    scratch.drop("found")
    classes = parts.groupBy("anchor", "content").agg(F.min("at").alias("first"), F.first("hashes").alias("hashes"), F.count("*").alias("n"))
    classes = scratch.table(classes, "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    several = scratch.table(several.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("parts")), "several")
    blocks = classes.join(several, "anchor").select("anchor", "content", "first", "hashes", "parts")
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    bound_batches(docs.sparkSession)
    blocks = blocks.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    factors = scratch.table(_factored(blocks), "factors")
    scratch.drop("several")

    # Windows that several parts of a block have for the first time: all but the earliest are factors too.
    fresh = factors.where("source IS NULL")
    earliest = fresh.groupBy("anchor", "hash").agg(F.min("first").alias("low"), F.count("*").alias("n")).where("n > 1")
    earliest = scratch.table(earliest.drop("n"), "earliest")
    across = fresh.drop("source", "windows").join(earliest, ["anchor", "hash"]).where(F.col("first") > F.col("low"))
    across = across.select("anchor", "content", "k", F.lit(1).alias("windows"), F.col("low").alias("source"))
    every = factors.where("source IS NOT NULL").select("anchor", "content", "k", "windows", "source").unionByName(across)
    span = F.struct("k", "windows", F.col("source.doc_id").alias("ref_doc"), F.col("source.start").alias("ref_start"))
    again = every.groupBy("anchor", "content").agg(F.collect_list(span).alias("again"))
    again = scratch.table(again, "again")
    scratch.drop("factors", "earliest")

    known = classes.select("anchor", "content", "first", "n").join(again, ["anchor", "content"], "left")
    # Classes that came once and hold no factor are done.
    known = scratch.table(known.where((F.col("n") > 1) | F.col("again").isNotNull()), "known")
    scratch.drop("classes", "again")
    kind = f"array<struct<k:int,windows:int,ref_doc:{id_type},ref_start:int>>"
    whole = F.array(
        F.struct(
            F.lit(0).alias("k"),
            F.col("content.windows").alias("windows"),
            F.col("first.doc_id").alias("ref_doc"),
            F.col("first.start").alias("ref_start"),
        )
    ).cast(kind)
    hits = parts.drop("hashes").join(known, ["anchor", "content"])
    hits = hits.select("at", "tie", F.explode(F.when(F.col("at") > F.col("first"), whole).otherwise(F.col("again").cast(kind))).alias("w"))
    span = F.struct((F.col("at.start") + F.col("w.k")).alias("start"), "w.windows", "w.ref_doc", "w.ref_start")
    hits = hits.groupBy(F.col("at.doc_id").alias("hit_id"), F.col("tie").alias("hit_tie"))
    hits = scratch.table(hits.agg(F.collect_list(span).alias("spans")), "hits")
    scratch.drop("parts", "known")

    factor = f"array<struct<start:bigint,length:bigint,ref_doc:{id_type},ref_start:bigint>>"
    schema = fields(docs, ("tie", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("factors", factor), ("kept_sha256", "string"), ("kept", "string"))
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow.names[2:]]
            spans = batch.column("spans")
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                own = spans[i].values
                factors, removed, left = [], 0, words
                if own is not None and len(own):
                    factors = _joined(own, window)
                    gone = covered(len(words), factors)
                    removed, left = int(gone.sum()), list(compress(words, (~gone).tolist()))
                kept = b" ".join(left)
                text_left = kept.decode("utf-8", "surrogatepass") if removed else None
                for column, value in zip(out, (len(words), removed, factors, hashlib.sha256(kept).hexdigest(), text_left), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), batch.column("tie"), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = tied.join(hits, tied["doc_id"].eqNullSafe(F.col("hit_id")) & (F.col("tie") == F.col("hit_tie")), "left")
    return rows.select("doc_id", "tie", "text", "spans").mapInArrow(run, schema)

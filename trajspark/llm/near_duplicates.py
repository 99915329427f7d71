"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

A document is the set of its distinct shingles (runs of words, A-Z in lower case). Two permutations make the whole
signature: the first scatters the shingles over 2^32 places; the second is read circularly shifted by k to give
coordinate k. Coordinates are cut into bands.

1. Sets are told apart by a 128-bit digest; documents with equal sets are one node from here on.
2. Nodes that share a band meet in a bucket. Each is linked to the bucket's smallest node if their whole sets agree
   well enough; a bucket of n nodes so costs n - 1 checks.
3. Components of these links join most buckets into one. Buckets that still hold nodes of different components
   check them against a node drawn at random, another in each bucket, TURNS times over: as linear as step 2.
4. In buckets that even then hold several components, pairs across components are checked too, if they can be
   links: sizes, what a set can share at most (shingles that another open node has), and how many shingles of each
   bin of hashes two sets have rule most of them out, none of them wrongly; only verified links leave that step.

One chance of losing a link remains, that of banding: a pair just at the limit shares no band. Bands have as many
coordinates as keep it below MISS, taken with independent coordinates: 32 bands of 5 at 0.85 (7e-9), 40 of 4 at 0.8
(7e-10).

Null and empty texts, and texts without words, have no shingle and are linked with nothing. Texts with fewer words
than a shingle have their whole sequence as one. Very long texts are taken whole: a set is one row. Repeated rows are
duplicates of each other. Rows with a null doc_id take part; a component's id is its smallest doc_id that isn't null,
so of several rows with that id all are kept. Ties of digests can't be: equal sets are one node. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fields, id_and_text, per_batch
from .graph import components
from .shingles import BASE, hashed, in_chunks, mixed, rolling

#: Coordinates of a signature, and the largest chance of a pair at the limit to share no band.
COORDINATES, MISS = 160, 1e-8

#: Shingles of a chunk of a large bucket, and bits of a bin of hashes.
CHUNK, BIN_BITS = 1 << 19, 9

#: Rounds in which every bucket with several components checks its nodes against one drawn at random.
TURNS = 2


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [text.encode("utf-8", "surrogatepass").lower().split() for text in texts]
    counts = [len(w) for w in words]
    hashes = hashed([w for own in words for w in own])
    grams = mixed(rolling(hashes, size)) if len(hashes) >= size else hashes[:0]
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            with np.errstate(over="ignore"):
                short = rolling(hashes[at : at + n], n) * BASE + np.uint64(n)
            out.append(mixed(short))
        else:
            out.append(hashes[:0])
        at += n
    return out


def layout(percent: int) -> tuple[int, int]:
    """Bands and coordinates of a band: the longest bands whose chance to miss a pair at the limit is small enough."""
    for rows in (8, 5, 4, 2):
        if (1 - (percent / 100) ** rows) ** (COORDINATES // rows) <= MISS:
            return COORDINATES // rows, rows
    return COORDINATES, 1


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash signatures (set x coordinate) of non-empty sets from one circularly shifted permutation."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    # The first permutation; the hashes are already spread, so their upper half is the place.
    place = (mixed(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=x)  # the shift wraps around at 2^32
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA6B), out=x)
            np.right_shift(x, np.uint32(13), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0xC2B2AE35), out=x)
            out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of every band."""
    own = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), own.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mixed(key * BASE + own[:, :, k])
    return key.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, node (digest of the set), bands."""
    schema = fields(docs, ("tie", "bigint"), ("n_shingles", "bigint"), ("node", "binary"), ("bands", "array<bigint>"))
    cut = layout(percent)

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": rows["doc_id"], "tie": rows["tie"], "n_shingles": [], "node": [], "bands": []}
        for a, b in in_chunks(rows["text"], 1 << 19):
            sets = shingle_sets(rows["text"][a:b], size)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full), *cut) if full else ())
            for own in sets:
                out["n_shingles"].append(len(own))
                out["node"].append(_digest(own) if len(own) else None)
                out["bands"].append(next(keys) if len(own) else None)
        return out

    return per_batch(id_and_text(docs).withColumn("tie", F.xxhash64("text")), run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """node and the whole set of shingles of every document."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"node": [], "shingles": []}
        for a, b in in_chunks(rows["text"]):
            for own in shingle_sets(rows["text"][a:b], size):
                out["node"].append(_digest(own) if len(own) else None)
                out["shingles"].append(own.view(np.int64))
        return out

    return per_batch(docs.select("text"), run, schema).where(F.col("node").isNotNull())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("n"), (F.size("x").cast("long") + F.size("y")).alias("m"))
        .where(100 * F.col("n") >= percent * (F.col("m") - F.col("n")))
        .select("a", "b")
    )


def _unsettled(members: DataFrame, joined: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of buckets whose nodes are in more than one component so far, with the component as label.

    Their keys are written before rows meet them, so that Spark knows their size and can split a frequent key's rows.
    """
    rows = members.join(joined, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    open_keys = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    return rows.join(scratch.table(open_keys.select("key"), f"keys_{name}"), "key", "left_semi")


def _reach(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n (size of its set), reach (its shingles that another of these nodes has too)."""
    own = sets.join(nodes, "node", "left_semi")
    lonely = own.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
    lonely = lonely.agg(F.min("node").alias("node"), F.count("*").alias("c")).where("c = 1")
    lonely = lonely.groupBy("node").agg(F.count("*").alias("alone"))
    n = F.size("shingles").cast("long")
    rows = own.select("node", n.alias("n")).join(lonely, "node", "left")
    return rows.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("reach"))


def _possible(n, reach, m, reached, percent: int):
    """Whether two sets can be similar enough, by their sizes and what each can share at most."""
    most = F.least(reach, reached)
    return 100 * most >= percent * (n + m - most)


def _other_stars(rest: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each unsettled bucket's nodes with one of them drawn at random, where components differ."""
    drawn = F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("draw"), "node", "label", "n", "reach"))
    pivots = rest.groupBy("key").agg(drawn.alias("p"))
    fits = _possible(F.col("n"), F.col("reach"), F.col("p.n"), F.col("p.reach"), percent)
    pairs = rest.join(pivots, "key").where((F.col("label") != F.col("p.label")) & fits)
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _chunked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets cut into chunks of about CHUNK shingles; a row comes once for each pair of chunks (low, high) that it
    is in. Keys and sizes only, written before whole sets are joined to them."""
    sizes = rows.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    sizes = scratch.table(sizes, "sizes")  # written, so that Spark can split the rows of a frequent key
    rows = rows.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    return scratch.table(rows.drop("chunks", "other"), "chunks")


def _rest_links(rows: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b) of a bucket's nodes from different components; only links leave the comparison.

    A pair is looked at in the first bucket that it shares, if sizes, reach and bins leave a link possible: two sets
    share at most the smaller number of shingles of each bin. Every two chunks of a bucket meet once.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        key, low, high = frame["key"].iat[0], frame["low"].iat[0], frame["high"].iat[0]
        bands, shingles = np.stack(frame["bands"]), frame["shingles"].tolist()
        in_bin = lambda own: np.bincount((np.asarray(own).view(np.uint64) >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
        bins = np.stack([in_bin(own).astype(np.int32) for own in shingles])
        n, reach, label = frame["n"].to_numpy(), frame["reach"].to_numpy(), pd.factorize(frame["label"])[0]
        node, chunk = frame["node"].tolist(), frame["chunk"].to_numpy()
        pairs = []
        for i in np.flatnonzero(chunk == low):
            later = np.arange(len(frame)) > i if low == high else chunk == high
            most = np.minimum(reach, reach[i])
            near = np.flatnonzero(later & (label != label[i]) & (100 * most >= percent * (n + n[i] - most)))
            if not len(near):
                continue
            near = near[bands[i][(bands[near] == bands[i]).argmax(1)] == key]
            most = np.minimum(bins[near], bins[i]).sum(1)
            for j in near[100 * most >= percent * (n[near] + n[i] - most)].tolist():
                both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    pairs.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(pairs, columns=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles, component_id (smallest doc_id reachable over links), and kept
    (doc_id is that)."""
    sketches = scratch.table(sketch(docs, size, percent), "sketches")
    nodes = (
        sketches.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
    )
    nodes = scratch.table(nodes, "nodes")
    spread = nodes.select(F.explode("bands").alias("key"), "node")
    pivots = spread.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("count")).where("count > 1")
    pivots = scratch.table(pivots.drop("count"), "pivots")
    members = scratch.table(spread.join(pivots, "key"), "members")

    wanted = members.select("node").distinct()
    of_docs = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("wanted_id"))
    texts = id_and_text(docs)
    texts = texts.join(of_docs.distinct(), texts["doc_id"].eqNullSafe(F.col("wanted_id")), "left_semi")
    # Of repeated rows of one doc_id some may have other sets; equal sets are kept once.
    sets = _sets(texts, size).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = scratch.table(sets, "sets")

    lengths = nodes.select(F.col("node").alias("at"), "n")
    stars = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(lengths.select(F.col("at").alias("a"), F.col("n").alias("na")), "a")
    stars = stars.join(lengths.select(F.col("at").alias("b"), F.col("n").alias("nb")), "b")
    stars = stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    links = scratch.table(_verified(stars, sets, percent), "star_links")
    joined = components(links, scratch, "first")

    joined = scratch.table(joined, "joined")
    # Only nodes of unsettled buckets can still be linked, and a shingle that just one of them has is in no
    # intersection: `reach` bounds what a node can share. Nodes that can't reach the similarity at all are done.
    rest = scratch.table(_unsettled(members.select("key", "node"), joined, scratch, "all").drop("label"), "unsettled")
    reach = scratch.table(_reach(rest.select("node").distinct(), sets), "reach")
    rest = scratch.table(rest.join(reach.where(100 * F.col("reach") >= percent * F.col("n")), "node"), "open")
    for turn in range(TURNS + 1):
        own = scratch.table(_unsettled(rest, joined, scratch, str(turn)), f"rest_{turn}")
        if own.isEmpty():
            break
        if turn < TURNS:
            more = _verified(_other_stars(own, turn, percent), sets, percent)
        else:
            chunks = _chunked(own, scratch)
            more = _rest_links(chunks.join(nodes.select("node", "bands"), "node").join(sets, "node"), percent)
        more = scratch.table(more, f"links_{turn}")
        if not more.isEmpty():
            roots = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
            joined = scratch.table(components(roots.union(more), scratch, f"again_{turn}"), f"joined_{turn}")
    scratch.drop("sets", "members", "unsettled", "reach", "open", "star_links", "sizes", "chunks", "pivots", *[f"rest_{i}" for i in range(TURNS + 1)])

    placed = nodes.select("node", "doc_id").join(joined, "node", "left")
    placed = placed.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = placed.join(lowest, "root").select("node", "component_id")
    out = sketches.select("doc_id", "tie", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "tie", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

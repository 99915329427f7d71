"""Approximate nearest neighbours by cosine over shifted Hilbert curves.

Unit vectors are projected several times onto a few random orthogonal directions and shifted; a Hilbert curve
orders each projection. Spark range-partitions and sorts the rows of each curve and cuts them into blocks of equal
size. A query looks at a window of blocks around its own on every curve; what it meets there is reranked by exact
cosine on the original vectors, and the windows' results are merged.

How wide the windows must be depends on the data: where vectors have no structure, neighbours are spread over the
whole curve and windows cover most of the table; where they lie in clusters, a few blocks do. So a bounded sample of
queries is searched exhaustively first, and the narrowest window that finds TARGET of their true neighbours is used
for all queries. A second sample, which the width is not fitted on, gives `held_out_recall`: the share of its true
neighbours that lie in those windows (null if the table has no queries beyond the first sample). A block is a 64th of
the table, between LEAST and MOST vectors, so small tables have many blocks too.

Equal vectors are one row of the index, with as many of their smallest ids as a result can need; a vector that
fills a third of the table so fills no block. Vectors that are null, zero, or hold null or non-finite components, or
without an id take no part. A cosine needs equal lengths: vectors of each length are searched among themselves, length
by length. Vectors are scaled by a power of two before products are
taken, so that very large and very small components neither overflow nor vanish; cosines are not changed by that.
Repeated ids count once for each distinct vector; equal scores are ranked by vec_id. An empty table, or one without
a valid vector, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, to_arrow

#: Curves, directions of a projection, bits of a coordinate.
CURVES, DIRECTIONS, BITS = 8, 8, 7

#: Fewest and most vectors of a block.
LEAST, MOST = 16, 1024

#: Queries searched exhaustively to fit the windows' width (and as many to measure it), and what share of their
#: neighbours windows must find.
TRIAL_QUERIES, TARGET = 128, 0.96


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve through a grid of 2^bits cells a side (row x coordinate); a public algorithm
    for any number of dimensions by exchanging and inverting low bits."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for bit in reversed(range(1, bits)):
        low = (1 << bit) - 1
        for i in range(n):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in reversed(range(1, bits)):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> bit) & 1)
    return key


class Curves:
    """The projections and shifts for vectors of one length; `fit` sets the projections' ranges."""

    def __init__(self, width: int, curves: int = CURVES, seed: int = 7):
        random = np.random.default_rng(seed)
        self.n, self.directions = curves, min(DIRECTIONS, width)
        self.project = [np.linalg.qr(random.normal(size=(width, self.directions)))[0] for _ in range(curves)]
        self.shift = [random.uniform(0, 0.5, self.directions) for _ in range(curves)]

    def ends(self, unit: np.ndarray) -> np.ndarray:
        """The smallest and largest projection on every direction of every curve."""
        seen = np.hstack([unit @ p for p in self.project])
        return np.stack([seen.min(0), seen.max(0)])

    def fit(self, ends: np.ndarray) -> Curves:
        self.low = np.split(ends[0], self.n)
        self.range = np.split(np.maximum(ends[1] - ends[0], 1e-9), self.n)
        return self

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        place = (unit @ self.project[curve] - self.low[curve]) / self.range[curve] + self.shift[curve]
        cells = np.clip((place / 1.5 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return hilbert(cells, BITS)


def fitted(vectors: DataFrame, width: int, curves: int) -> Curves:
    """Curves whose ranges are those of all vectors; each task returns two numbers for each direction."""
    own = Curves(width, curves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [own.ends(units(matrix(b.column("vector").to_pylist()))) for b in batches if b.num_rows]
        if found:
            low, high = np.min([x[0] for x in found], 0), np.max([x[1] for x in found], 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    ends = vectors.select("vector").mapInArrow(run, "i int, low double, high double").groupBy("i")
    rows = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    return own.fit(np.array([[r["low"] for r in rows], [r["high"] for r in rows]]))


def matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to 0.5..1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = scaled(a), scaled(b)
    top = np.einsum("ij,ij->i", a, b)
    return top / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)


def lengths(rows: DataFrame) -> list[int]:
    """The different lengths of vectors: a number each, of which a table has few."""
    return sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vector (little-endian doubles) and its `keep` smallest ids; batches combine their equal vectors first."""
    bound_batches(rows.sparkSession, 4096)
    schema = T.StructType([T.StructField("vector", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            whole = np.ascontiguousarray(whole + 0.0, "<f8")
            ids: dict[bytes, list[int]] = {}
            for name, vector in zip(batch.column("vec_id").to_pylist(), whole, strict=True):
                ids.setdefault(vector.tobytes(), []).append(name)
            few = [sorted(set(x))[:keep] for x in ids.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=["vector", "ids"])

    local = rows.mapInArrow(run, schema)
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return local.groupBy("vector").agg(ids.alias("ids"))


def best(queries: np.ndarray, own: list[int], unit_q: np.ndarray, rows: np.ndarray, unit: np.ndarray, ids: list, k: int) -> Iterator[tuple]:
    """(query id, vec_id, score) of the k best rows of each query; own ids don't count."""
    for at in range(0, len(queries), 256):
        near = unit_q[at : at + 256] @ unit.T
        take = min(len(rows), k + 2)
        part = np.argpartition(-near, take - 1, axis=1)[:, :take] if take < len(rows) else np.tile(np.arange(len(rows)), (len(near), 1))
        # All rows as near as the last one taken, up to rounding, so that ties are decided by id.
        edge = np.take_along_axis(near, part, 1).min(1) - 1e-12
        for i in range(len(near)):
            some = part[i] if len(rows) <= take else np.flatnonzero(near[i] >= edge[i])
            query = queries[at + i]
            score = cosines(np.broadcast_to(query, (len(some), len(query))), rows[some])
            found = [(-s, name) for s, j in zip(score.tolist(), some.tolist(), strict=True) for name in ids[j] if name != own[at + i]]
            for s, name in sorted(found)[:k]:
                yield own[at + i], name, -s


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def index(vectors: DataFrame, curves: Curves, scratch: Scratch, block: int) -> DataFrame:
    """curve, block, vector, ids: every vector once on each curve; blocks are numbered along their curve."""
    schema = T.StructType(
        [
            T.StructField("curve", T.IntegerType()),
            T.StructField("key", T.LongType()),
            *vectors.schema.fields,
        ]
    )
    arrow = to_arrow(schema)
    shared = vectors.sparkSession.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = units(matrix(batch.column("vector").to_pylist()))
                for curve in range(shared.value.n):
                    keys = pa.array(shared.value.keys(unit, curve))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), curve, np.int32)), keys, *batch.columns], schema=arrow)

    kept = T.StructType(
        [
            T.StructField("curve", T.IntegerType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.LongType()),
            *vectors.schema.fields,
        ]
    )
    kept_arrow = to_arrow(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            number = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                mine = curve == c
                number[mine] = (seen.get(c, 0) + np.arange(mine.sum())) // block
                seen[c] = seen.get(c, 0) + int(mine.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("curve"), pa.array(np.full(len(curve), part, np.int32)), pa.array(number), *batch.columns[2:]], schema=kept_arrow
            )

    ranges = max(1, -(-vectors.count() * curves.n // (8 * block)))
    sorted_rows = (
        scratch.table(vectors.mapInArrow(place, schema), "placed")
        .repartitionByRange(ranges, "curve", "key", "vector")
        .sortWithinPartitions("curve", "key", "vector")
    )
    table = scratch.table(sorted_rows.mapInArrow(cut, kept), "index")
    blocks = table.select("curve", "part", "number").distinct()
    order = Window.partitionBy("curve").orderBy("part", "number")
    blocks = blocks.withColumn("block", (F.row_number().over(order) - 1).cast("int"))
    out = scratch.table(table.join(blocks, ["curve", "part", "number"]).drop("part", "number"), "blocks")
    scratch.drop("placed", "index")
    return out


def _exhaustive(queries: pd.DataFrame, vectors: DataFrame, k: int) -> pd.DataFrame:
    """True neighbours of a bounded set of queries, which is sent to every batch of vectors."""
    schema = "query_id bigint, vec_id bigint, score double"
    own, rows = queries["query_id"].tolist(), matrix(queries["vector"].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                x = matrix(frame["vector"].tolist())
                yield pd.DataFrame(best(rows, own, units(rows), x, units(x), frame["ids"].tolist(), k), columns=["query_id", "vec_id", "score"])

    return _top(vectors.select("vector", "ids").mapInPandas(run, schema), k).toPandas()


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _half_width(trial: pd.DataFrame, vectors: DataFrame, table: DataFrame, k: int) -> tuple[int, float | None]:
    """Blocks to each side that find TARGET of the true neighbours of the first TRIAL_QUERIES on some curve, and the
    share of the other queries' neighbours that they find."""
    true = _exhaustive(trial, vectors, k)
    if not len(true):
        return 0, None
    wanted = sorted({*true["vec_id"].tolist(), *trial["query_id"].tolist()})
    spark = table.sparkSession
    names = F.broadcast(spark.createDataFrame([(x,) for x in wanted], "vec_id long"))  # 2 * TRIAL_QUERIES * (k + 1) ids at most
    seen = table.select("curve", "block", F.explode("ids").alias("vec_id")).join(names, "vec_id").toPandas()
    blocks = seen.pivot_table(index="vec_id", columns="curve", values="block", aggfunc="first")
    known = true[true["vec_id"].isin(blocks.index) & true["query_id"].isin(blocks.index)]
    gap = np.abs(blocks.loc[known["query_id"]].to_numpy() - blocks.loc[known["vec_id"]].to_numpy()).min(1)
    first = known["query_id"].isin(trial["query_id"].head(TRIAL_QUERIES)).to_numpy()
    half = int(np.quantile(gap[first], TARGET, method="higher")) if first.any() else 0
    return half, float((gap[~first] <= half).mean()) if (~first).any() else None


def _queries(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """query_id, vector of rows, once for each distinct vector."""

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = [v.tobytes() for v in np.ascontiguousarray(x + 0.0, "<f8")]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.binary())], names=["query_id", "vector"])

    named = rows.dropDuplicates(["vec_id", "embedding"])
    return scratch.table(named.select("vec_id", "embedding").mapInArrow(as_bytes, "query_id bigint, vector binary"), "queries")


def search(rows: DataFrame, every: int, k: int, scratch: Scratch, curves: int = CURVES, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, held_out_recall: the k nearest found of every vector whose id is divisible by
    `every`."""
    rows = valid(rows)
    own = lengths(rows.where(F.col("vec_id") % every == 0))
    at = lambda n: scratch if len(own) == 1 else scratch.child(f"length_{n}")
    parts = [_search(rows.where(F.size("embedding") == n), n, every, k, at(n), curves, block) for n in own]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, held_out_recall double")
    return reduce(DataFrame.unionByName, parts)


def _search(rows: DataFrame, length: int, every: int, k: int, scratch: Scratch, curves: int, block: int | None) -> DataFrame:
    vectors = scratch.table(distinct_vectors(rows, k + 1), "vectors")
    queries = _queries(rows.where(F.col("vec_id") % every == 0), scratch)
    block = block or max(LEAST, min(MOST, vectors.count() // 64))
    table = index(vectors, fitted(vectors, length, curves), scratch, block)
    trial = queries.orderBy(F.xxhash64("query_id"), "vector").limit(2 * TRIAL_QUERIES).toPandas()
    half, share = _half_width(trial, vectors, table, k)

    # Where a query stands on each curve; equal vectors stand at one place.
    stands = table.select("curve", "block", "vector").join(queries, "vector")
    window = F.sequence(F.col("block") - half, F.col("block") + half)
    asked = stands.select("curve", F.explode(window).alias("block"), "query_id", "vector")
    # Many queries may share a vector; chunks of them keep the rows of a group bounded.
    busy = asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / 4096).cast("int").alias("chunks"))
    busy = scratch.table(busy.where(F.col("block") >= 0), "busy")
    asked = asked.join(busy, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))
    held = table.join(busy, ["curve", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["curve", "block", "chunk"]

    def rerank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            a, x = matrix(q["vector"].tolist()), matrix(c["vector"].tolist())
            out = list(best(a, q["query_id"].tolist(), units(a), x, units(x), c["ids"].tolist(), k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    asked = scratch.table(asked.select(*keys, "query_id", "vector"), "asked")
    near = asked.groupBy(*keys).cogroup(held.select(*keys, "vector", "ids").groupBy(*keys))
    found = near.applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(share).cast("double").alias("held_out_recall"))


def recall(found: DataFrame, rows: DataFrame, every: int, k: int, scratch: Scratch, queries: int = TRIAL_QUERIES) -> float:
    """The share of true neighbours in a result of `search`, over queries that its windows were not fitted on (the
    next ones in the order in which those were taken), among vectors of the greatest length; 1 if there are none."""
    rows = valid(rows)
    rows = rows.where(F.size("embedding") == max(lengths(rows), default=0))
    vectors = scratch.table(distinct_vectors(rows, k + 1), "recall_vectors")
    order = _queries(rows.where(F.col("vec_id") % every == 0), scratch).orderBy(F.xxhash64("query_id"), "vector")
    aside = order.offset(TRIAL_QUERIES).limit(queries).toPandas()
    if not len(aside):
        return 1.0
    true = set(map(tuple, _exhaustive(aside, vectors, k)[["query_id", "vec_id"]].to_numpy().tolist()))
    wanted = F.col("query_id").isin([int(x) for x in aside["query_id"]])
    got = {(r["query_id"], r["vec_id"]) for r in found.where(wanted).select("query_id", "vec_id").toLocalIterator()}
    return len(true & got) / max(1, len(true))

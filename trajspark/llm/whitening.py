"""Whitening of vectors by a tall-and-skinny QR, without forming a covariance.

Entries become whole numbers first, so column sums are exact, and rows are centred by them: an entry less the whole part
of its mean is a whole number, and only the rest of the mean, below one, is taken off as a double. Each task folds its centred
rows into one triangular R by QR, batch by batch; R factors are stacked and factored again in groups of FAN_IN, as a
tree, until one is left, whose size is that of a vector's dimensions. The right singular vectors of that R are the
eigenvectors of the covariance, its squared singular values over n the eigenvalues, to double precision.

Vectors that are null or hold a null or non-finite entry take no part and give no rows; nor do those with an entry
whose whole number doesn't fit (beyond LIMIT), and, where lengths differ, those of another length than the most frequent
one (of equally frequent ones the longest), since they have no place in the same matrix. Vectors without entries give no
rows. Repeated rows count as often as they are there; rows with a null id stay. Directions without spread (a constant
dimension, fewer vectors than dimensions) are components with `whitened` null. Equal eigenvalues keep the order that
the factoring gives, the same for all rows of a run. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: R factors that are stacked for one QR.
FAN_IN = 16
#: Largest whole number of an entry, to either side.
LIMIT = 1 << 50


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  # of each dimension's whole numbers
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float
    rank: int  # eigenvalues that are more than rounding


def whole(entry: Column) -> Column:
    """64ths, moved by a million."""
    return F.floor(entry.cast("double") * 64).cast("long") + 1_000_000


def usable(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys and the whole numbers of vectors that can take part, of any length, as `_x`."""
    v = F.col(vector)
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LIMIT / 64)
    rows = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", fits))
    return rows.select(*keys, F.transform("_v", whole).alias("_x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix of long."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    low = np.array([s // n for s in sums])
    return (x - low) - np.array([s % n / n for s in sums])


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and each dimension's sum of `_x`. One row a task and dimension is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for _, x in _blocks(batches):
            # Halves of the numbers, so that no sum of a batch leaves a long.
            own = [(int(a) << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & (1 << 26) - 1).sum(0), strict=True)]
            n, sums = n + len(x), own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if n:
            out = [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(out, names=["dim", "n", "s"])

    found = rows.select("_x").mapInArrow(run, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_dim = sorted(found.collect(), key=lambda r: r["dim"])  # as many rows as dimensions
    return (by_dim[0]["n"] if by_dim else 0), [int(r["s"]) for r in by_dim]


def merged_r(rows: DataFrame, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """The R factor of all centred rows: one a task, then a tree of groups of FAN_IN."""
    d = len(sums)
    kind = "place int, r array<double>"

    def packed(place: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["place", "r"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for _, x in _blocks(batches):
            own = _centred(x, sums, n)
            r = np.linalg.qr(own if r is None else np.vstack([r, own]), mode="r")
        if r is not None:
            yield packed(TaskContext.get().partitionId(), r)

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, d)) for x in group.column("r").to_pylist()]), mode="r")
        return pa.Table.from_batches([packed(group.column("place")[0].as_py() // FAN_IN, r)])

    factors = scratch.table(rows.select("_x").mapInArrow(fold, kind), "factors")
    tasks = factors.agg(F.max("place")).head()[0] + 1
    while tasks > 1:
        factors = factors.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(merge, kind)
        tasks = -(-tasks // FAN_IN)
    return np.array(factors.head()["r"]).reshape(-1, d)


def fit(rows: DataFrame, scratch: Scratch) -> Fit | None:
    """What whitens the rows of `usable`, which have one length; None if there are none."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    _, s, v = np.linalg.svd(merged_r(rows, n, sums, scratch), full_matrices=True)
    s = np.pad(s, (0, len(sums) - len(s)))
    values = s * s / n
    rank = int((s > 8 * len(sums) * np.finfo(float).eps * s[0]).sum())
    return Fit(n, sums, values, v.T, float(values.sum()), rank)


def _project(model: Fit, x: np.ndarray, components: int) -> np.ndarray:
    k = min(components, model.rank)
    return _centred(x, model.sums, model.n) @ (model.vectors[:, :k] / np.sqrt(model.values[:k]))


def identity_error(rows: DataFrame, model: Fit, components: int) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity; sums of products by task, then over tasks."""
    k = min(components, model.rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches):
            w = _project(model, x, components)
            products, sums = products + w.T @ w, sums + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(products, sums)], pa.list_(pa.float64()))], names=["s"])

    if not k:
        return None
    each = rows.select("_x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    found = each.groupBy("i").agg(F.sum("s").alias("s")).collect()  # k * (k + 1) rows
    total = np.array([r["s"] for r in sorted(found, key=lambda r: r["i"])]) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(model: Fit, x: np.ndarray) -> list[Decimal]:
    low, rest = np.array([s // model.n for s in model.sums]), np.array([s % model.n for s in model.sums])
    x = x - low
    if x.shape[1] * (model.n * (int(np.abs(x).max()) + 1)) ** 2 >= 1 << 62:
        x, rest = x.astype(object), rest.astype(object)
    return [Decimal(int(v)) for v in ((model.n * x - rest) ** 2).sum(1)]


def whiten(rows: DataFrame, vector: str, keys: list[str], scratch: Scratch, components: int = 32) -> DataFrame:
    """keys, component (from 1), n, deviation (exact, as a decimal), whitened, explained and identity_error of every
    row that takes part and each of the first components."""
    spark = rows.sparkSession
    bound_batches(spark)
    own = usable(rows, vector, keys)
    most = own.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))).head()[0]
    own = own.where(F.size("_x") == (most["d"] if most else 0))
    model = fit(own, scratch)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None:
        kinds = dict(zip(names, ("int", "long", "decimal(38,0)", "double", "double", "double"), strict=True))
        return own.where("false").select(*keys, *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    shown = min(components, len(model.sums))
    error = identity_error(own, model, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            w = _project(model, x, components)
            columns = [batch.column(k) for k in keys]
            columns += [pa.array(_deviations(model, x), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_deviation", "_whitened"])

    kinds = ", ".join([f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys] + ["_deviation decimal(38,0)", "_whitened array<double>"])
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:shown]])
    out = own.mapInArrow(run, kinds).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shown - 1))))
    whitened = F.get("_whitened", F.col("_k")).alias("whitened")
    return out.select(
        *keys, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), whitened,
        F.get(explained, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

"""Helpers shared by the operators: bounded Arrow batches, one-task training, columns of documents."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch, scratch_root

__all__ = ["Scratch", "scratch_root"]

#: What separates words everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Rows of one Arrow batch at most; with it a Python worker holds a few hundred whole texts at a time.
BATCH_ROWS = 512

def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: they need not have it on their path."""
    context = spark.sparkContext
    if not getattr(context, "_trajspark_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = Path(tempfile.mkdtemp(prefix="trajspark-code-"))
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(folder / "trajspark_code.zip", "w") as file:
            for path in sorted(package.rglob("*.py")):
                file.write(path, path.relative_to(package.parent))
        context.addPyFile(str(folder / "trajspark_code.zip"))
        context._trajspark_shipped = True


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows`, so that batches of long texts stay small.

    Spark reads the setting when a plan is run, which for a returned DataFrame is after this call, so it stays lowered.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def per_batch(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType
) -> DataFrame:
    """Map Arrow batches of df, given and returned as dicts of column lists."""
    bound_batches(df.sparkSession)
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, function: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of df, all columns unchanged, for whose texts (null: empty) `function` is true."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(function([t or "" for t in batch.column("text").to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def trained(sample: DataFrame, counted: Callable[[str], dict], train: Callable, empty: object) -> object:
    """train(features, labels) on a bounded sample (doc_id, text, label) in one task; the driver gets the model only.

    Texts become `counted` word counts where they lie, so that what meets in the task grows with distinct words, not
    with the length of texts. The rows are sorted, so equal input gives an equal model; a lost executor costs another
    run.
    """
    bound_batches(sample.sparkSession)
    schema = T.StructType(
        [
            T.StructField("order", T.StringType()),
            T.StructField("label", sample.schema["label"].dataType),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )
    arrow = to_arrow(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dict(sorted(counted(text).items())) for text in batch.column("text").to_pylist()]
            columns = [batch.column("order").to_pylist(), batch.column("label").to_pylist()]
            columns += [[list(x) for x in found], [list(x.values()) for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, labels = [], []
        for batch in batches:
            pairs = zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            features += [dict(zip(words, counts, strict=True)) for words, counts in pairs]
            labels += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(features, labels))], pa.binary())], names=["model"])

    order = F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 24, "0"), F.xxhash64("text").cast("string"))
    rows = sample.select(order.alias("order"), "label", "text").mapInArrow(count, schema)
    found = rows.repartition(1).sortWithinPartitions("order", "label").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else empty


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that other columns can't clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fields(docs: DataFrame, *rest: tuple[str, str]) -> T.StructType:
    """doc_id as docs has it, then the named fields."""
    return T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in rest]
    )

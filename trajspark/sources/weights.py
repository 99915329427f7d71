"""Weight files of models as tables of tensors: only headers are read, never weights."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import human
from . import sink
from .sink import opened

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sink)

#: Endings of weight files, and parts of names that mark other state.
SUFFIXES = (".safetensors", ".bin", ".pt", ".pth")
SKIPPED = ("optimizer", "optim", "scheduler", "trainer", "training_state", "rng_state", "random_states")

SCHEMA = "path string, tensor string, dtype string, shape array<long>"
ARROW = pa.schema([("path", pa.string()), ("tensor", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64()))])


def weight_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the files below a folder that hold weights; their bytes are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.substring_index("path", "/", -1)
    kind = F.lit(False)
    for suffix in SUFFIXES:
        kind = kind | name.endswith(suffix)
    for part in SKIPPED:
        kind = kind & ~F.lower(name).contains(part)
    return rows.where(kind)


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A safetensors file begins with the length of its header in eight bytes, little end first, and the header as JSON."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, at = opened(path)
            with system.open_input_stream(at) as stream:
                size = int.from_bytes(stream.read(8), "little")
                head = json.loads(stream.read(size))
            own = [(k, v["dtype"], [int(d) for d in v["shape"]]) for k, v in head.items() if k != "__metadata__"]
            columns = [[path] * len(own), *([x[i] for x in own] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def read_weights(spark: SparkSession, root: str) -> DataFrame:
    """path, tensor, dtype, shape of every tensor in the safetensors files below a folder, read by tasks, a file's header
    at a time. Other formats are pickles, which can't be read without running them: they raise."""
    found = weight_files(spark, root)
    other = found.where(~F.col("path").endswith(".safetensors")).select("path").head()
    if other:
        raise ValueError(f"{other.path}: only safetensors headers can be read")
    return found.select("path").mapInArrow(_tensors, SCHEMA)


def parameters(weights: DataFrame) -> DataFrame:
    """path, n (numbers in all its tensors; one without dimensions is one number), and n for people to read."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, d: a * d)
    return weights.groupBy("path").agg(F.sum(size).alias("n")).withColumn("text", human(F.col("n")))

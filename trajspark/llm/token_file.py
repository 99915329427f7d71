"""Token ids of documents in a binary file format, in ascending doc_id order.

A token table is a folder of Parquet files whose rows are segments of the format in `simple8b`: about SEGMENT ids
of consecutive documents with their ids, numbered in their shard. Spark's writer commits it, so a lost executor or
a repeated task leaves no half-written file, and any store that Spark reads will do.

Null texts are empty and get the end id alone; null doc_ids come first; documents of one doc_id keep an order of
their own (by the hash of their text), repeated rows one place each; an empty table gives an empty table. A very long
text is encoded whole and makes a segment of its own length. Ids are the tokenizers library's, which makes an added
token that stands in a text one id. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simple8b
from .common import bound_batches, id_and_text, per_batch, to_arrow
from .encoding import encoder

#: Ids of one segment, about; only a single longer document makes a longer one.
SEGMENT = 1 << 18


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, append `end_id`, and write the ids in doc_id order. Shards are ranges of doc_id."""
    bound_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            T.StructField("data", T.BinaryType()),
        ]
    )
    arrow = to_arrow(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        names, parts, held, number, first = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = simple8b.pack(ids, np.array([len(x) // 4 for x in parts], np.int64))
            row = [[shard], [number], [first], [len(ids)], [names], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, text in zip(*batch.to_pydict().values(), strict=True):
                names.append(name)
                parts.append(encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= SEGMENT:
                    yield segment()
                    names, parts, held, number, first = [], [], 0, number + 1, first + held
        if names:
            yield segment()

    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_tokens(table: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decode a token table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids if asked for.

    Starts need the sizes of earlier shards: one row a shard, summed before they meet in one small window.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    element = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", element),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )

    def decode(rows: dict[str, list]) -> dict[str, list]:
        out = {f.name: [] for f in schema}
        for first, names, data in zip(rows["first"], rows["doc_ids"], rows["data"], strict=True):
            ids, lengths = simple8b.unpack(data)
            ids, at = ids.astype("<u4"), np.append(0, np.cumsum(lengths))
            out["doc_id"] += names
            out["start"] += (first + at[:-1]).tolist()
            out["n_tokens"] += lengths.tolist()
            out["ids_crc32"] += [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            if with_ids:
                out["ids"] += [ids[a:b].astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    # One row a shard, so its size is bounded by the number of write tasks.
    placed = table.join(F.broadcast(base), "shard").select(
        (F.col("first") + F.col("base")).alias("first"), "doc_ids", "data"
    )
    return per_batch(placed, decode, schema)

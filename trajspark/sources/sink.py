"""A Spark sink for layouts that fix the name of every file: tasks write the files, one step publishes them.

A column says which file each row belongs to. Tasks write their files below a staging folder beside the target, each
first under a name of its own and then moved to its final one, so a lost or repeated task leaves no half file under a name
that counts. The commit checks that every file was written by one task and puts the staging folder in the target's
place; an abort removes it, and the old target stays. The driver renames one folder, whatever the number of files.

Folders are URIs or paths that pyarrow's file systems open from the executors.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    rows: dict[str, int] = field(default_factory=dict)  # of each file


def opened(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:"))


class _File:
    """One open file, under a name of its own until it is whole."""

    def __init__(self, system, final: str, schema: pa.Schema, kind: str):
        self.system, self.final, self.own, self.kind = system, final, f"{final}.{uuid.uuid4().hex}.part", kind
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(self.own)
        if kind == "parquet":
            import pyarrow.parquet as pq

            self.writer = pq.ParquetWriter(self.out, schema)

    def add(self, rows: pa.RecordBatch) -> None:
        if self.kind == "parquet":
            self.writer.write_batch(rows)
        elif self.kind == "bytes":
            for x in rows.column(0).to_pylist():
                self.out.write(x)
        else:
            self.out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows.to_pylist()).encode())

    def close(self) -> None:
        if self.kind == "parquet":
            self.writer.close()
        self.out.close()
        self.system.move(self.own, self.final)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.staging = options["folder"], options["staging"]
        self.column, self.kind, self.publish = options["column"], options.get("kind", "parquet"), options.get("publish", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come sorted by the file's name."""
        system, base = opened(self.staging)
        done, name, file = Written(), None, None
        for batch in iterator:
            names = batch.column(batch.schema.get_field_index(self.column)).to_pylist()
            rows = batch.drop_columns([self.column])
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if file is None or names[at] != name:
                    if file:
                        file.close()
                    name = names[at]
                    if name is None or name in done.rows:
                        raise ValueError(f"rows of file {name} have no name or don't stand together")
                    file, done.rows[name] = _File(system, f"{base}/{name}", rows.schema, self.kind), 0
                file.add(rows.slice(at, end - at))
                done.rows[name] += end - at
                at = end
        if file:
            file.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.rows]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a file was written by several tasks")
        if self.publish:
            published(self.staging, self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.staging)
        from pyarrow import fs

        if system.get_file_info(base).type != fs.FileType.NotFound:
            system.delete_dir(base)


def published(staging: str, folder: str) -> None:
    """Put a staging folder in the place of a folder, without what lost tasks left in it."""
    from pyarrow import fs

    system, base = opened(staging)
    target = opened(folder)[1]
    system.create_dir(base, recursive=True)
    for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
        if info.path.endswith(".part"):
            system.delete_file(info.path)
    if system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_dir(target)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    system.move(base, target)


class PlacedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter({k.lower(): v for k, v in self.options.items()})


def staging_of(folder: str) -> str:
    return f"{folder.rstrip('/')}.{uuid.uuid4().hex}.staging"


def write_files(rows: DataFrame, folder: str, column: str, order: list[str], kind: str = "parquet", staging: str | None = None) -> None:
    """Write rows to the files that `column`, which isn't written, names below `folder`, which they then are all of.

    Rows of a file are in `order`. A file is Parquet, JSON lines (`kind` "json") or, of kind "bytes", its rows' first column
    one behind the other. With `staging`, files go there and nothing is published. Names must not be null.
    """
    rows.sparkSession.dataSource.register(PlacedFiles)
    spread = rows.repartition(column).sortWithinPartitions(column, *order)
    options = {"folder": folder, "staging": staging or staging_of(folder), "column": column, "kind": kind, "publish": "false" if staging else "true"}
    spread.write.format("placed_files").options(**options).mode("append").save()


def copy_files(names: DataFrame, source: str, target: str) -> None:
    """Copy the files that column `path` names from a folder to another, by tasks: as many as there are files, up to
    spark.sql.shuffle.partitions. Names are few bytes, so Spark's own sizing would give all files to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        (a, left), (b, right) = opened(source), opened(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                final, own = f"{right}/{name}", f"{right}/{name}.{uuid.uuid4().hex}.part"
                b.create_dir(final.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(f"{left}/{name}", own, source_filesystem=a, destination_filesystem=b)
                b.move(own, final)
            yield batch

    tasks = min(names.count(), int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names.select("path").repartition(max(1, tasks), "path").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def digests(rows: DataFrame, column: str) -> DataFrame:
    """path, rows, digest of every file: a sum over its rows that doesn't depend on their order."""
    own = sorted(c for c in rows.columns if c != column)
    value = F.xxhash64(*[F.col(f"`{c}`") for c in own]).cast("decimal(38,0)")
    return rows.groupBy(F.col(column).alias("path")).agg(F.count("*").alias("rows"), F.sum(value).alias("digest"))

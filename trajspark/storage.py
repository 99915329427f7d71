"""Tables of a run in the folder that the cluster shares, and small files that appear whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for removing a finished query's shuffle files at once rather than at some garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A temporary one where it is unset, in local mode
    only: on a cluster each executor would write to its own disk, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark.sparkContext, "_own_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="trajspark-")
            spark.sparkContext._own_scratch = root
            atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


class Scratch:
    """Tables of one run in the shared folder. They cut lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{scratch_root(spark)}/trajspark-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it as read again; its shuffle files go as soon as it is written."""
        path = f"{self.at}/{name}"
        usual = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if usual is None else self.spark.conf.set(_CLEANUP, usual)
        return self.spark.read.schema(df.schema).parquet(path)

    def child(self, name: str) -> Scratch:
        """The tables of a part of the run, below its own."""
        out = Scratch(self.spark)
        out.at = f"{self.at}/{name}"
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            remove(self.spark, f"{self.at}/{name}")

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write the result of the run; it is then the only table of the run that is left."""
        out = self.table(df, name)
        root, fs = _path(self.spark, self.at)
        for status in fs.listStatus(root):
            if status.getPath().getName() != name:
                fs.delete(status.getPath(), True)
        return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written aside and renamed over the old one in one step: a reader sees either, never half."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, fs = _path(spark, path)
    target = fs.makeQualified(target)
    aside, _ = _path(spark, f"{target.toString()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, how)

"""Cutting lineage with tables in the folder that all executors share.

`spark.checkpoint.dir` names that folder on a cluster. Only where it is unset and all executors are threads of this machine, as in tests,
a folder below the machine's temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut tables of this application."""
    root = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/corpuslab-checkpoints"
    return f"{root.rstrip('/')}/corpuslab/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table just written: no lineage behind them, and safe when executors are lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuslab_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table behind a frame made by cut(), when nothing lazy still needs it."""
    path = getattr(df, "_corpuslab_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sweep(spark: SparkSession) -> None:
    """Deletes all cut tables of this application."""
    delete(spark, shared_folder(spark))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def append_line(spark: SparkSession, path: str, line: str) -> None:
    """Adds a line to a small file in any store: few stores can append, so the file with the line takes its place under its name once it is whole."""
    jvm = spark.sparkContext._jvm
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = "".join(f"{r[0]}\n" for r in spark.read.text(path).collect()) if fs.exists(at) else ""
    write_text(spark, new.toString(), f"{before}{line}\n")
    fs.delete(at, False)
    fs.rename(new, at)

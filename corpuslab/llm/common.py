"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Documents that pass to Python at once.
ROWS = 1000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lean() -> None:
    """Called in a worker before and after its work: memory that arrays leave goes back to the machine, which idle and other workers share."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the C library that has it
        pass


def leanly(batches):
    """The batches of a worker's task, with what the task before left given back first, and what this one took after the last."""
    lean()
    yield from batches
    lean()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_few_rows(spark: SparkSession, rows: int = ROWS) -> None:
    """What is run from here on passes at most this many rows to Python at once: texts take their room in both processes, in the JVM's beside its heap."""
    before = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, min(rows, before) if before > 0 else rows)


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = ROWS):
    """set_few_rows for what is run within."""
    before = spark.conf.get(_BATCH)
    set_few_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_key(source: Column) -> Column:
    """A string without nulls that sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def seeded(seed: int, *columns: Column) -> Column:
    """Hex md5 of the seed and the columns; null counts as a value of its own. DuckDB has the same digest."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]))


def hex_prefix(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def bucketed_rank(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Adds `out`, the row's rank (from 1) within `keys` by (bucket, order).

    No task holds all rows of a key: rows are ranked within (key, bucket), and the counts of the buckets
    before, a small table, are added to that.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)))
    return ranked.join(offsets, [*keys, bucket]).withColumn(out, F.col("__before") + F.col("__rn")).drop("__before", "__rn")

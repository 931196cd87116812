"""Readers of the inputs, with declared schemas."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators.corpus import RECORD, numbered, validated


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record JSON lines; blank lines are skipped; `ord` follows (file, position in file) as the text reader gives them."""
    text = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    parsed = text.select(F.from_json("value", RECORD).alias("r"), "file", "at").select("r.*", "file", "at")
    return validated(numbered(parsed, [F.col("file"), F.col("at")], "ord", 0).drop("file", "at"))


def parse_label(line: Column, least: int = 2) -> Column:
    """A struct (name, grade, lesions) of a label line, null if it is short, not numeric or out of range."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    grade = F.try_element_at(parts, F.lit(2)).try_cast("int")
    ok = (F.size(parts) >= least) & grade.between(0, 3)
    return F.when(ok, F.struct(F.element_at(parts, 1).alias("name"), grade.alias("grade"), F.try_element_at(parts, F.lit(3)).try_cast("int").alias("lesions")))


def labels_of(lines: DataFrame, value: str = "value", file: str = "file", line: str = "line", least: int = 2) -> DataFrame:
    """name, grade, lesions: the last line of the last file counts."""
    p = lines.withColumn("p", parse_label(F.col(value), least)).where(F.col("p").isNotNull())
    return p.groupBy("p.name").agg(F.max_by("p", F.struct(file, line)).alias("p")).select("name", "p.grade", "p.lesions")


def read_labels(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """name, grade, lesions, fold: label files named ..._<fold>.txt."""
    t = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.monotonically_increasing_id())
    p = t.withColumn("p", parse_label(F.col("value"), least)).where(F.col("p").isNotNull())
    return p.select("p.*", F.regexp_extract("file", r"_(\d+)\.txt$", 1).try_cast("int").alias("fold"), "file", "line")


def reconcile(labels: DataFrame, files: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled files, files without a label, labels without a file)."""
    return labels.join(files, key), files.join(labels, key, "left_anti"), labels.join(files, key, "left_anti")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, length: without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, decoded by Spark's image source."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height")


def coco_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """file_name, n: annotations of each image, 0 for those without."""
    return images.join(annotations, images["id"] == annotations["image_id"], "left").groupBy("file_name").agg(F.count("image_id").alias("n"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    schema = "images ARRAY<STRUCT<id:BIGINT, file_name:STRING>>, annotations ARRAY<STRUCT<image_id:BIGINT>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return coco_counts(raw.select(F.inline("images")), raw.select(F.inline("annotations")))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; blank cells are left out."""
    return df.unpivot(keys, columns, name, value).where(F.trim(F.col(value)) != "")


def pool_from_names(files: DataFrame, name: str = "name", pattern: str = r"g(\d)_") -> DataFrame:
    """Files with the label that their names hold; others are left out."""
    return files.withColumn("label", F.regexp_extract(name, pattern, 1).try_cast("int")).where(F.col("label").isNotNull())


def only_source(records: DataFrame, expected: str) -> DataFrame:
    """The records, or an error if one has another source."""
    bad = records.where(~F.col("source").eqNullSafe(F.lit(expected))).first()
    if bad:
        raise ValueError(f"a record has source {bad['source']}, not {expected}")
    return records


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def cached_embeddings(keys: DataFrame, cache: str, embed, schema: str, key: str = "path") -> DataFrame:
    """key, v: from the cache table; what it lacks is computed by `embed` (a mapInPandas function) and appended."""
    spark = keys.sparkSession
    have = spark.read.parquet(cache) if spark._jvm.org.apache.hadoop.fs.Path(cache).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(cache)) else None
    missing = keys.select(key).distinct() if have is None else keys.select(key).distinct().join(have.select(key), key, "left_anti")
    missing.mapInPandas(embed, schema).write.mode("append").parquet(cache)
    return keys.join(spark.read.parquet(cache), key)


def read_config(path: str) -> dict:
    """An experiment's settings; lists become tuples. Driver side."""
    import yaml

    def fixed(x):
        if isinstance(x, dict):
            return {k: fixed(v) for k, v in x.items()}
        return tuple(fixed(v) for v in x) if isinstance(x, list) else x

    return fixed(yaml.safe_load(Path(path).read_text()))

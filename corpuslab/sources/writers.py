"""Sinks: Spark's writers for tables, the driver for single reports and logs."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.plans.scratch import write_text


def write_records(records: DataFrame, path: str) -> None:
    records.select("path", "label", "source", "grp", "meta").write.json(path)


def write_csv(records: DataFrame, path: str) -> None:
    records.select("path", "label", "source", "grp").write.csv(path, header=True)


def write_label_tsv(labels: DataFrame, path: str) -> None:
    labels.select("name", "grade", "lesions").write.csv(path, sep="\t")


def write_report(report: DataFrame, path: str) -> None:
    """A table of one row as one JSON object."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    write_text(report.sparkSession, path, json.dumps(rows[0].asDict(recursive=True), indent=1, default=str))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def caption_manifest(records: DataFrame, captions: DataFrame) -> DataFrame:
    """file_name, text: only real records may be in it."""
    bad = records.where("source <> 'real'").first()
    if bad:
        raise ValueError(f"{bad['path']} is not real")
    return records.join(captions, "label").select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("caption").alias("text"))


def object_hash(value) -> str:
    """16 hex digits of the SHA-256 of the value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:16]


def file_hash(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]


def run_identity(config: dict, n_synthetic: int) -> tuple[str, dict]:
    """(run_id, config): what decides a run's content; its name doesn't, and without synthetic records the generator is 'none'."""
    own = {k: v for k, v in config.items() if k != "name"}
    if not n_synthetic:
        own["generator"] = "none"
    return object_hash(own), own


def provenance() -> dict:
    import platform
    import sys

    import pyspark

    return {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "platform": platform.platform()}

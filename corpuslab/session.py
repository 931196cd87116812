"""Session settings that the engine is tested with; any existing session works as well."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "corpuslab", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("CORPUSLAB_DRIVER_MEMORY", "8g"),
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf).getOrCreate()

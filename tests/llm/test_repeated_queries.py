"""Repeated query rows of one vector give the neighbours of one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpuslab.llm import ann


def test_repeated_queries(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[0]] * 24, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0, slices=3).orderBy("rank").collect()]
    s = x @ x[0]
    assert got == [j for j in np.lexsort((np.arange(60), -s)) if j != 0][:20]

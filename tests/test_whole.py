"""Queries over whole views: no prefix of ids, no part of the keys, no cap of rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuslab.functions.draws import order_key
from corpuslab.operators import corpus as C
from corpuslab.queries import views as V
from corpuslab.registry import QUERIES


def test_numbers_are_those_of_one_sort(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), order_key(3, F.col("id")).alias("m")).repartition(7)
    got = {r["k"]: r["place"] for r in C.numbered(df, [F.desc("m"), F.col("k")]).collect()}
    want = sorted(((r["m"], r["k"]) for r in df.collect()), key=lambda x: (x[0], -x[1]), reverse=True)
    assert got == {k: i + 1 for i, (_, k) in enumerate(want)}
    assert C.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_bootstraps_read_all_events(spark, sf):
    p = V.v_pred(spark, sf).select("y_true", "y_pred", "ord").collect()
    assert len(p) > 400
    hit = sum(r["y_true"] == r["y_pred"] for r in p) / len(p)
    third = sum(r["ord"] % 3 == 0 or r["y_true"] == r["y_pred"] for r in p) / len(p)
    point = {n: QUERIES[n](spark, sf).first()["point"] for n in ("sta2_bootstrap_metric", "sta3_paired_bootstrap", "sta4_bootstrap_mean")}
    assert math.isclose(point["sta2_bootstrap_metric"], hit, abs_tol=1e-6)
    assert math.isclose(point["sta3_paired_bootstrap"], third - hit, abs_tol=1e-6)
    assert math.isclose(point["sta4_bootstrap_mean"], sum(r["y_pred"] for r in p) / len(p), abs_tol=1e-4)


def test_pixels_of_all_images(spark, sf):
    n = V.table(spark, sf, "orders").count()
    assert QUERIES["fn8_lab"](spark, sf).count() == n
    assert QUERIES["ton4_degenerate_share"](spark, sf).first()["n"] == n


def test_concat_and_groups_return_all_rows(spark, sf):
    v = V.v_corpus(spark, sf)
    n = {r["source"]: r["n"] for r in v.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = sorted((r["place"], r["path"]) for r in QUERIES["set1_concat"](spark, sf).collect())
    by = lambda s: [r["path"] for r in v.where(F.col("source") == s).orderBy("ord").collect()]
    assert [p for _, p in got] == by("real") + by("synth_open") and len(got) == n["real"] + n["synth_open"]
    groups = V.v_docs(spark, sf).select("grp").distinct().count()
    assert groups > 50 and QUERIES["srt3_largest_groups_first"](spark, sf).count() == groups


def test_metadata_joined_by_stem(spark, tmp_path):
    urls = ["http://a/x/1.html", "http://b/1", "http://c/y/2.html?page=2", "http://d/3#top", "http://e/1?ref=x", "http://f/3.html#top"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["stem"], r["page_id"], r["meta_id"], r["missing"]) for r in QUERIES["jn17_meta_by_stem"](spark, str(tmp_path)).collect()}
    assert got == {("1", 0, 1, False), ("2", 2, None, True), ("3", 5, 3, False)}

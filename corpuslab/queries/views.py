"""Operands: the driver's tables seen as the engine's inputs, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.draws import draw
from corpuslab.functions.scalars import severity_band


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(*views: str, body: str) -> str:
    """A WITH clause of the named views before the body."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + body


def D(n, *parts: str) -> str:
    """draws.draw in DuckDB."""
    return f"(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {n})"


SQL: dict[str, str] = {
    "v_corpus": "SELECT vec_id AS ord, concat('vec_', vec_id) AS path, (vec_id % 4)::INT AS label, CASE vec_id % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'synth_closed' ELSE 'synth_open' END AS source, concat('g', vec_id // 3) AS grp, embedding::DOUBLE[] AS v FROM embeddings",
    "v_docs": "SELECT doc_id AS ord, concat('doc_', doc_id) AS path, (substr(source, 4)::INT % 4)::INT AS label, md5(text) AS grp, lang, source, n_chars FROM documents",
    "v_pred": f"SELECT event_id AS ord, event_id, (user_id % 5)::INT AS seed, CASE user_id % 2 WHEN 0 THEN 'scratch' ELSE 'imagenet' END AS init, ((event_id // 4) % 5) / 4.0::DOUBLE AS frac, CASE WHEN (event_id // 4) % 5 = 0 THEN 'none' WHEN event_id % 3 = 0 THEN 'synth_open' ELSE 'synth_closed' END AS generator, (event_id % 4)::INT AS y_true, (CASE WHEN {D(1000, 'event_id', 'user_id')} < 800 - 400 * (((event_id // 4) % 5) / 4.0::DOUBLE) THEN event_id % 4 ELSE (event_id + 1 + user_id % 3) % 4 END)::INT AS y_pred FROM events",
    "v_subject": "SELECT o_orderkey AS item, o_custkey AS patient, concat(o_custkey, '|', o_orderpriority) AS lesion, o_orderpriority AS dx FROM orders",
    "v_counts": "SELECT o_orderkey AS item, count(l_orderkey) AS c1, coalesce(floor(sum(l_quantity) / 4), 0)::BIGINT AS c2 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "v_manifest": "SELECT concat(user_id, '_', strftime(ts, '%Y-%m-%d')) AS name, concat('s', user_id % 12) AS substrate, (user_id % 12) % 2 = 0 AS person, event_id AS ord, ts, CASE event_type WHEN 'purchase' THEN concat('p', event_id) END AS path, CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN 'HTTP 429' ELSE 'empty' END AS blocked_reason FROM events",
    "v_runs": "SELECT generator, init, frac, seed, avg(recall) AS ba FROM (SELECT generator, init, frac, seed, y_true, avg((y_true = y_pred)::INT::DOUBLE) AS recall FROM v_pred GROUP BY ALL) GROUP BY ALL",
    "v_pixels": "SELECT o_custkey AS img, o_orderkey AS px, (40 + (o_orderkey * 37 + o_custkey * 11) % 200) / 255.0::DOUBLE AS r, (30 + (o_orderkey * 53 + o_custkey * 7) % 180) / 255.0::DOUBLE AS g, (20 + (o_orderkey * 71 + o_custkey * 3) % 150) / 255.0::DOUBLE AS b FROM orders",
}


def v_corpus(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    source = F.element_at(F.array(F.lit("real"), F.lit("synth_closed"), F.lit("synth_open")), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("vec_"), F.col("vec_id")).alias("path"), (F.col("vec_id") % 4).cast("int").alias("label"), source.alias("source"),
        F.concat(F.lit("g"), F.expr("vec_id div 3")).alias("grp"), F.col("embedding").cast("array<double>").alias("v"),
    )


def v_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = (F.substring("source", 4, 10).cast("int") % 4).cast("int")
    return d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("path"), label.alias("label"), F.md5("text").alias("grp"), "lang", "source", "n_chars")


def v_pred(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.expr("(event_id div 4) % 5")
    frac = step / F.lit(4.0)
    right = draw(1000, F.col("event_id"), F.col("user_id")) < 800 - 400 * frac
    return e.select(
        F.col("event_id").alias("ord"), "event_id", (F.col("user_id") % 5).cast("int").alias("seed"), F.when(F.col("user_id") % 2 == 0, "scratch").otherwise("imagenet").alias("init"),
        frac.alias("frac"), F.when(step == 0, "none").when(F.col("event_id") % 3 == 0, "synth_open").otherwise("synth_closed").alias("generator"),
        (F.col("event_id") % 4).cast("int").alias("y_true"), F.when(right, F.col("event_id") % 4).otherwise((F.col("event_id") + 1 + F.col("user_id") % 3) % 4).cast("int").alias("y_pred"),
    )


def v_runs(spark, sf_dir) -> DataFrame:
    recall = v_pred(spark, sf_dir).groupBy("generator", "init", "frac", "seed", "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return recall.groupBy("generator", "init", "frac", "seed").agg(F.avg("recall").alias("ba"))


def v_subject(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("patient"), F.concat_ws("|", "o_custkey", "o_orderpriority").alias("lesion"), F.col("o_orderpriority").alias("dx"))


def v_counts(spark, sf_dir) -> DataFrame:
    o, l = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    joined = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(F.col("o_orderkey").alias("item")).agg(F.count("l_orderkey").alias("c1"), F.coalesce(F.floor(F.sum("l_quantity") / 4), F.lit(0)).cast("long").alias("c2"))


def v_manifest(spark, sf_dir) -> DataFrame:
    e, kind, user = table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id")
    return e.select(
        F.concat_ws("_", user, F.date_format("ts", "yyyy-MM-dd")).alias("name"), F.concat(F.lit("s"), user % 12).alias("substrate"), ((user % 12) % 2 == 0).alias("person"),
        F.col("event_id").alias("ord"), "ts", F.when(kind == "purchase", F.concat(F.lit("p"), F.col("event_id"))).alias("path"),
        F.when(kind == "purchase", F.lit(None)).when(kind == "error", "HTTP 429").otherwise("empty").alias("blocked_reason"),
    )


def v_pixels(spark, sf_dir) -> DataFrame:
    """A pixel for each order; a customer is an image."""
    o = table(spark, sf_dir, "orders")
    channel = lambda base, a, b, m: ((base + (F.col("o_orderkey") * a + F.col("o_custkey") * b) % m) / F.lit(255.0))
    return o.select(F.col("o_custkey").alias("img"), F.col("o_orderkey").alias("px"), channel(40, 37, 11, 200).alias("r"), channel(30, 53, 7, 180).alias("g"), channel(20, 71, 3, 150).alias("b"))


def band(c):
    return severity_band(F.col(c))


BAND = "(CASE WHEN {0} <= 5 THEN 0 WHEN {0} <= 20 THEN 1 WHEN {0} <= 50 THEN 2 ELSE 3 END)"

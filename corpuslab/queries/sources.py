"""Sources, reconciling joins, document gates, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators import gate as G
from corpuslab.queries import views as V
from corpuslab.queries.views import sql
from corpuslab.registry import query
from corpuslab.sources import readers as R


@query("src1_records", "SELECT vec_id AS ord, concat('vec_', vec_id) AS path, (vec_id % 4)::INT AS label, concat('vec_', vec_id) AS grp FROM embeddings")
def _(spark, sf):
    from corpuslab.operators.corpus import RECORD, validated

    rec = F.to_json(F.struct(F.concat(F.lit("vec_"), F.col("vec_id")).alias("path"), (F.col("vec_id") % 4).cast("int").alias("label"), F.lit("real").alias("source"), F.lit("").alias("grp")))
    parsed = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.from_json(rec, RECORD).alias("r")).select("ord", "r.*")
    return validated(parsed).select("ord", "path", "label", "grp")


_LINES = "l AS (SELECT event_id, user_id % 3 AS file, CASE event_id % 5 WHEN 0 THEN concat('img', user_id, ' ', event_id % 4, ' ', event_id % 60) WHEN 1 THEN concat('img', user_id, ' ', event_id % 7) WHEN 2 THEN concat('  img', user_id, '   ', event_id % 4, ' 9 extra') WHEN 3 THEN concat('img', user_id) ELSE concat('img', user_id, ' x 3') END AS value FROM events)"
_PARSED = _LINES + ", p AS (SELECT event_id, file, regexp_split_to_array(trim(value), '\\s+') AS a FROM l), q AS (SELECT event_id, file, a[1] AS name, TRY_CAST(a[2] AS INT) AS grade, TRY_CAST(a[3] AS INT) AS lesions FROM p WHERE len(a) >= 2 AND TRY_CAST(a[2] AS INT) BETWEEN 0 AND 3)"


def _label_lines(spark, sf):
    e, i, u = V.table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    c = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    value = F.when(i % 5 == 0, c("img", u, " ", i % 4, " ", i % 60)).when(i % 5 == 1, c("img", u, " ", i % 7)).when(i % 5 == 2, c("  img", u, "   ", i % 4, " 9 extra")).when(i % 5 == 3, c("img", u)).otherwise(c("img", u, " x 3"))
    return e.select("event_id", (u % 3).alias("file"), value.alias("value"))


@query("src2_label_lines", f"WITH {_PARSED} SELECT event_id, name, grade, lesions FROM q")
def _(spark, sf):
    return _label_lines(spark, sf).withColumn("p", R.parse_label(F.col("value"))).where("p IS NOT NULL").select("event_id", "p.name", "p.grade", "p.lesions")


@query("src4_last_label_wins", f"WITH {_PARSED} SELECT name, arg_max(grade, file * 10000000 + event_id) AS grade FROM q GROUP BY 1")
def _(spark, sf):
    return R.labels_of(_label_lines(spark, sf), line="event_id").select("name", "grade")


_REC = f"WITH {_PARSED}, f AS (SELECT DISTINCT concat('img', user_id) AS name FROM events WHERE user_id % 4 <> 0), lb AS (SELECT DISTINCT name FROM q WHERE file < 2) SELECT CASE WHEN f.name IS NULL THEN 'missing' WHEN lb.name IS NULL THEN 'unlabelled' ELSE 'both' END AS kind, coalesce(f.name, lb.name) AS name FROM f FULL JOIN lb ON f.name = lb.name"


@query("src3_reconcile", _REC)
@query("jn2_anti_joins", _REC)
def _(spark, sf):
    labels = R.labels_of(_label_lines(spark, sf).where("file < 2"), line="event_id").select("name")
    files = V.table(spark, sf, "events").where("user_id % 4 <> 0").select(F.concat(F.lit("img"), F.col("user_id")).alias("name")).distinct()
    both, unlabelled, missing = R.reconcile(labels, files)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "name")
    return kind(both, "both").unionByName(kind(unlabelled, "unlabelled")).unionByName(kind(missing, "missing"))


@query("src5_annotation_counts", "SELECT concat('o', o_orderkey) AS file_name, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
@query("jn3_zero_filled_counts", "SELECT concat('o', o_orderkey) AS file_name, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, sf):
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("file_name"))
    return R.coco_counts(images, V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id")))


@query("src6_src7_delimited", "SELECT c_custkey AS k, c_name AS name FROM customer")
def _(spark, sf):
    row = F.to_csv(F.struct("c_custkey", "c_name"), {"sep": "\t"})
    return V.table(spark, sf, "customer").select(F.from_csv(row, "k BIGINT, name STRING", {"sep": "\t"}).alias("r")).select("r.*")


@query("src8_unpivot", "SELECT k, name, value FROM (SELECT o_orderkey AS k, 'image_1_path' AS name, CASE WHEN o_orderkey % 2 = 0 THEN concat('a', o_orderkey) ELSE ' ' END AS value FROM orders UNION ALL SELECT o_orderkey, 'image_2_path', CASE WHEN o_orderkey % 3 = 0 THEN concat('b', o_orderkey) END FROM orders) WHERE trim(value) <> ''")
def _(spark, sf):
    k = F.col("o_orderkey")
    wide = V.table(spark, sf, "orders").select(k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("a"), k)).otherwise(" ").alias("image_1_path"), F.when(k % 3 == 0, F.concat(F.lit("b"), k)).alias("image_2_path"))
    return R.unpivoted(wide, ["k"], ["image_1_path", "image_2_path"], "name", "value")


@query("src11_labels_from_names", "SELECT concat('g', user_id % 5, '_', event_id, '.png') AS name, (user_id % 5)::INT AS label FROM events WHERE event_id % 2 = 0")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("g"), F.col("user_id") % 5, F.lit("_"), F.col("event_id"), F.lit(".png"))).otherwise("other.png")
    return R.pool_from_names(e.select(name.alias("name")))


@query("src12_single_source", sql("v_corpus", body="SELECT ord FROM v_corpus WHERE source = 'synth_open'"))
def _(spark, sf):
    return R.only_source(V.v_corpus(spark, sf).where("source = 'synth_open'"), "synth_open").select("ord")


@query("src13_partitioned_split", sql("v_docs", body="SELECT ord, CASE WHEN ord % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM v_docs"))
def _(spark, sf):
    from corpuslab.plans.scratch import new_path

    path = new_path(spark, "splits")
    V.v_docs(spark, sf).select("ord", F.when(F.col("ord") % 5 == 0, "val").otherwise("train").alias("split")).write.partitionBy("split").parquet(path)
    return R.read_splits(spark, path).select("ord", F.col("split").cast("string").alias("split"))


@query("src14_missing_embeddings", "SELECT concat('vec_', vec_id) AS path FROM embeddings WHERE vec_id % 7 = 0")
def _(spark, sf):
    e = V.v_corpus(spark, sf)
    return e.select("path").join(e.where("ord % 7 <> 0").select("path"), "path", "left_anti")


@query("snk7_label_table", sql("v_counts", body="SELECT concat('o', item) AS name, (CASE WHEN c2 <= 5 THEN 0 WHEN c2 <= 20 THEN 1 WHEN c2 <= 50 THEN 2 ELSE 3 END)::INT AS grade, c2 AS lesions FROM v_counts"))
def _(spark, sf):
    return V.v_counts(spark, sf).select(F.concat(F.lit("o"), F.col("item")).alias("name"), V.band("c2").alias("grade"), F.col("c2").alias("lesions"))


@query("snk8_caption_manifest", sql("v_corpus", body="SELECT path AS file_name, concat('a face, ', ['mild', 'moderate', 'severe', 'very_severe'][label + 1], ' acne') AS text FROM v_corpus WHERE source = 'real'"))
def _(spark, sf):
    from corpuslab.operators.corpus import label_dimension, real
    from corpuslab.sources.writers import caption_manifest

    captions = label_dimension(spark).select("label", F.concat(F.lit("a face, "), "name", F.lit(" acne")).alias("caption"))
    return caption_manifest(real(V.v_corpus(spark, sf)), captions)


@query("jn1_inner_on_name", sql("v_counts", body="SELECT o_orderkey AS item, c1, c2 FROM v_counts JOIN orders ON o_orderkey = item WHERE o_orderstatus = 'F'"))
def _(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item"))
    return V.v_counts(spark, sf).join(o, "item").select("item", "c1", "c2")


_DOCLINES = "ln AS (SELECT doc_id, i AS line, a[i] AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query("gat1_placeholder_lines", f"WITH {_DOCLINES} SELECT doc_id, line::INT AS line FROM ln WHERE value LIKE '%!!%' AND NOT starts_with(ltrim(value), 'A')")
def _(spark, sf):
    rows = G.lines(V.table(spark, sf, "documents"), "doc_id", "text")
    return rows.where(F.col("value").contains("!!") & ~F.ltrim("value").startswith("A")).select("doc_id", "line")


@query("gat2_dangling_refs", "WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS name FROM pages), d AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS name FROM pages WHERE page_id % 3 = 0) SELECT name, min(page_id) AS line FROM u WHERE name NOT IN (SELECT name FROM d) AND name NOT LIKE '%,%' GROUP BY 1")
def _(spark, sf):
    rows = V.table(spark, sf, "pages").select(F.col("page_id").alias("line"), F.col("html").alias("value"))
    uses = rows.select("line", F.explode(F.regexp_extract_all("value", F.lit('href="/([^"]+)"'), F.lit(1))).alias("name")).where("name NOT LIKE '%,%'")
    return G.dangling(uses, uses.where("line % 3 = 0"))


@query("gat3_first_line_per_key", f"WITH {_DOCLINES}, k AS (SELECT doc_id, line, unnest(regexp_extract_all(value, '(?:MIT|Apache|GNU|CC BY)')) AS name FROM ln) SELECT doc_id, name, min(line)::INT AS line FROM k GROUP BY 1, 2")
def _(spark, sf):
    rows = G.lines(V.table(spark, sf, "documents"), "doc_id", "text")
    return G.keys_of(rows, r"(?:MIT|Apache|GNU|CC BY)", 0).groupBy("doc_id", "name").agg(F.min("line").alias("line"))


@query("gat5_violations", "SELECT 'error' AS severity, 'empty' AS gate, doc_id::VARCHAR AS message FROM documents WHERE n_chars < 50 UNION ALL SELECT 'warning', 'shouting', doc_id::VARCHAR FROM documents WHERE text LIKE '%!!%'")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    message = F.col("doc_id").alias("message")
    return G.violations(("error", "empty", d.where("n_chars < 50").select(message)), ("warning", "shouting", d.where(F.col("text").contains("!!")).select(message)))


@query("str1_manifest_stream")
def _(spark, sf):
    from corpuslab.streaming.manifest import replay_yield

    return replay_yield(spark, f"{sf}/events.parquet")


@query("str3_growing_pool", "SELECT (event_id % 4)::INT AS label, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    from corpuslab.streaming.manifest import replay_counts

    return replay_counts(spark, f"{sf}/events.parquet")

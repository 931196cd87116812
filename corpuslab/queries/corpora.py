"""Filters, aggregations, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions import scalars as S
from corpuslab.functions.draws import order_key
from corpuslab.operators import corpus as C
from corpuslab.operators import similarity as M
from corpuslab.queries import views as V
from corpuslab.queries.views import BAND, sql
from corpuslab.registry import query


@query("flt1_equality_filter", sql("v_corpus", body="SELECT ord, path, label, source FROM v_corpus WHERE label = 2 AND source = 'real'"))
def _(spark, sf):
    return C.matching(V.v_corpus(spark, sf), label=2, source="real").select("ord", "path", "label", "source")


@query("flt2_real_synthetic", sql("v_corpus", body="SELECT CASE WHEN source = 'real' THEN 'real' ELSE 'synthetic' END AS kind, count(*) AS n FROM v_corpus GROUP BY 1"))
def _(spark, sf):
    c = V.v_corpus(spark, sf)
    return C.real(c).select(F.lit("real").alias("kind")).unionByName(C.synthetic(c).select(F.lit("synthetic").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("flt4_relabel_by_source", sql("v_corpus", body="SELECT (source <> 'real')::INT AS label, count(*) AS n FROM v_corpus GROUP BY 1"))
def _(spark, sf):
    return C.by_source_label(V.v_corpus(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("flt5_detected", "SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS detected FROM embeddings")
def _(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", M.detected(F.col("embedding")).alias("detected"))


@query("flt6_frequent_classes", sql("v_docs", body="SELECT ord, lang FROM v_docs QUALIFY count(*) OVER (PARTITION BY lang, label) >= 40"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    return d.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("lang", "label"))).where("n >= 40").select("ord", "lang")


@query("flt7_tail_subset", sql("v_corpus", body="SELECT ord, label FROM v_corpus WHERE label IN (2, 3)"))
def _(spark, sf):
    return V.v_corpus(spark, sf).where(F.col("label").isin(2, 3)).select("ord", "label")


@query("flt8_dominant_stratum", sql("v_docs", body="SELECT ord, lang = (SELECT lang FROM v_docs GROUP BY lang ORDER BY count(*) DESC, min(ord) LIMIT 1) AS dominant FROM v_docs"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    top = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("top"))
    return d.crossJoin(F.broadcast(top)).select("ord", (F.col("lang") == F.col("top")).alias("dominant"))


@query("flt9_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) + 1e-12))), 6) AS total FROM embeddings")
def _(spark, sf):
    v = M.normalised(F.col("embedding").cast("array<double>"))
    return V.table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("flt10_violations", sql("v_docs", body="SELECT ord, 'unknown source' AS rule FROM v_docs"))
def _(spark, sf):
    return C.violations(V.v_docs(spark, sf)).select("ord", "rule")


_DIM = "(VALUES (0, 'mild'), (1, 'moderate'), (2, 'severe'), (3, 'very_severe')) d(label, name)"


@query("agg1_class_histogram", sql("v_corpus", body=f"SELECT d.label::INT AS label, name, count(c.ord) AS n FROM {_DIM} LEFT JOIN (SELECT * FROM v_corpus WHERE label < 3) c ON c.label = d.label GROUP BY 1, 2"))
def _(spark, sf):
    return C.class_counts(V.v_corpus(spark, sf).where("label < 3"))


@query("agg2_source_histogram", sql("v_corpus", body="SELECT source, count(*) AS n FROM v_corpus GROUP BY 1"))
def _(spark, sf):
    return C.source_counts(V.v_corpus(spark, sf))


@query(
    "agg3_group_report",
    sql("v_docs", body="SELECT sum(s)::BIGINT AS n_items, count(*) AS n_groups, count(*) FILTER (s > 1) AS n_multi, sum(CASE WHEN s > 1 THEN s ELSE 0 END)::BIGINT AS items_in_multi, max(s) AS largest, round(max(s) / sum(s), 9) AS largest_share, max(s) / sum(s) > 0.05 AS over_clustered FROM (SELECT grp, count(*) AS s FROM v_docs GROUP BY 1)"),
)
def _(spark, sf):
    return C.group_report(V.v_docs(spark, sf), "grp")


@query("agg4_majority_label", sql("v_docs", body="SELECT grp, arg_max(label, n * 10 - label) AS glabel, sum(n)::BIGINT AS size FROM (SELECT grp, label, count(*) AS n FROM v_docs GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    return C.majority_label(V.v_docs(spark, sf), "grp")


@query("agg7_mode_tuple", sql("v_docs", body="SELECT source, arg_max(concat(lang, '/', label), n * 1000000 - f) AS mode FROM (SELECT source, lang, label, count(*) AS n, min(ord) AS f FROM v_docs GROUP BY 1, 2, 3) GROUP BY 1"))
def _(spark, sf):
    n = V.v_docs(spark, sf).groupBy("source", "lang", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return n.groupBy("source").agg(F.max_by(F.concat_ws("/", "lang", F.col("label").cast("string")), F.struct("n", -F.col("first"))).alias("mode"))


@query("agg8_top_combinations", "SELECT combo, count(*) AS n FROM (SELECT string_agg(event_type, ',' ORDER BY event_type) AS combo FROM (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) GROUP BY user_id, day) GROUP BY 1 ORDER BY n DESC, combo LIMIT 5")
def _(spark, sf):
    e = V.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("combo"))
    return e.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combo").limit(5)


@query("agg9_shared_values", sql("v_docs", body="SELECT grp, count(DISTINCT source) AS n_sources FROM v_docs GROUP BY 1 HAVING count(DISTINCT source) > 1"))
def _(spark, sf):
    return V.v_docs(spark, sf).groupBy("grp").agg(F.count_distinct("source").alias("n_sources")).where("n_sources > 1")


@query("agg10_count_of_counts", sql("v_subject", body="SELECT n AS items, count(*) AS groups FROM (SELECT patient, count(*) AS n FROM v_subject GROUP BY 1) GROUP BY 1"))
def _(spark, sf):
    return V.v_subject(spark, sf).groupBy("patient").agg(F.count(F.lit(1)).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("groups"))


@query("agg11_groups_by_class", sql("v_subject", body="SELECT coalesce(dx, 'ALL') AS dx, count(*) AS n, count(DISTINCT lesion) AS groups, round(count(*) / count(DISTINCT lesion), 6) AS per_group FROM v_subject GROUP BY GROUPING SETS ((dx), ())"))
def _(spark, sf):
    s = V.v_subject(spark, sf)
    g = s.groupingSets([[F.col("dx")], []], F.col("dx")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lesion").alias("groups"))
    return g.select(F.coalesce("dx", F.lit("ALL")).alias("dx"), "n", "groups", F.round(F.col("n") / F.col("groups"), 6).alias("per_group"))


@query("agg12_contingency", sql("v_docs", body="SELECT label, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM v_docs GROUP BY 1"))
def _(spark, sf):
    return V.v_docs(spark, sf).groupBy("label").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg13_majority_floor", sql("v_docs", body="SELECT lang, round(max(n) / sum(n), 9) AS floor FROM (SELECT lang, label, count(*) AS n FROM v_docs GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    return V.v_docs(spark, sf).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.round(F.max("n") / F.sum("n"), 9).alias("floor"))


@query(
    "agg14_separation",
    sql("v_docs", body="SELECT label, med, round(sd, 6) AS sd, lead(med) OVER (ORDER BY label) - med AS gap FROM (SELECT label, quantile_cont(n_chars, 0.5) AS med, stddev_samp(n_chars) AS sd, count(*) AS n FROM v_docs GROUP BY 1) WHERE n > 1"),
)
def _(spark, sf):
    g = V.v_docs(spark, sf).groupBy("label").agg(F.percentile("n_chars", 0.5).alias("med"), F.stddev_samp("n_chars").alias("sd"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select("label", "med", F.round("sd", 6).alias("sd"), (F.lead("med").over(W.orderBy("label")) - F.col("med")).alias("gap"))


_ENT = "SELECT source, round(sum(-p * ln(p)), 9) AS entropy, round(exp(sum(-p * ln(p))), 9) AS effective FROM (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM (SELECT source, lang, label, count(*) AS n FROM v_docs GROUP BY 1, 2, 3)) GROUP BY 1"


@query("agg15_entropy", sql("v_docs", body=_ENT))
@query("agg16_effective_count", sql("v_docs", body=_ENT))
def _(spark, sf):
    n = V.v_docs(spark, sf).groupBy("source", "lang", "label").agg(F.count(F.lit(1)).alias("n"))
    return C.entropy(n, ["source"]).select("source", F.round("entropy", 9).alias("entropy"), F.round("effective", 9).alias("effective"))


@query("agg17_class_weights", sql("v_corpus", body=f"SELECT label::INT AS label, round(CASE WHEN n > 0 THEN sum(n) OVER () / (count(*) FILTER (n > 0) OVER () * n) ELSE 0 END, 9) AS weight FROM (SELECT d.label, count(c.ord) AS n FROM {_DIM} LEFT JOIN (SELECT * FROM v_corpus WHERE label <> 1 AND (label > 0 OR ord % 3 = 0)) c ON c.label = d.label GROUP BY 1)"))
def _(spark, sf):
    return C.class_weights(V.v_corpus(spark, sf).where("label <> 1 AND (label > 0 OR ord % 3 = 0)")).select("label", F.round("weight", 9).alias("weight"))


@query("agg18_arm_means", sql("v_pred", "v_runs", body="SELECT generator, frac, round(avg(ba), 9) AS ba FROM v_runs GROUP BY 1, 2"))
def _(spark, sf):
    return V.v_runs(spark, sf).groupBy("generator", "frac").agg(F.round(F.avg("ba"), 9).alias("ba"))


@query("agg19_request_perception", sql("v_pred", body="SELECT y_true, y_pred, round(n / sum(n) OVER (PARTITION BY y_true), 9) AS share FROM (SELECT y_true, y_pred, count(*) AS n FROM v_pred GROUP BY 1, 2)"))
def _(spark, sf):
    n = V.v_pred(spark, sf).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return n.select("y_true", "y_pred", F.round(F.col("n") / F.sum("n").over(W.partitionBy("y_true")), 9).alias("share"))


@query("win3_average_rank", sql("v_docs", body="SELECT ord, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM v_docs"))
def _(spark, sf):
    return C.average_rank(V.v_docs(spark, sf), ["lang"], "n_chars", "r").select("ord", "r")


@query("win4_ordinal_rank", sql("v_docs", body="SELECT ord, (row_number() OVER (PARTITION BY lang ORDER BY n_chars, ord) - 1)::BIGINT AS r FROM v_docs"))
def _(spark, sf):
    return C.ordinal_rank(V.v_docs(spark, sf), ["lang"], "n_chars", "ord", "r").select("ord", F.col("r").cast("long").alias("r"))


@query("win6_ntiles", sql("v_docs", body="SELECT ord, ntile(3) OVER (PARTITION BY label ORDER BY n_chars, ord)::INT AS tile FROM v_docs"))
def _(spark, sf):
    return V.v_docs(spark, sf).select("ord", F.ntile(3).over(W.partitionBy("label").orderBy("n_chars", "ord")).alias("tile"))


@query("win7_tertiles", sql("v_docs", body="SELECT ord, (CASE WHEN n_chars <= a THEN 0 WHEN n_chars <= b THEN 1 ELSE 2 END)::INT AS tertile FROM v_docs, (SELECT quantile_cont(n_chars, 1 / 3::DOUBLE) AS a, quantile_cont(n_chars, 2 / 3::DOUBLE) AS b FROM v_docs)"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    edges = d.agg(F.percentile("n_chars", 1 / 3).alias("a"), F.percentile("n_chars", 2 / 3).alias("b"))
    return d.crossJoin(F.broadcast(edges)).select("ord", F.when(F.col("n_chars") <= F.col("a"), 0).when(F.col("n_chars") <= F.col("b"), 1).otherwise(2).alias("tertile"))


@query("win9_balanced_prefix", sql("v_corpus", body="SELECT ord, row_number() OVER (ORDER BY r, label)::BIGINT AS place FROM (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY ord) AS r FROM v_corpus)"))
def _(spark, sf):
    ranked = V.v_corpus(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("ord")))
    n = ranked.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("r", F.coalesce(F.sum("n").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranked.join(before, "r").select("ord", (F.col("before") + F.row_number().over(W.partitionBy("r").orderBy("label"))).cast("long").alias("place"))


@query("win10_canonical_groups", sql("v_docs", body="SELECT ord, printf('grp_%06d', dense_rank() OVER (ORDER BY f) - 1) AS gid FROM (SELECT ord, min(ord) OVER (PARTITION BY grp) AS f FROM v_docs)"))
def _(spark, sf):
    return C.first_appearance_ids(V.v_docs(spark, sf), "grp", "ord", "grp_").select("ord", "gid")


@query("srt1_nulls_first", "SELECT k, n, row_number() OVER (ORDER BY k NULLS FIRST)::INT AS place FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1)")
def _(spark, sf):
    n = V.table(spark, sf, "events").groupBy(F.when(F.col("event_type") != "error", F.col("event_type")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_first("k"))))


@query("srt3_largest_groups_first", sql("v_docs", body="SELECT grp, size, row_number() OVER (ORDER BY size DESC, md5(concat_ws('|', 5, grp)), grp) AS place FROM (SELECT grp, count(*) AS size FROM v_docs GROUP BY 1)"))
def _(spark, sf):
    g = V.v_docs(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    return C.numbered(g, [F.desc("size"), order_key(5, F.col("grp")), F.col("grp")])


@query("srt4_means_descending", sql("v_docs", body="SELECT source, round(avg(n_chars), 6) AS mean, row_number() OVER (ORDER BY avg(n_chars) DESC, source)::INT AS place FROM v_docs GROUP BY 1"))
def _(spark, sf):
    m = V.v_docs(spark, sf).groupBy("source").agg(F.avg("n_chars").alias("m"))
    return m.select("source", F.round("m", 6).alias("mean"), F.row_number().over(W.orderBy(F.desc("m"), "source")).alias("place"))


@query("srt5_balanced_cap", sql("v_docs", body="SELECT ord, lang FROM (SELECT ord, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 9, ord)), ord) AS rn, (SELECT min(n) FROM (SELECT count(*) AS n FROM v_docs GROUP BY lang)) AS least FROM v_docs) WHERE rn <= least"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    least = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    ranked = d.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(order_key(9, F.col("ord")), "ord")))
    return ranked.crossJoin(F.broadcast(least)).where("rn <= least").select("ord", "lang")


@query("srt6_prefix", sql("v_corpus", body="SELECT ord, path FROM v_corpus ORDER BY ord LIMIT 100"))
def _(spark, sf):
    return V.v_corpus(spark, sf).select("ord", "path").orderBy("ord").limit(100)


@query("srt7_report_order", sql("v_docs", body="SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, row_number() OVER (ORDER BY avg(n_chars) DESC, source, lang)::INT AS place FROM v_docs GROUP BY 1, 2 HAVING count(*) >= 10"))
def _(spark, sf):
    m = V.v_docs(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m")).where("n >= 10")
    return m.select("source", "lang", "n", F.round("m", 6).alias("mean"), F.row_number().over(W.orderBy(F.desc("m"), "source", "lang")).alias("place"))


@query("set1_concat", sql("v_corpus", body="SELECT row_number() OVER (ORDER BY part, ord) AS place, path FROM (SELECT 0 AS part, * FROM v_corpus WHERE source = 'real' UNION ALL SELECT 1, * FROM v_corpus WHERE source = 'synth_open')"))
def _(spark, sf):
    c = V.v_corpus(spark, sf).select("ord", "path", "label", "source")
    both = C.concat(C.real(c), C.matching(c, source="synth_open"))
    return C.numbered(both, [F.col("part"), F.col("ord")]).select("place", "path")


@query("set2_intersect", sql("v_docs", body="SELECT grp FROM v_docs WHERE label = 0 INTERSECT SELECT grp FROM v_docs WHERE label = 1"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    return d.where("label = 0").select("grp").intersect(d.where("label = 1").select("grp"))


@query("set3_except", sql("v_docs", body="SELECT grp FROM v_docs WHERE label = 0 EXCEPT SELECT grp FROM v_docs WHERE label = 1"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    return d.where("label = 0").select("grp").subtract(d.where("label = 1").select("grp"))


@query("set4_distinct_union", sql("v_docs", body="SELECT grp FROM v_docs WHERE label = 0 UNION SELECT grp FROM v_docs WHERE label = 1"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    return d.where("label = 0").select("grp").union(d.where("label = 1").select("grp")).distinct()


@query("set6_keep_first", sql("v_docs", body="SELECT ord, grp FROM v_docs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1"))
def _(spark, sf):
    return C.keep_first(V.v_docs(spark, sf).select("ord", "grp"), ["grp"], [F.col("ord")])


@query("set7_overlap_sample", sql("v_docs", body="SELECT grp FROM (SELECT grp FROM v_docs WHERE ord % 2 = 0 INTERSECT SELECT grp FROM v_docs WHERE ord % 2 = 1) ORDER BY grp LIMIT 5"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    return d.where("ord % 2 = 0").select("grp").intersect(d.where("ord % 2 = 1").select("grp")).orderBy("grp").limit(5)


@query("fn1_band", sql("v_counts", body=f"SELECT item, {BAND.format('c2')}::INT AS grade FROM v_counts"))
def _(spark, sf):
    return V.v_counts(spark, sf).select("item", V.band("c2").alias("grade"))


_WILSON = sql("v_docs", body="SELECT lang, round((p + 1.96::DOUBLE ** 2 / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ** 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ** 2 / n), 9) AS lo, round((p + 1.96::DOUBLE ** 2 / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ** 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ** 2 / n), 9) AS hi FROM (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (label = 0) / count(*) AS p FROM v_docs GROUP BY 1)")


@query("fn2_wilson", _WILSON)
@query("sta11_wilson", _WILSON)
def _(spark, sf):
    n = V.v_docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return n.select("lang", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("fn3_arm_names", "SELECT f, CASE k % 3 WHEN 0 THEN printf('sub_p%03d', round_even(f * 100, 0)::INT) WHEN 1 THEN printf('realonly_p%03d', round_even(f * 100, 0)::INT) ELSE concat(printf('add_n%03d_k', round_even(f * 100, 0)::INT), CASE WHEN (k / 2.0::DOUBLE) = floor(k / 2.0::DOUBLE) THEN (k // 2)::VARCHAR ELSE (k / 2.0::DOUBLE)::VARCHAR END) END AS name, k FROM (SELECT DISTINCT (l_linenumber % 5) / 8.0::DOUBLE AS f, (l_orderkey % 7)::INT AS k FROM lineitem)")
def _(spark, sf):
    r = V.table(spark, sf, "lineitem").select(((F.col("l_linenumber") % 5) / 8.0).alias("f"), (F.col("l_orderkey") % 7).cast("int").alias("k")).distinct()
    kind = F.element_at(F.array(F.lit("substitution"), F.lit("real_subset"), F.lit("additive")), F.col("k") % 3 + 1)
    return r.select("f", S.arm_name(kind, F.col("f"), F.col("f"), F.col("k") / 2).alias("name"), "k")


@query("fn4_path_parts", "SELECT url, regexp_extract(url, '[^/]*$') AS base, regexp_extract(regexp_extract(url, '[^/]*$'), '[^.](\\.[^.]+)$', 1) AS suffix FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("url", S.basename(F.col("url")).alias("base"), S.suffix(F.col("url")).alias("suffix"))


@query("fn5_prefix_label", sql("v_docs", body="SELECT ord, TRY_CAST(substr(source, 4) AS INT) = label AS agrees FROM v_docs"))
def _(spark, sf):
    return V.v_docs(spark, sf).select("ord", (F.expr("try_cast(substring(source, 4, 10) as int)") == F.col("label")).alias("agrees"))


@query("fn7_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS sha, md5(text) AS md5 FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha"), F.md5("text").alias("md5"))


@query("fn15_auc_note", "SELECT k, CASE WHEN a >= 0.99 THEN 'trivially separable' WHEN a >= 0.90 THEN 'easily separable' WHEN a >= 0.70 THEN 'partly separable' ELSE 'hard to separate' END AS note FROM (SELECT p_partkey AS k, (p_partkey % 101) / 100.0::DOUBLE AS a FROM part)")
def _(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 101) / 100.0).alias("a"))
    return p.select("k", S.discriminability_note(F.col("a")).alias("note"))


@query("fn16_release_note", "SELECT k, CASE WHEN a >= 0.05 THEN 'do not release' WHEN a >= 0.01 THEN 'review matches' ELSE 'no concern' END AS note FROM (SELECT p_partkey AS k, (p_partkey % 101) / 1000.0::DOUBLE AS a FROM part)")
def _(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 101) / 1000.0).alias("a"))
    return p.select("k", S.release_note(F.col("a")).alias("note"))


@query("fn17_regex_extract", "SELECT t, regexp_extract(t, 'Fitzpatrick (I{1,3}V?|IV|VI?)\\b', 1) AS skin FROM (SELECT DISTINCT concat('a face, Fitzpatrick ', ['I', 'II', 'III', 'IV', 'V', 'VI'][(user_id % 6 + 1)::INT], ' skin') AS t FROM events)")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI")])
    t = V.table(spark, sf, "events").select(F.concat(F.lit("a face, Fitzpatrick "), F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")), F.lit(" skin")).alias("t")).distinct()
    return t.select("t", S.fitzpatrick(F.col("t")).alias("skin"))


@query("fn18_json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(props->>'missing', 'default') AS missing FROM events")
def _(spark, sf):
    p = F.from_json("props", "k bigint, missing string")
    return V.table(spark, sf, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("default")).alias("missing"))


@query("fn20_stops_tag", "SELECT DISTINCT s, concat(CASE WHEN s < 0 THEN 'm' ELSE 'p' END, lpad((round_even(abs(s) * 10, 0))::INT::VARCHAR, 2, '0')) AS tag FROM (SELECT (l_linenumber - 4) / 4.0::DOUBLE AS s FROM lineitem)")
def _(spark, sf):
    s = V.table(spark, sf, "lineitem").select(((F.col("l_linenumber") - 4) / 4.0).alias("s")).distinct()
    return s.select("s", S.stops_tag(F.col("s")).alias("tag"))


@query("fn21_generator_label", sql("v_corpus", body="SELECT grp, CASE WHEN count(*) FILTER (label = 3) > 0 THEN 'real_subset' WHEN count(*) FILTER (source <> 'real') = 0 THEN 'none' ELSE 'closed' END AS generator FROM v_corpus GROUP BY 1"))
def _(spark, sf):
    g = V.v_corpus(spark, sf).groupBy("grp").agg(F.when(F.count_if(F.col("label") == 3) > 0, "real_subset").otherwise("mix").alias("kind"), F.count_if(F.col("source") != "real").alias("n"))
    return g.select("grp", S.generator_label(F.col("kind"), F.col("n"), F.lit("closed")).alias("generator"))


@query("flt3_buckets", sql("v_corpus", body="SELECT l::INT AS label, path FROM range(5) r(l) LEFT JOIN v_corpus ON label = l AND label > 0"))
def _(spark, sf):
    return C.buckets(V.v_corpus(spark, sf).where("label > 0"), 5).select("label", "path")


@query("fn6_object_hash", "SELECT n_nationkey AS k, substr(sha256(concat('{\"name\": \"', n_name, '\", \"region\": ', n_regionkey, '}')), 1, 16) AS digest FROM nation")
def _(spark, sf):
    n = V.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("k"), S.object_hash({"region": F.col("n_regionkey"), "name": F.col("n_name")}).alias("digest"))

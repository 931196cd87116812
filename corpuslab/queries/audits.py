"""Label, duplicate, fold and attempt audits; fidelity; class geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators import audits as A
from corpuslab.operators import metrics as M
from corpuslab.operators import similarity as S
from corpuslab.operators import tone as N
from corpuslab.queries import views as V
from corpuslab.queries.views import BAND, SQL, sql
from corpuslab.registry import query


@query("aud1_exact_duplicates", sql("v_docs", body="SELECT grp, count(*) AS n FROM v_docs GROUP BY 1 HAVING count(*) > 1"))
def _(spark, sf):
    return A.exact_duplicates(V.v_docs(spark, sf), "grp")


@query("aud2_pair_consistency", sql("v_docs", body="SELECT count(*) AS pairs, count(*) FILTER (l0 = l1) AS same_label, count(*) FILTER (d = 0) AS same_count, max(d) FILTER (rn = m // 2 + 1) AS median, round(avg(d), 9) AS mean, max(d) AS greatest FROM (SELECT *, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS m FROM (SELECT grp, min(label) AS l0, max(label) AS l1, max(ord) - min(ord) AS d FROM v_docs GROUP BY 1 HAVING count(*) = 2))"))
def _(spark, sf):
    return A.pair_consistency(V.v_docs(spark, sf), "grp", "label", "ord").withColumn("mean", F.round("mean", 9))


@query("aud3_fold_leakage", sql("v_docs", body="SELECT fold, count(*) AS n, count(*) FILTER (same) AS free, count(*) FILTER (anyc AND NOT same) AS forced FROM (SELECT (x.ord % 5)::INT AS fold, EXISTS (SELECT 1 FROM v_docs y WHERE y.grp = x.grp AND y.ord % 5 <> x.ord % 5 AND y.label = x.label) AS same, EXISTS (SELECT 1 FROM v_docs y WHERE y.grp = x.grp AND y.ord % 5 <> x.ord % 5) AS anyc FROM v_docs x) GROUP BY 1"))
def _(spark, sf):
    return A.fold_leakage(V.v_docs(spark, sf).withColumn("fold", (F.col("ord") % 5).cast("int")), "grp", "label", "fold")


@query("aud4_label_rule", sql("v_counts", body=f"SELECT item, {BAND.format('c2')}::INT AS grade, {BAND.format('c1 * 4')}::INT AS band FROM v_counts WHERE {BAND.format('c2')} <> {BAND.format('c1 * 4')}"))
def _(spark, sf):
    c = V.v_counts(spark, sf).withColumn("c4", F.col("c1") * 4)
    return c.select("item", V.band("c2").alias("grade"), V.band("c4").alias("band")).where("grade <> band")


@query("aud6_stratum_confound", sql("v_docs", body="SELECT label, count(*) AS n, round(avg((lang = (SELECT lang FROM v_docs GROUP BY lang ORDER BY count(*) DESC, min(ord) LIMIT 1))::INT::DOUBLE), 9) AS on_mode FROM v_docs GROUP BY 1"))
def _(spark, sf):
    return A.stratum_confound(V.v_docs(spark, sf), "lang", "ord", "label").select("label", "n", F.round("on_mode", 9).alias("on_mode"))


@query("aud6_rule_quality", sql("v_docs", body="SELECT round(avg((n_chars > 2000)::INT::DOUBLE) FILTER (label = 0), 9) AS sensitivity, round(avg((n_chars <= 2000)::INT::DOUBLE) FILTER (label <> 0), 9) AS specificity FROM v_docs"))
def _(spark, sf):
    q = A.rule_quality(V.v_docs(spark, sf), F.col("n_chars") > 2000, F.col("label") == 0)
    return q.select(F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


_C = sql("v_counts", body="").rstrip()
_HIST = f"h AS (SELECT {BAND.format('c1 * 4')} AS label, count(*) AS n FROM v_counts GROUP BY 1), e AS (SELECT label, sum(n) OVER (ORDER BY label) AS hi, sum(n) OVER (ORDER BY label) - n AS lo FROM h), q AS (SELECT item, c1, c2, row_number() OVER (ORDER BY c2, item) AS rn FROM v_counts)"


@query("win5_rebanded", _C + ", " + _HIST + " SELECT item, label::INT AS matched FROM q JOIN e ON rn > lo AND rn <= hi")
def _(spark, sf):
    c = V.v_counts(spark, sf).withColumn("c4", F.col("c1") * 4)
    h = c.groupBy(V.band("c4").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return A.rebanded(c, "c2", "item", h).select("item", "matched")


@query("aud8_cross_annotation", _C + " SELECT count(*) AS n, round(avg(c1 * 4), 9) AS mean1, round(avg(c2), 9) AS mean2, round(avg((c2 > c1 * 4)::INT::DOUBLE), 9) AS greater, round(quantile_cont(c2 / greatest(c1 * 4, 1), 0.1), 9) AS p10, round(quantile_cont(c2 / greatest(c1 * 4, 1), 0.9), 9) AS p90, " + f"round(avg(({BAND.format('c2')} = {BAND.format('c1 * 4')})::INT::DOUBLE), 9) AS agreement, round(avg((abs({BAND.format('c2')} - {BAND.format('c1 * 4')}) = 1)::INT::DOUBLE), 9) AS off_by_one FROM v_counts")
def _(spark, sf):
    c = V.v_counts(spark, sf).withColumn("c4", F.col("c1") * 4)
    ratio, d = F.col("c2") / F.greatest("c4", F.lit(1)), F.abs(V.band("c2") - V.band("c4"))
    share = lambda x: F.round(F.avg(x.cast("double")), 9)
    return c.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c4"), 9).alias("mean1"), F.round(F.avg("c2"), 9).alias("mean2"), share(F.col("c2") > F.col("c4")).alias("greater"),
        F.round(F.percentile(ratio, 0.1), 9).alias("p10"), F.round(F.percentile(ratio, 0.9), 9).alias("p90"), share(d == 0).alias("agreement"), share(d == 1).alias("off_by_one"),
    )


@query("aud8_closed_bands", _C + ", z AS (SELECT quantile_cont(c2, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM v_counts), e AS (SELECT i, q[i + 1] AS lo, q[i + 2] AS hi FROM z, (VALUES (0), (1), (2), (3), (4)) r(i)) SELECT i::INT AS band, count(*) AS n, round(avg(c1), 9) AS mean FROM v_counts JOIN e ON c2 BETWEEN lo AND hi GROUP BY 1")
def _(spark, sf):
    return A.quantile_bands(V.v_counts(spark, sf), "c2").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c1"), 9).alias("mean"))


_NEAR = f"c AS ({SQL['v_corpus']}), u AS (SELECT ord, label, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM c), n AS (SELECT x.ord AS id, max(list_dot_product(x.v, y.v)) >= 0.3 AS leaked FROM u x, u y WHERE x.ord % 5 = 0 AND y.ord % 5 <> 0 GROUP BY 1), p AS (SELECT event_id % 500 AS id, y_true, y_pred FROM v_pred)"


@query("jn5_leaked_flag_join", sql("v_pred", body="").rstrip() + ", " + _NEAR + " SELECT coalesce(leaked, FALSE) AS leaked, count(*) AS n, round(avg((y_true = y_pred)::INT::DOUBLE), 9) AS accuracy FROM p LEFT JOIN n USING (id) GROUP BY 1")
@query("aud10_leaked_clean", sql("v_pred", body="").rstrip() + ", " + _NEAR + " SELECT coalesce(leaked, FALSE) AS leaked, count(*) AS n, round(avg((y_true = y_pred)::INT::DOUBLE), 9) AS accuracy FROM p LEFT JOIN n USING (id) GROUP BY 1")
def _(spark, sf):
    v = V.v_corpus(spark, sf)
    near = S.nearest(v.where("ord % 5 = 0"), v.where("ord % 5 <> 0")).select("id", (F.col("sim") >= 0.3).alias("leaked"))
    p = V.v_pred(spark, sf).withColumn("id", F.col("event_id") % 500).join(near, "id", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    return p.groupBy("leaked").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 9).alias("accuracy"))


_STATE = sql("v_manifest", body="").rstrip() + ", s AS (SELECT name, any_value(substrate) AS substrate, CASE WHEN bool_or(path IS NOT NULL) THEN 'ok' ELSE arg_max(CASE WHEN blocked_reason LIKE '%429%' THEN '429' ELSE 'empty' END, ord) END AS state FROM v_manifest GROUP BY 1)"


@query("win8_last_state", _STATE + " SELECT name, state FROM s")
def _(spark, sf):
    return A.last_state(V.v_manifest(spark, sf))


@query("aud12_refusal_yield", _STATE + " SELECT substrate, ok, empty, throttled, round(y, 9) AS yield, round(CASE WHEN y > 0 THEN greatest(900 - ok, 0) / y ELSE 'Infinity'::DOUBLE END, 6) AS needed FROM (SELECT substrate, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = '429') AS throttled, coalesce(count(*) FILTER (state = 'ok') / nullif(count(*) FILTER (state IN ('ok', 'empty')), 0), 0) AS y FROM s GROUP BY 1)")
def _(spark, sf):
    m = V.v_manifest(spark, sf)
    s = A.last_state(m).join(m.select("name", "substrate").distinct(), "name")
    return A.refusal_yield(s, "substrate", 900).select("substrate", "ok", "empty", "throttled", F.round("yield", 9).alias("yield"), F.round("needed", 6).alias("needed"))


@query("aud13_persistently_refused", sql("v_manifest", body="SELECT name, count(*) FILTER (path IS NULL AND blocked_reason NOT LIKE '%429%') AS empties FROM v_manifest GROUP BY 1 HAVING count(*) FILTER (path IS NULL AND blocked_reason NOT LIKE '%429%') >= 2 AND NOT bool_or(path IS NOT NULL)"))
def _(spark, sf):
    return A.persistently_refused(V.v_manifest(spark, sf))


_BASE = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS base FROM pages)"


@query("jn17_meta_by_stem", f"WITH {_BASE}, f AS (SELECT page_id, regexp_replace(base, '[.]html$', '') AS stem FROM p WHERE base LIKE '%.html'), m AS (SELECT base AS stem, min(page_id) AS meta_id FROM p WHERE base NOT LIKE '%.html' GROUP BY 1) SELECT stem, page_id, meta_id, meta_id IS NULL AS missing FROM f LEFT JOIN m USING (stem)")
def _(spark, sf):
    from corpuslab.functions.scalars import basename

    p = V.table(spark, sf, "pages").select("page_id", basename(F.regexp_replace("url", "[?#].*$", "")).alias("base"))
    # Addresses with the suffix are the files; all others are the metadata, a row for each stem. Files without metadata are the guard's report.
    files = p.where(F.col("base").endswith(".html")).select("page_id", F.regexp_replace("base", "[.]html$", "").alias("stem"))
    meta = p.where(~F.col("base").endswith(".html")).groupBy(F.col("base").alias("stem")).agg(F.min("page_id").alias("meta_id"))
    return files.join(meta, "stem", "left").select("stem", "page_id", "meta_id", F.col("meta_id").isNull().alias("missing"))


_P = sql("v_pred", body="").rstrip() + ", c AS (SELECT init, y_true, y_pred, count(*) AS n FROM v_pred GROUP BY 1, 2, 3)"


@query("fid1_continuity_scope", _P + " SELECT init, round(continuity, 9) AS continuity, round(scope, 9) AS scope FROM (SELECT a.init, 100 * sum(CASE WHEN a.y_pred < b.y_pred THEN 1.0::DOUBLE WHEN a.y_pred = b.y_pred THEN 0.5 ELSE 0 END * a.n * b.n) / sum(a.n * b.n) AS continuity FROM c a JOIN c b ON a.init = b.init AND a.y_true < b.y_true GROUP BY 1) JOIN (SELECT init, 100 * (max(m) - min(m)) / 3 AS scope FROM (SELECT init, y_true, sum(y_pred * n) / sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1) USING (init)")
def _(spark, sf):
    cells = M.confusion(V.v_pred(spark, sf), ["init"])
    out = A.concordance(cells, ["init"]).join(A.scope(cells, ["init"]), "init")
    return out.select("init", F.round("continuity", 9).alias("continuity"), F.round("scope", 9).alias("scope"))


@query("fid2_substrate_table", sql("v_pred", body="SELECT (event_id % 12)::BIGINT AS substrate, count(*) AS n, round(avg((y_true = y_pred)::INT::DOUBLE), 9) AS exact FROM v_pred GROUP BY 1 HAVING count(*) >= 30"))
def _(spark, sf):
    p = V.v_pred(spark, sf).groupBy((F.col("event_id") % 12).alias("substrate"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 9).alias("exact")).where("n >= 30")


@query("fid3_matched_draws", sql("v_pred", body="SELECT draw, round(100 * (max(m) - min(m)) / 3, 9) AS scope FROM (SELECT draw, y_true, avg(y_pred) AS m FROM (SELECT d AS draw, y_true, y_pred, row_number() OVER (PARTITION BY d, y_true ORDER BY md5(concat_ws('|', d, ord)), ord) AS rn FROM v_pred, range(4) r(d)) WHERE rn <= 25 GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    from corpuslab.operators.mixing import permutation

    p = V.v_pred(spark, sf).select("ord", "y_true", "y_pred").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    picked = permutation(p, F.col("draw"), ["draw", "y_true"]).where("rn < 25").withColumn("n", F.lit(1))
    return A.scope(picked, ["draw"]).select("draw", F.round("scope", 9).alias("scope"))


@query("fid4_offsets", sql("v_pred", body="SELECT init, y_true, round(avg(y_pred - y_true), 9) AS shift FROM v_pred GROUP BY 1, 2"))
def _(spark, sf):
    return V.v_pred(spark, sf).groupBy("init", "y_true").agg(F.round(F.avg(F.col("y_pred") - F.col("y_true")), 9).alias("shift"))


_SAT = "m AS (SELECT seed, y_true, avg(y_pred) AS m FROM v_pred GROUP BY 1, 2), l AS (SELECT *, lag(m) OVER (PARTITION BY seed ORDER BY y_true) AS p FROM m) SELECT seed, min(y_true) FILTER (m <= p + 0.3) AS saturates_at FROM l GROUP BY 1"


@query("fid5_saturation", sql("v_pred", body="").rstrip() + ", " + _SAT)
@query("win14_saturation", sql("v_pred", body="").rstrip() + ", " + _SAT)
def _(spark, sf):
    m = V.v_pred(spark, sf).groupBy("seed", "y_true").agg(F.avg("y_pred").alias("m"))
    return A.saturation(m, ["seed"], "y_true", "m", 0.3)


@query("win15_monotone", sql("v_pred", body="").rstrip() + ", m AS (SELECT seed, y_true, avg(y_pred) AS m FROM v_pred GROUP BY 1, 2), l AS (SELECT seed, m > lag(m) OVER (PARTITION BY seed ORDER BY y_true) AS up FROM m) SELECT seed, coalesce(bool_and(up), TRUE) AS rising FROM l GROUP BY 1")
def _(spark, sf):
    return A.monotone(V.v_pred(spark, sf).groupBy("seed", "y_true").agg(F.avg("y_pred").alias("m")), ["seed"], "y_true", "m")


_FLAT = f"WITH c AS ({SQL['v_corpus']}), f AS (SELECT ord, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM c), k AS (SELECT label, d, avg(x) AS m, var_pop(x) AS v FROM f GROUP BY 1, 2)"


@query("cls4_scatter", _FLAT + " SELECT round(w, 9) AS within, round(b, 9) AS between, round(b / w, 9) AS ratio FROM (SELECT avg(s) AS w FROM (SELECT sum(v) AS s FROM k GROUP BY label)), (SELECT sum(s) AS b FROM (SELECT var_pop(m) AS s FROM k GROUP BY d))")
def _(spark, sf):
    return A.scatter(V.v_corpus(spark, sf)).select(*[F.round(c, 9).alias(c) for c in ("within", "between", "ratio")])


_MARGIN = _FLAT + ", g AS (SELECT f.ord, f.label, k.label AS o, sqrt(sum((x - m) ** 2)) AS r FROM f JOIN k USING (d) GROUP BY 1, 2, 3), mg AS (SELECT ord, label, min(r) FILTER (o <> label) - min(r) FILTER (o = label) AS margin FROM g GROUP BY 1, 2)"


@query("cls5_margins", _MARGIN + " SELECT ord, label, round(margin, 6) AS margin FROM mg")
def _(spark, sf):
    v = V.v_corpus(spark, sf)
    return A.margins(v, v).select("ord", "label", F.round("margin", 6).alias("margin"))


@query("cls6_margin_strata", _MARGIN + " SELECT label, tile::INT AS tile, count(*) AS n, round(avg(margin), 6) AS mean FROM (SELECT *, ntile(3) OVER (PARTITION BY label ORDER BY round(margin, 9), ord) AS tile FROM mg) GROUP BY 1, 2")
def _(spark, sf):
    v = V.v_corpus(spark, sf)
    t = A.margins(v, v).withColumn("tile", F.ntile(3).over(W.partitionBy("label").orderBy(F.round("margin", 9), "ord")))
    return t.groupBy("label", "tile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("mean"))


@query("cls7_block_slice", "SELECT vec_id, round(list_sum(embedding[17:32]::DOUBLE[]), 6) AS total FROM embeddings")
def _(spark, sf):
    part = F.slice(F.col("embedding").cast("array<double>"), 17, 16)
    return V.table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("abl2_source_detectability", sql("v_docs", body="SELECT round(avg((lang <> (SELECT lang FROM v_docs GROUP BY lang ORDER BY count(*) DESC, min(ord) LIMIT 1))::INT::DOUBLE), 9) AS off_mode, round(max(n) / sum(n), 9) AS floor FROM v_docs JOIN (SELECT label, count(*) AS n FROM v_docs GROUP BY 1) USING (label)"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    top = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("f")).agg(F.max_by("lang", F.struct("n", -F.col("f"))).alias("top"))
    n = d.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("label")))
    return n.crossJoin(F.broadcast(top)).agg(F.round(F.avg((F.col("lang") != F.col("top")).cast("double")), 9).alias("off_mode"), F.round(F.max("n") / F.sum("n"), 9).alias("floor"))


_FID3 = "d AS (SELECT d AS draw, y_true, y_pred, row_number() OVER (PARTITION BY d, y_true ORDER BY md5(concat_ws('|', d, ord)), ord) AS rn FROM v_pred, range(40) r(d)), s AS (SELECT draw, 100 * (max(m) - min(m)) / 3 AS scope FROM (SELECT draw, y_true, avg(y_pred) AS m FROM d WHERE rn <= 25 GROUP BY 1, 2) GROUP BY 1), o AS (SELECT 100 * (max(m) - min(m)) / 3 AS scope FROM (SELECT y_true, avg(y_pred) AS m FROM v_pred GROUP BY 1))"


@query("fid3_small_n_bias", sql("v_pred", body="").rstrip() + ", " + _FID3 + " SELECT round(any_value(o.scope), 9) AS observed, round(avg(s.scope), 9) AS mean, round(quantile_cont(s.scope, 0.025), 9) AS lo, round(quantile_cont(s.scope, 0.975), 9) AS hi, round(avg((s.scope >= o.scope - 1e-9)::INT::DOUBLE), 9) AS at_least FROM s, o")
def _(spark, sf):
    p = V.v_pred(spark, sf).select("ord", "y_true", "y_pred")
    return A.small_n_bias(p, 25, 40).select(*[F.round(c, 9).alias(c) for c in ("observed", "mean", "lo", "hi", "at_least")])

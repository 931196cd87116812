"""Mixtures, splits, leakage, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions.draws import order_key
from corpuslab.operators import corpus as C
from corpuslab.operators import mixing as X
from corpuslab.operators import prompts as P
from corpuslab.operators import splits as S
from corpuslab.queries import views as V
from corpuslab.queries.views import D, SQL, sql
from corpuslab.registry import query

_RN = "row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', {seed}, ord)), ord) - 1"


@query("smp1_largest_remainder", sql("v_docs", body="SELECT lang, label, quota FROM (SELECT *, (fl + (row_number() OVER (PARTITION BY lang ORDER BY frac DESC, label) <= 37 - sum(fl) OVER (PARTITION BY lang))::INT)::BIGINT AS quota FROM (SELECT *, floor(x) AS fl, round(x - floor(x), 9) AS frac FROM (SELECT lang, label, 37 * count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS x FROM v_docs GROUP BY 1, 2)))"))
def _(spark, sf):
    n = V.v_docs(spark, sf).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))
    return X.largest_remainder(n, ["lang"], F.lit(37)).select("lang", "label", "quota")


@query("win1_seeded_permutation", sql("v_corpus", body=f"SELECT ord, ({_RN.format(seed=7)})::INT AS rn FROM v_corpus"))
def _(spark, sf):
    return X.permutation(V.v_corpus(spark, sf), 7, ["label"]).select("ord", "rn")


@query("win2_rotated_permutation", sql("v_corpus", body=f"SELECT ord, (((rn - (2 % 5) * (n // 5)) % n + n) % n)::BIGINT AS rn FROM (SELECT ord, {_RN.format(seed=7)} AS rn, count(*) OVER (PARTITION BY label) AS n FROM v_corpus)"))
def _(spark, sf):
    return X.rotated(X.permutation(V.v_corpus(spark, sf), 7, ["label"]), 2, 5, ["label"]).select("ord", F.col("rn").cast("long").alias("rn"))


_DESIGN = "(VALUES (0, 'substitution', 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0), (1, 'substitution', 0.25, 1.0, 0.0, 1), (2, 'real_subset', 0.5, 1.0, 0.0, 2), (3, 'additive', 0.0, 0.5, 1.5, 3)) d(arm_id, kind, p, rbf, k, seed)"
_SPECS = [X.MixSpec("substitution", 0.0), X.MixSpec("substitution", 0.25, seed=1), X.MixSpec("real_subset", 0.5, seed=2), X.MixSpec("additive", 0.0, 0.5, 1.5, 3)]


@query(
    "smp2_mixtures",
    f"WITH v_corpus AS ({SQL['v_corpus']}), real AS (SELECT * FROM v_corpus WHERE source = 'real'), pool AS (SELECT * FROM v_corpus WHERE source <> 'real'), "
    f"d AS (SELECT *, round_even((SELECT count(*) FROM real) * rbf, 0) AS budget FROM {_DESIGN}), "
    "e AS (SELECT *, CASE kind WHEN 'additive' THEN budget ELSE round_even(budget * (1 - p), 0) END AS nr FROM d), "
    "w AS (SELECT arm_id, seed, 'real' AS part, nr AS want FROM e UNION ALL SELECT arm_id, seed, 'synthetic', CASE kind WHEN 'additive' THEN round_even(budget * k, 0) WHEN 'substitution' THEN budget - nr ELSE 0 END FROM e), "
    "h AS (SELECT label, count(*) AS n FROM real GROUP BY 1), x AS (SELECT *, want * n / sum(n) OVER (PARTITION BY arm_id, part) AS ex FROM w, h), "
    "y AS (SELECT *, floor(ex) AS fl, round(ex - floor(ex), 9) AS fr FROM x), q AS (SELECT *, fl + (row_number() OVER (PARTITION BY arm_id, part ORDER BY fr DESC, label) <= want - sum(fl) OVER (PARTITION BY arm_id, part))::INT AS quota FROM y), "
    "r AS (SELECT 'real' AS part, seed, ord, label, row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat_ws('|', seed, ord)), ord) - 1 AS rn FROM real, (SELECT DISTINCT seed FROM d) "
    "UNION ALL SELECT 'synthetic', seed, ord, label, ((rn - (seed % 5) * (n // 5)) % n + n) % n FROM (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'pool', ord)), ord) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM pool), (SELECT DISTINCT seed FROM d)) "
    "SELECT q.arm_id::INT AS arm_id, q.part, r.ord FROM q JOIN r ON q.seed = r.seed AND q.part = r.part AND q.label = r.label WHERE rn < quota",
)
def _(spark, sf):
    c = V.v_corpus(spark, sf)
    return X.build_mixtures(C.real(c), C.synthetic(c), X.arms(spark, _SPECS)).select("arm_id", "part", "ord")


@query("smp4_arms", "SELECT concat(printf('add_n%03d_k', round_even(b * 100, 0)::INT), k) AS arm FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) x(b), (VALUES ('0'), ('0.5'), ('1'), ('2'), ('4'), ('8')) y(k) UNION ALL SELECT printf('sub_p%03d', (i * 25)::INT) FROM range(5) r(i) UNION ALL SELECT printf('realonly_p%03d', (i * 25)::INT) FROM range(1, 4) r(i)")
def _(spark, sf):
    return X.arms(spark, X.additive_arms() + X.substitution_arms() + X.control_arms()).select("arm")


_GREEDY = (
    "WITH RECURSIVE v_docs AS (" + SQL["v_docs"] + "), m AS (SELECT grp, arg_max(label, n * 10 - label) AS glabel, sum(n)::BIGINT AS size FROM (SELECT grp, label, count(*) AS n FROM v_docs GROUP BY 1, 2) GROUP BY 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY glabel ORDER BY size DESC, md5(concat_ws('|', 20260101, grp)), grp) AS step, sum(size) OVER (PARTITION BY glabel)::DOUBLE AS total FROM m), "
    "f AS (SELECT glabel, 0::BIGINT AS step, NULL::VARCHAR AS grp, NULL::BIGINT AS size, NULL::VARCHAR AS split, 0.65::DOUBLE * max(total) AS a, 0.15::DOUBLE * max(total) AS b, 0.2::DOUBLE * max(total) AS c FROM o GROUP BY 1 "
    "UNION ALL SELECT o.glabel, o.step, o.grp, o.size, CASE WHEN f.a >= f.b AND f.a >= f.c THEN 'train' WHEN f.b >= f.c THEN 'val' ELSE 'test' END, "
    "CASE WHEN f.a >= f.b AND f.a >= f.c THEN f.a - o.size ELSE f.a END, CASE WHEN NOT (f.a >= f.b AND f.a >= f.c) AND f.b >= f.c THEN f.b - o.size ELSE f.b END, CASE WHEN NOT (f.a >= f.b AND f.a >= f.c) AND NOT f.b >= f.c THEN f.c - o.size ELSE f.c END "
    "FROM f JOIN o ON o.glabel = f.glabel AND o.step = f.step + 1) "
)


@query("smp5_group_split", _GREEDY + "SELECT grp, glabel, size, split FROM f WHERE step > 0")
def _(spark, sf):
    return S.stratified_groups(V.v_docs(spark, sf))


@query("smp6_split_quality", _GREEDY + ", r AS (SELECT v_docs.label, f.split FROM v_docs JOIN f USING (grp)) SELECT x.split, count(r.label) AS n, x.requested, round(count(r.label) / (SELECT count(*) FROM r), 9) AS realised, count(DISTINCT r.label) AS classes, count(r.label) / (SELECT count(*) FROM r) >= 0.5 * x.requested AND count(DISTINCT r.label) = (SELECT count(DISTINCT label) FROM r) AS ok FROM (VALUES ('train', 0.65::DOUBLE), ('val', 0.15), ('test', 0.2)) x(split, requested) LEFT JOIN r ON r.split = x.split GROUP BY 1, 3")
def _(spark, sf):
    return S.split_quality(S.with_splits(V.v_docs(spark, sf)))


@query("jn13_disjoint", _GREEDY + "SELECT 'grp' AS key, grp AS value, 2::BIGINT AS n_parts FROM f WHERE FALSE UNION ALL SELECT 'lang', lang, count(DISTINCT split) FROM v_docs JOIN f USING (grp) GROUP BY 2 HAVING count(DISTINCT split) > 1")
def _(spark, sf):
    return C.assert_disjoint(S.with_splits(V.v_docs(spark, sf)), keys=("grp", "lang"))


@query("jn14_leakage_counts", _GREEDY + "SELECT count(DISTINCT source) AS shared FROM v_docs JOIN f USING (grp) WHERE split = 'train' AND source IN (SELECT source FROM v_docs JOIN f USING (grp) WHERE split <> 'train')")
def _(spark, sf):
    p = S.with_splits(V.v_docs(spark, sf))
    return p.where("split = 'train'").select("source").distinct().join(p.where("split <> 'train'").select("source"), "source", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query("smp8_resample", sql("v_docs", body=f"SELECT label, draw, r.ord FROM (SELECT label, draw, CASE WHEN want <= n THEN draw ELSE {D('n', '3', 'label', 'draw')} END AS rn FROM (SELECT label, count(*) AS n, (150 + 100 * label)::BIGINT AS want FROM v_docs GROUP BY 1), range(1000) g(draw) WHERE draw < want) JOIN (SELECT label, ord, {_RN.format(seed=3)} AS rn FROM v_docs) r USING (label, rn)"))
def _(spark, sf):
    d = V.v_docs(spark, sf)
    target = d.select("label").distinct().withColumn("want", (150 + 100 * F.col("label")).cast("long"))
    return X.resampled(d, target, 3)


@query("smp9_tail_control", sql("v_docs", body=f"SELECT label, draw, r.ord FROM (SELECT label, draw, CASE WHEN want <= n THEN draw ELSE {D('n', '9003', 'label', 'draw')} END AS rn FROM (SELECT label, count(*) AS n, 400::BIGINT AS want FROM v_docs WHERE label >= 2 GROUP BY 1), range(400) g(draw)) JOIN (SELECT label, ord, {_RN.format(seed=9003)} AS rn FROM v_docs) r USING (label, rn)"))
def _(spark, sf):
    tail = V.v_docs(spark, sf).where("label >= 2")
    return X.resampled(tail, tail.select("label").distinct().withColumn("want", F.lit(400).cast("long")), 9003)


@query("smp10_matched_draws", sql("v_docs", body="SELECT d AS draw, ord FROM (SELECT d, ord, row_number() OVER (PARTITION BY d, label ORDER BY md5(concat_ws('|', d, ord)), ord) AS rn FROM v_docs, range(5) r(d)) WHERE rn <= 20"))
def _(spark, sf):
    d = V.v_docs(spark, sf).select("ord", "label").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return X.permutation(d, F.col("draw"), ["draw", "label"]).where("rn < 20").select("draw", "ord")


#: A cast rounds in SQL, so the queries do.
_TRIALS = "t AS (SELECT k AS trial, item, patient, lesion, dx, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', k, item)), item) > (0.8::DOUBLE * (SELECT count(*) FROM v_subject))::INT AS held FROM v_subject, range(200) r(k)), l AS (SELECT *, max((NOT held)::INT) OVER (PARTITION BY trial, {g}) = 1 AS leaked FROM t)"


@query("smp11_image_level_leakage", sql("v_subject", body="").rstrip() + ", " + _TRIALS.format(g="lesion") + " SELECT trial, count(*) AS held_out, round(avg(leaked::INT::DOUBLE), 9) AS leaked FROM l WHERE held GROUP BY 1")
@query("jn4_semi_join_flags", sql("v_subject", body="").rstrip() + ", " + _TRIALS.format(g="lesion") + " SELECT trial, count(*) AS held_out, round(avg(leaked::INT::DOUBLE), 9) AS leaked FROM l WHERE held GROUP BY 1")
def _(spark, sf):
    held = S.held_out(V.v_subject(spark, sf), "item", ["lesion"], 200, 0.2, round)
    return S.leakage_counts(held, "lesion", 200).select("trial", F.col("held").alias("held_out"), F.round(F.col("leaked") / F.col("held"), 9).alias("leaked"))


@query("aud5_two_level_leakage", sql("v_subject", body="").rstrip() + ", " + _TRIALS.format(g="lesion") + ", l2 AS (SELECT *, max((NOT held)::INT) OVER (PARTITION BY trial, patient) = 1 AS leaked FROM t) SELECT 'lesion' AS level, round(avg(x), 9) AS leaked FROM (SELECT avg(leaked::INT::DOUBLE) AS x FROM l WHERE held GROUP BY trial) UNION ALL SELECT 'patient', round(avg(x), 9) FROM (SELECT avg(leaked::INT::DOUBLE) AS x FROM l2 WHERE held GROUP BY trial)")
def _(spark, sf):
    held = S.held_out(V.v_subject(spark, sf), "item", ["lesion", "patient"], 200, 0.2, round)

    def level(name):
        x = S.leakage_counts(held, name, 200).select((F.col("leaked") / F.col("held")).alias("x"))
        return x.agg(F.round(F.avg("x"), 9).alias("leaked")).select(F.lit(name).alias("level"), "leaked")

    return level("lesion").unionByName(level("patient"))


@query("aud7_leakage_by_class", sql("v_subject", body="").rstrip() + ", " + _TRIALS.format(g="lesion") + " SELECT dx, round(avg(x), 9) AS leaked, count(*) AS trials FROM (SELECT trial, dx, avg(leaked::INT::DOUBLE) AS x FROM l WHERE held GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    held = S.held_out(V.v_subject(spark, sf), "item", ["lesion", "dx"], 200, 0.2, round)
    x = S.leakage_counts(held, "lesion", 200, ["dx"]).withColumn("x", F.col("leaked") / F.col("held"))
    return x.groupBy("dx").agg(F.round(F.avg("x"), 9).alias("leaked"), F.count(F.lit(1)).alias("trials"))


@query("aud14_expected_leakage", sql("v_subject", body="SELECT round(sum(s * (1 - 0.2::DOUBLE ** (s - 1))) / sum(s), 9) AS expected FROM (SELECT lesion, count(*) AS s FROM v_subject GROUP BY 1)"))
def _(spark, sf):
    return V.v_subject(spark, sf).groupBy("lesion").agg(F.count(F.lit(1)).alias("s")).agg(F.round(S.expected_leakage(None, 0.8), 9).alias("expected"))


@query("smp12_probe_holdout", sql("v_corpus", body="SELECT ord, rn <= greatest(1, floor(0.25::DOUBLE * n)) AS held FROM (SELECT ord, row_number() OVER w AS rn, count(*) OVER (PARTITION BY label) AS n FROM v_corpus WINDOW w AS (PARTITION BY label ORDER BY md5(concat_ws('|', 4, ord)), ord))"))
def _(spark, sf):
    n = F.count(F.lit(1)).over(W.partitionBy("label"))
    return X.permutation(V.v_corpus(spark, sf), 4, ["label"]).select("ord", (F.col("rn") < F.greatest(F.lit(1), F.floor(0.25 * n))).alias("held"))


@query("smp13_target_counts", sql("v_docs", body="SELECT label, quota FROM (SELECT *, (fl + (row_number() OVER (ORDER BY frac DESC, label) <= 250 - sum(fl) OVER ())::INT)::BIGINT AS quota FROM (SELECT *, floor(x) AS fl, round(x - floor(x), 9) AS frac FROM (SELECT label, 250 * count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM v_docs GROUP BY 1)))"))
def _(spark, sf):
    return X.largest_remainder(V.v_docs(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")), [], F.lit(250)).select("label", "quota")


@query("smp14_stratified_folds", sql("v_docs", body=f"SELECT ord, (({_RN.format(seed=0)}) % 5)::INT AS fold FROM v_docs"))
def _(spark, sf):
    return X.permutation(V.v_docs(spark, sf), 0, ["label"]).select("ord", F.pmod(F.col("rn"), F.lit(5)).alias("fold"))


@query("smp16_random_sample", sql("v_docs", body="SELECT ord FROM v_docs ORDER BY md5(concat_ws('|', 12, ord)), ord LIMIT 100"))
def _(spark, sf):
    return V.v_docs(spark, sf).select("ord").orderBy(order_key(12, F.col("ord")), "ord").limit(100)


@query("gen1_prompt_stream", "SELECT i, seed, choice FROM (SELECT i, 5 * 1000003 + i AS seed, " + D(6, "5", "i", "'tone'") + " AS choice FROM range(200) r(i))")
def _(spark, sf):
    return P.prompt_stream(spark, "diverse", 5, 200).select("i", "seed", F.col("tone").alias("choice"))


@query("gen2_grid_size", "SELECT (3 * 2 * 6 * 3 * 4 * 3 * 4)::BIGINT AS n")
def _(spark, sf):
    return P.grid(spark).agg(F.count(F.lit(1)).alias("n"))


@query("gen3_coverage_prompts", "SELECT grade, i, (i % 6) AS tone, (i * 5 + grade) % 8 AS scene, row_number() OVER (ORDER BY i, grade)::INT AS place FROM range(4) g(grade), range(40) r(i)")
def _(spark, sf):
    return P.coverage_prompts(spark, 40)


@query("gen4_balanced_design", "SELECT grade, tone, i, (i + 7 * grade + 3 * tone) % 24 AS substrate FROM range(4) g(grade), range(6) t(tone), range(24) r(i)")
def _(spark, sf):
    return P.balanced_design(spark, 24)


@query("src18_toy_sizes", "SELECT label::INT AS label, (fl + (row_number() OVER (ORDER BY frac DESC, label) <= 123 - sum(fl) OVER ())::INT)::BIGINT AS quota FROM (SELECT label, floor(123 * w) AS fl, round(123 * w - floor(123 * w), 9) AS frac FROM (VALUES (0, 0.40::DOUBLE), (1, 0.33), (2, 0.19), (3, 0.08)) d(label, w))")
def _(spark, sf):
    return P.toy_sizes(spark, 123)


@query("src19_toy_latents", "SELECT label, i, round(lo + (hi - lo) * u, 6) AS lesions FROM (SELECT label::INT AS label, i, lo, hi, concat('0x', substr(md5(concat_ws('|', 3, label, i)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (VALUES (0, 0, 5), (1, 6, 20), (2, 21, 50), (3, 51, 80)) d(label, lo, hi), range(30) r(i))")
def _(spark, sf):
    return P.toy_latents(spark, 30, seed=3).select("label", "i", F.round("lesions", 6).alias("lesions"))


@query("fn19_prompt_template", "SELECT i, concat('a ', ['mild', 'moderate', 'severe'][(i % 3 + 1)::INT], ' case, ', ['fair', 'dark'][(i % 2 + 1)::INT], ' skin') AS prompt FROM range(50) r(i)")
def _(spark, sf):
    r = spark.range(50).withColumnRenamed("id", "i").withColumn("grade", F.col("i") % 3).withColumn("tone", F.col("i") % 2)
    return P.filled(r, "a {grade} case, {tone} skin", {"grade": ["mild", "moderate", "severe"], "tone": ["fair", "dark"]}).select("i", "prompt")

"""Metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import tails
from corpuslab.functions.draws import draw
from corpuslab.operators import metrics as M
from corpuslab.operators import statistics as T
from corpuslab.queries import views as V
from corpuslab.queries.views import D, SQL, sql
from corpuslab.registry import query

_DIM = "(VALUES (0), (1), (2), (3))"
_CELLS = f"g AS (SELECT DISTINCT seed FROM v_pred), cells AS (SELECT g.seed, a.t::INT AS y_true, b.p::INT AS y_pred, coalesce(n, 0)::BIGINT AS n FROM g, {_DIM} a(t), {_DIM} b(p) LEFT JOIN (SELECT seed, y_true, y_pred, count(*) AS n FROM v_pred GROUP BY 1, 2, 3) x ON x.seed = g.seed AND x.y_true = a.t AND x.y_pred = b.p)"
_SCORES = _CELLS + ", s AS (SELECT a.seed, cls, support, tp / nullif(support, 0) AS recall, 2 * tp / nullif(support + predicted, 0) AS f1 FROM (SELECT seed, y_true AS cls, sum(n)::BIGINT AS support, sum(n) FILTER (y_true = y_pred) AS tp FROM cells GROUP BY 1, 2) a JOIN (SELECT seed, y_pred AS cls, sum(n) AS predicted FROM cells GROUP BY 1, 2) b USING (seed, cls))"
_KAPPA = "k AS (SELECT seed, 1 - o / e AS qwk FROM (SELECT seed, sum((y_true - y_pred) ** 2 * n) / sum(n) AS o FROM cells GROUP BY 1) JOIN (SELECT a.seed, sum((a.c - b.c) ** 2 * a.n * b.n) / (sum(a.n) * 1.0 / count(DISTINCT b.c) * sum(b.n) / count(DISTINCT a.c)) AS e FROM (SELECT seed, y_true AS c, sum(n)::DOUBLE AS n FROM cells GROUP BY 1, 2) a JOIN (SELECT seed, y_pred AS c, sum(n)::DOUBLE AS n FROM cells GROUP BY 1, 2) b USING (seed) GROUP BY 1) USING (seed))"


def _with(tail: str, body: str) -> str:
    return sql("v_pred", body="").rstrip() + ", " + tail + " " + body


def pred(spark, sf):
    return V.v_pred(spark, sf)


@query("met1_confusion", _with(_CELLS, "SELECT * FROM cells"))
def _(spark, sf):
    return M.confusion(pred(spark, sf), ["seed"])


@query("met2_recall", _with(_SCORES, "SELECT seed, cls, support, round(recall, 9) AS recall FROM s"))
def _(spark, sf):
    return M.class_scores(M.confusion(pred(spark, sf), ["seed"]), ["seed"]).select("seed", "cls", "support", F.round("recall", 9).alias("recall"))


@query("met3_balanced_accuracy", _with(_SCORES, "SELECT seed, round(avg(recall), 9) AS ba FROM s GROUP BY 1"))
def _(spark, sf):
    return M.evaluate(pred(spark, sf), ["seed"]).select("seed", F.round("balanced_accuracy", 9).alias("ba"))


@query("met4_accuracy_mae", sql("v_pred", body="SELECT seed, round(avg((y_true = y_pred)::INT::DOUBLE), 9) AS accuracy, round(avg(abs(y_true - y_pred)), 9) AS mae FROM v_pred GROUP BY 1"))
def _(spark, sf):
    return M.evaluate(pred(spark, sf), ["seed"]).select("seed", F.round("accuracy", 9).alias("accuracy"), F.round("mae", 9).alias("mae"))


@query("met5_macro_f1", _with(_SCORES, "SELECT seed, round(avg(f1), 9) AS f1 FROM s GROUP BY 1"))
def _(spark, sf):
    return M.evaluate(pred(spark, sf), ["seed"]).select("seed", F.round("macro_f1", 9).alias("f1"))


@query("met6_qwk", _with(_CELLS + ", " + _KAPPA, "SELECT seed, round(qwk, 9) AS qwk FROM k"))
@query("met6b_qwk_rescaled", _with(_CELLS + ", " + _KAPPA, "SELECT seed, round(qwk, 9) AS qwk FROM k"))
def _(spark, sf):
    return M.qwk(M.confusion(pred(spark, sf), ["seed"]), ["seed"]).select("seed", F.round("qwk", 9).alias("qwk"))


_CONF = f"(25 + {D(76, 'event_id', chr(39) + 'conf' + chr(39))}) / 100.0::DOUBLE"


@query("met7_calibration_error", sql("v_pred", body=f"SELECT seed, round(sum(n * abs(a - c)) / sum(n), 9) AS ece FROM (SELECT seed, lo, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM (SELECT seed, {_CONF} AS conf, (y_true = y_pred)::INT::DOUBLE AS ok FROM v_pred) JOIN (SELECT i / 15::DOUBLE AS lo, (i + 1) / 15::DOUBLE AS hi FROM range(15) r(i)) ON conf > lo AND conf <= hi GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    conf = (25 + draw(76, F.col("event_id"), "conf")) / F.lit(100.0)
    p = pred(spark, sf).withColumn("conf", conf).withColumn("ok", F.col("y_true") == F.col("y_pred"))
    return M.calibration_error(p, "conf", "ok", ["seed"]).select("seed", F.round("ece", 9).alias("ece"))


@query("met8_evaluate", _with(_SCORES + ", " + _KAPPA, "SELECT seed, n, round(acc, 9) AS accuracy, round(mae, 9) AS mae, round(ba, 9) AS balanced_accuracy, round(f1, 9) AS macro_f1, round(tail, 9) AS tail_recall, round(qwk, 9) AS qwk FROM (SELECT seed, sum(n)::BIGINT AS n, sum(n) FILTER (y_true = y_pred) / sum(n) AS acc, sum(n * abs(y_true - y_pred)) / sum(n) AS mae FROM cells GROUP BY 1) JOIN (SELECT seed, avg(recall) AS ba, avg(f1) AS f1, avg(recall) FILTER (cls >= 2) AS tail FROM s GROUP BY 1) USING (seed) JOIN k USING (seed)"))
def _(spark, sf):
    e = M.evaluate(pred(spark, sf), ["seed"])
    return e.select("seed", "n", *[F.round(c, 9).alias(c) for c in e.columns if c not in ("seed", "n")])


@query("met9_auc", sql("v_docs", body="SELECT lang, round((sum(r) FILTER (label = 0) - count(*) FILTER (label = 0) * (count(*) FILTER (label = 0) + 1) / 2.0) / nullif(count(*) FILTER (label = 0) * count(*) FILTER (label <> 0), 0), 9) AS auc FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM v_docs) GROUP BY 1"))
def _(spark, sf):
    return M.auc(V.v_docs(spark, sf), ["lang"], "n_chars", F.col("label") == 0).select("lang", F.round("auc", 9).alias("auc"))


@query("met10_spearman_ordinal", sql("v_docs", body="SELECT lang, round(corr(x, y), 9) AS rho FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, ord) AS x, row_number() OVER (PARTITION BY lang ORDER BY label, ord) AS y FROM v_docs) GROUP BY 1"))
def _(spark, sf):
    return M.spearman(V.v_docs(spark, sf), ["lang"], "n_chars", "label", "ord").select("lang", F.round("rho", 9).alias("rho"))


@query("met11_spearman_average", sql("v_docs", body="SELECT lang, round(corr(x, y), 9) AS rho FROM (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY lang ORDER BY label) + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0::DOUBLE AS y FROM v_docs) GROUP BY 1"))
def _(spark, sf):
    return M.spearman(V.v_docs(spark, sf), ["lang"], "n_chars", "label").select("lang", F.round("rho", 9).alias("rho"))


@query("met12_pearson", sql("v_docs", body="SELECT lang, round(corr(n_chars, label), 9) AS r FROM v_docs GROUP BY 1"))
def _(spark, sf):
    return V.v_docs(spark, sf).groupBy("lang").agg(F.round(M.pearson("n_chars", "label"), 9).alias("r"))


@query("met13_fidelity", sql("v_pred", body="SELECT y_true, count(*) AS n, round(avg((y_true = y_pred)::INT::DOUBLE), 9) AS exact, round(avg((abs(y_true - y_pred) <= 1)::INT::DOUBLE), 9) AS within_one, round(avg(y_pred), 9) AS mean_pred FROM v_pred GROUP BY 1"))
def _(spark, sf):
    d = F.abs(F.col("y_true") - F.col("y_pred"))
    return pred(spark, sf).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((d == 0).cast("double")), 9).alias("exact"), F.round(F.avg((d <= 1).cast("double")), 9).alias("within_one"), F.round(F.avg("y_pred"), 9).alias("mean_pred"))


@query("met14_counter_validation", sql("v_counts", body="SELECT round(corr(c1, c2), 9) AS pearson, quantile_cont(c1, 0.5) AS median1, quantile_cont(c2, 0.5) AS median2, round(avg(c2) / avg(c1), 9) AS ratio FROM v_counts"))
def _(spark, sf):
    return V.v_counts(spark, sf).agg(F.round(M.pearson("c1", "c2"), 9).alias("pearson"), F.percentile("c1", 0.5).alias("median1"), F.percentile("c2", 0.5).alias("median2"), F.round(F.avg("c2") / F.avg("c1"), 9).alias("ratio"))


_TCRIT = "tc(df, tcrit) AS (VALUES " + ", ".join(f"({d}, {v!r}::DOUBLE)" for d, v in tails.t_table(40)) + ")"
_CI = "SELECT generator, init, frac, n, round(m, 9) AS point, round(m - sd / sqrt(n) * tcrit, 9) AS lo, round(m + sd / sqrt(n) * tcrit, 9) AS hi FROM (SELECT generator, init, frac, count(*) AS n, avg(ba) AS m, stddev_samp(ba) AS sd FROM v_runs GROUP BY ALL) LEFT JOIN tc ON df = n - 1"


@query("sta1_mean_ci", sql("v_pred", "v_runs", body="").rstrip() + ", " + _TCRIT + " " + _CI)
def _(spark, sf):
    ci = T.mean_ci(V.v_runs(spark, sf), ["generator", "init", "frac"], "ba")
    return ci.select("generator", "init", "frac", "n", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


def _accuracy(cells, by):
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(F.try_divide(hit, F.sum("n")).alias("value"))


#: Each draw takes n places, so its n-th place stands beside the n-th row.
_ALL = "q AS (SELECT ord, y_true, y_pred, (CASE WHEN ord % 3 = 0 THEN y_true ELSE y_pred END)::INT AS y_b, row_number() OVER (ORDER BY ord) - 1 AS i FROM v_pred), s AS (SELECT count(*) AS n FROM q), b AS (SELECT draw, q.* FROM range(200) d(draw), q r, s JOIN q ON q.i = " + D("s.n", "{seed}", "draw", "r.i") + ")"


@query("sta2_bootstrap_metric", _with(_ALL.format(seed=3), ", v AS (SELECT avg((y_true = y_pred)::INT::DOUBLE) AS x FROM b GROUP BY draw) SELECT round((SELECT avg((y_true = y_pred)::INT::DOUBLE) FROM q), 6) AS point, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM v"))
def _(spark, sf):
    return T.bootstrap_metric(pred(spark, sf), _accuracy, 200, 3).select(*[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


@query("sta3_paired_bootstrap", _with(_ALL.format(seed=4), ", v AS (SELECT avg((y_true = y_b)::INT::DOUBLE) - avg((y_true = y_pred)::INT::DOUBLE) AS x FROM b GROUP BY draw) SELECT round((SELECT avg((y_true = y_b)::INT::DOUBLE) - avg((y_true = y_pred)::INT::DOUBLE) FROM q), 6) AS point, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(least(1.0::DOUBLE, 2 * least(avg((x <= 0)::INT::DOUBLE), avg((x >= 0)::INT::DOUBLE))), 6) AS p FROM v"))
def _(spark, sf):
    p = pred(spark, sf).select("ord", "y_true", F.col("y_pred").alias("y_pred_a"), F.when(F.col("ord") % 3 == 0, F.col("y_true")).otherwise(F.col("y_pred")).alias("y_pred_b"))
    return T.paired_bootstrap(p, _accuracy, 200, 4).select(*[F.round(c, 6).alias(c) for c in ("point", "lo", "hi", "p")])


@query("sta4_bootstrap_mean", _with(_ALL.format(seed=5), ", v AS (SELECT avg(y_pred) AS x FROM b GROUP BY draw) SELECT round((SELECT avg(y_pred) FROM q), 4) AS point, round(quantile_cont(x, 0.025), 4) AS lo, round(quantile_cont(x, 0.975), 4) AS hi FROM v"))
def _(spark, sf):
    return T.bootstrap_mean(pred(spark, sf), "y_pred", "ord", 200, 5).select(*[F.round(c, 4).alias(c) for c in ("point", "lo", "hi")])


_TESTS = "t AS (SELECT source AS name, (concat('0x', substr(md5(concat_ws('|', source)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) ** 6 AS p FROM (SELECT DISTINCT source FROM documents))"
_HOLM = f"WITH {_TESTS} SELECT name, round(least(1.0::DOUBLE, p * (m - r)), 9) AS adjusted_p, bool_and(p <= 0.05::DOUBLE / (m - r)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS reject FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) - 1 AS r FROM t)"


@query("sta5_holm", _HOLM)
@query("win11_step_down", _HOLM)
def _(spark, sf):
    from corpuslab.functions.draws import uniform

    t = V.table(spark, sf, "documents").select(F.col("source").alias("name")).distinct().withColumn("p", F.pow(uniform(F.col("name")), F.lit(6.0)))
    return T.holm(t).select("name", F.round("adjusted_p", 9).alias("adjusted_p"), "reject")


@query("sta12_chi2", sql("v_docs", body="SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, ((count(DISTINCT lang) - 1) * (count(DISTINCT label) - 1))::BIGINT AS df FROM (SELECT a.lang, b.label, coalesce(n, 0) AS n, a.r * b.c / t::DOUBLE AS e FROM (SELECT lang, count(*) AS r FROM v_docs GROUP BY 1) a, (SELECT label, count(*) AS c FROM v_docs GROUP BY 1) b, (SELECT count(*) AS t FROM v_docs) LEFT JOIN (SELECT lang, label, count(*) AS n FROM v_docs GROUP BY 1, 2) x ON x.lang = a.lang AND x.label = b.label)"))
def _(spark, sf):
    cells = V.v_docs(spark, sf).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))
    return T.chi2_independence(cells, "lang", "label").select(F.round("chi2", 6).alias("chi2"), F.col("df").cast("long").alias("df"))


@query("sta13_paired_t", sql("v_pred", "v_runs", body="").rstrip() + ", " + _TCRIT + " SELECT init, n, round(m, 9) AS mean, round(sd, 9) AS sd, round(m / (sd / sqrt(n)), 6) AS t, round(m - sd / sqrt(n) * tcrit, 9) AS lo, round(m + sd / sqrt(n) * tcrit, 9) AS hi, positive FROM (SELECT init, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (d > 0) AS positive FROM (SELECT a.init, a.seed, a.ba - b.ba AS d FROM v_runs a JOIN v_runs b ON a.init = b.init AND a.seed = b.seed AND a.generator = b.generator AND a.frac = 0.25 AND b.frac = 0.75) GROUP BY 1) LEFT JOIN tc ON df = n - 1")
def _(spark, sf):
    r = V.v_runs(spark, sf)
    a, b = r.where("frac = 0.25").withColumnRenamed("ba", "x").drop("frac"), r.where("frac = 0.75").withColumnRenamed("ba", "y").drop("frac")
    d = a.join(b, ["generator", "init", "seed"]).withColumn("d", F.col("x") - F.col("y"))
    out = T.paired_t(d, ["init"], "d")
    return out.select("init", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "lo", "hi")], F.round("t", 6).alias("t"), "positive")


@query("sta14_anova", sql("v_docs", body="SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, k - 1 AS df1, (n - k)::BIGINT AS df2 FROM (SELECT sum(c * (m - g) ** 2) AS ssb, sum(c * v) AS ssw, count(*) AS k, sum(c) AS n FROM (SELECT lang, count(*) AS c, avg(n_chars) AS m, var_pop(n_chars) AS v FROM v_docs GROUP BY 1), (SELECT avg(n_chars) AS g FROM v_docs))"))
def _(spark, sf):
    return T.anova_f(V.v_docs(spark, sf), "lang", "n_chars").select(F.round("f", 6).alias("f"), "df1", "df2")


@query("sta15_percentiles", sql("v_docs", body="SELECT lang, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM v_docs GROUP BY 1"))
def _(spark, sf):
    q = lambda p: F.round(F.percentile("n_chars", p), 9)
    return V.v_docs(spark, sf).groupBy("lang").agg(q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


@query("sta16_variance_ratio", sql("v_pixels", body="SELECT round(avg(((r - m) ** 2 + (g - m) ** 2 + (b - m) ** 2) / 2) / var_samp(m), 9) AS ratio FROM (SELECT *, (r + g + b) / 3 AS m FROM v_pixels)"))
def _(spark, sf):
    return T.variance_ratio(V.v_pixels(spark, sf), ["r", "g", "b"]).select(F.round("ratio", 9).alias("ratio"))


@query("sta17_learning_curve", sql("v_docs", body="SELECT lang, round(regr_slope(label, log2(n_chars)), 9) AS slope FROM v_docs WHERE n_chars > 0 GROUP BY 1"))
def _(spark, sf):
    return T.learning_curve(V.v_docs(spark, sf).where("n_chars > 0"), ["lang"], "n_chars", "label").select("lang", F.round("slope", 9).alias("slope"))

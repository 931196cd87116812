"""Run records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators import corpus as C
from corpuslab.operators import runs as R
from corpuslab.operators import statistics as T
from corpuslab.plans.scratch import cut
from corpuslab.queries import views as V
from corpuslab.queries.evaluation import _TCRIT
from corpuslab.queries.views import sql
from corpuslab.registry import query

_R = sql("v_pred", "v_runs", body="").rstrip()
_X = _R + ", x AS (SELECT generator, init, frac, seed, ba FROM v_runs WHERE generator <> 'none' UNION ALL SELECT g.generator, init, frac, seed, ba FROM v_runs, (SELECT DISTINCT generator FROM v_runs WHERE generator <> 'none') g WHERE v_runs.generator = 'none')"


@query("jn10_shared_arms", _X + " SELECT generator, init, frac, seed, round(ba, 9) AS ba FROM x")
@query("set5_generator_blocks", _X + " SELECT generator, init, frac, seed, round(ba, 9) AS ba FROM x")
def _(spark, sf):
    return R.expand_shared(V.v_runs(spark, sf)).select("generator", "init", "frac", "seed", F.round("ba", 9).alias("ba"))


@query("jn11_dense_grid", _X + " SELECT g.generator, g.init, g.seed, f.frac, round(x.ba, 9) AS ba FROM (SELECT DISTINCT generator, init, seed FROM x WHERE frac < 0.9 OR seed > 1) g JOIN (SELECT DISTINCT generator, init, frac FROM x WHERE frac < 0.9 OR seed > 1) f USING (generator, init) LEFT JOIN (SELECT * FROM x WHERE frac < 0.9 OR seed > 1) x ON x.generator = g.generator AND x.init = g.init AND x.seed = g.seed AND x.frac = f.frac")
def _(spark, sf):
    g = R.on_grid(R.expand_shared(V.v_runs(spark, sf)).where("frac < 0.9 OR seed > 1"), ["generator", "init"], "frac", "ba")
    return g.select("generator", "init", "seed", "frac", F.round("ba", 9).alias("ba"))


@query("jn12_matched_seeds", _R + ", a AS (SELECT seed, avg(ba) AS a FROM v_runs WHERE init = 'scratch' AND seed <> 1 GROUP BY 1), b AS (SELECT seed, avg(ba) AS b FROM v_runs WHERE init = 'imagenet' AND seed <> 3 GROUP BY 1) SELECT coalesce(a.seed, b.seed) AS seed, round(a, 9) AS a, round(b, 9) AS b, CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' ELSE 'both' END AS kind FROM a FULL JOIN b ON a.seed = b.seed")
def _(spark, sf):
    r = V.v_runs(spark, sf)
    m = R.matched_seeds(r.where("init = 'scratch' AND seed <> 1"), r.where("init = 'imagenet' AND seed <> 3"), "ba")
    return m.select("seed", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), "kind")


_CURVE = _X + ", " + _TCRIT + " SELECT generator, init, frac, s AS n_seeds, n, round(m, 9) AS point, round(m - sd / sqrt(n) * tcrit, 9) AS lo, round(m + sd / sqrt(n) * tcrit, 9) AS hi FROM (SELECT generator, init, frac, count(DISTINCT seed) AS s, count(*) AS n, avg(ba) AS m, stddev_samp(ba) AS sd FROM x GROUP BY 1, 2, 3) LEFT JOIN tc ON df = n - 1"


@query("agg5_arm_summary", _CURVE)
@query("sta10_substitution_curve", _CURVE)
def _(spark, sf):
    s = R.summarise(R.expand_shared(V.v_runs(spark, sf)), ["generator", "init", "frac"], "ba")
    return s.select("generator", "init", "frac", "n_seeds", "n", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


_TREND = _X + ", " + _TCRIT + ", s AS (SELECT generator, init, seed, regr_slope(ba, frac) AS slope FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT generator, init, n, round(m, 9) AS slope, round(m - sd / sqrt(n) * tcrit, 9) AS lo, round(m + sd / sqrt(n) * tcrit, 9) AS hi, round(m / (sd / sqrt(n)), 6) AS t FROM (SELECT generator, init, count(*) AS n, avg(slope) AS m, stddev_samp(slope) AS sd FROM s GROUP BY 1, 2) LEFT JOIN tc ON df = n - 1"


@query("sta6_trend", _TREND)
@query("sta7_substitution_trend", _TREND)
def _(spark, sf):
    t = R.substitution_trend(V.v_runs(spark, sf), "ba")
    return t.select("generator", "init", "n", *[F.round(c, 9).alias(c) for c in ("slope", "lo", "hi")], F.round("t", 6).alias("t"))


#: A design of budgets and multipliers over the same predictions.
_B = sql("v_pred", body="").rstrip() + ", r AS (SELECT generator, init, seed, budget, k, avg(ok) + 0.05::DOUBLE * budget + 0.02::DOUBLE * k AS ba FROM (SELECT generator, init, seed, (1 + event_id % 4) / 4.0::DOUBLE AS budget, ((event_id // 20) % 4)::DOUBLE AS k, (y_true = y_pred)::INT::DOUBLE AS ok FROM v_pred) GROUP BY generator, init, seed, budget, k), m AS (SELECT generator, init, budget, k, avg(ba) AS y FROM r GROUP BY ALL), b AS (SELECT generator, init, budget, lead(y) OVER w AS target, lead(budget) OVER w AS target_budget FROM m WHERE k = 0 WINDOW w AS (PARTITION BY generator, init ORDER BY budget))"


def budget_runs(spark, sf):
    budget = (F.col("event_id") % 4 + 1) / F.lit(4.0)
    k = F.expr("(event_id div 20) % 4").cast("double")
    p = V.v_pred(spark, sf).withColumn("budget", budget).withColumn("k", k)
    g = p.groupBy("generator", "init", "seed", "budget", "k").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"))
    return g.withColumn("ba", F.col("a") + 0.05 * F.col("budget") + 0.02 * F.col("k"))


@query("agg6_budget_means", _B + " SELECT generator, init, budget, k, round(y, 9) AS y FROM m")
def _(spark, sf):
    return budget_runs(spark, sf).groupBy("generator", "init", "budget", "k").agg(F.round(F.avg("ba"), 9).alias("y"))


@query("win12_next_budget", _B + " SELECT generator, init, budget, target_budget, round(target, 9) AS target FROM b")
def _(spark, sf):
    base = budget_runs(spark, sf).where("k = 0").groupBy("generator", "init", "budget").agg(F.avg("ba").alias("y"))
    w = W.partitionBy("generator", "init").orderBy("budget")
    return base.select("generator", "init", "budget", F.lead("budget").over(w).alias("target_budget"), F.round(F.lead("y").over(w), 9).alias("target"))


_EX = _B + ", c AS (SELECT m.*, target, target_budget, lag(m.k) OVER w AS k0, lag(y) OVER w AS y0 FROM m JOIN b USING (generator, init, budget) WHERE target IS NOT NULL WINDOW w AS (PARTITION BY generator, init, budget ORDER BY m.k)), h AS (SELECT generator, init, budget, arg_min(CASE WHEN k0 IS NULL THEN k WHEN y > y0 THEN k0 + (target - y0) / (y - y0) * (k - k0) ELSE k END, k) AS k FROM c WHERE y >= target GROUP BY 1, 2, 3) SELECT b.generator, b.init, b.budget, b.target_budget, round(b.target, 9) AS target, round(coalesce(h.k, 'Infinity'::DOUBLE), 9) AS k, h.k IS NOT NULL AS reached FROM b LEFT JOIN h USING (generator, init, budget) WHERE b.target IS NOT NULL"


@query("sta8_exchange_rate", _EX)
@query("sta9_exchange_table", _EX)
@query("win13_first_crossing", _EX)
def _(spark, sf):
    x = R.exchange_rates(budget_runs(spark, sf), "ba")
    return x.select("generator", "init", "budget", "target_budget", F.round("target", 9).alias("target"), F.round("k", 9).alias("k"), "reached")


@query("snk9_plot_points", _R + " SELECT generator, frac, round(avg(ba), 9) AS mean, round(stddev_samp(ba) / sqrt(greatest(count(*), 1)), 9) AS sem FROM v_runs GROUP BY 1, 2")
def _(spark, sf):
    return R.plot_points(V.v_runs(spark, sf), ["generator", "frac"], "ba").select("generator", "frac", F.round("mean", 9).alias("mean"), F.round("sem", 9).alias("sem"))


@query("src9_flatten_runs", "SELECT concat('run_', user_id) AS run_id, round(avg(value), 9) AS balanced_accuracy, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'val' END AS split FROM events GROUP BY user_id")
def _(spark, sf):
    e = V.table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    block = F.struct(F.col("v").alias("balanced_accuracy"))
    even = F.col("user_id") % 2 == 0
    js = F.to_json(F.struct(F.concat(F.lit("run_"), F.col("user_id")).alias("run_id"), F.when(even, block).alias("test"), F.when(~even, block).alias("val")))
    # Every record is there twice, under two paths; the first counts.
    text = cut(e.select(js.alias("js")), "run_records").select("js", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"))
    twice = text.select(F.from_json("js", R.RUN).alias("r"), "path").select("r.*", "path")
    return R.flatten(twice).select("run_id", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "split")


@query("src10_seed_from_name", "SELECT seed, round(arg_max(v, path), 9) AS v FROM (SELECT regexp_extract(path, '_s(\\d+)_', 1)::INT AS seed, path, v FROM (SELECT concat('arm_s', user_id % 7, '_', lpad(user_id::VARCHAR, 5, '0')) AS path, avg(value) AS v FROM events GROUP BY user_id)) GROUP BY 1")
def _(spark, sf):
    e = V.table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    named = e.withColumn("path", F.concat(F.lit("arm_s"), F.col("user_id") % 7, F.lit("_"), F.lpad(F.col("user_id").cast("string"), 5, "0")))
    return named.groupBy(F.regexp_extract("path", r"_s(\d+)_", 1).cast("int").alias("seed")).agg(F.round(F.max_by("v", "path"), 9).alias("v"))


@query("aud9_regimes", _R + ", d AS (SELECT a.seed, a.v - b.v AS d FROM (SELECT seed, avg(ba) AS v FROM v_runs WHERE init = 'scratch' GROUP BY 1) a JOIN (SELECT seed, avg(ba) AS v FROM v_runs WHERE init = 'imagenet' GROUP BY 1) b USING (seed)) SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d), 9) AS sd FROM d")
def _(spark, sf):
    r = V.v_runs(spark, sf)
    m = R.matched_seeds(r.where("init = 'scratch'"), r.where("init = 'imagenet'"), "ba").where("kind = 'both'").withColumn("d", F.col("a") - F.col("b"))
    return T.paired_t(m, [], "d").select("n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query("orc2_pending_runs", "SELECT DISTINCT user_id % 50 AS run_id FROM events WHERE user_id % 50 NOT IN (SELECT user_id % 50 FROM events WHERE event_type = 'error' AND user_id < 40)")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    runs = e.select((F.col("user_id") % 50).alias("run_id")).distinct()
    return R.pending(runs, e.where("event_type = 'error' AND user_id < 40").select((F.col("user_id") % 50).alias("run_id")))


@query("orc4_smoke_verdict", "WITH z AS (" + _TREND + ") SELECT g AS gap, generator, init, coalesce(CASE WHEN g > 0 THEN slope < 0 ELSE lo <= 0 AND hi >= 0 END, false) AS passed, CASE WHEN NOT coalesce(CASE WHEN g > 0 THEN slope < 0 ELSE lo <= 0 AND hi >= 0 END, false) THEN concat('expected ', CASE WHEN g > 0 THEN 'a negative slope' ELSE 'an interval that holds zero' END) END AS reason FROM z, (VALUES (0.0::DOUBLE), (0.6)) v(g)")
def _(spark, sf):
    t = cut(R.substitution_trend(V.v_runs(spark, sf), "ba"), "trend")
    each = lambda g: R.smoke_verdict(t, g).select(F.lit(g).alias("gap"), "generator", "init", "passed", "reason")
    return each(0.0).unionByName(each(0.6))

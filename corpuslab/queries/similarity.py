"""Similarity joins, components, calibration, memorisation, diversity."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions.draws import order_key
from corpuslab.operators import corpus as C
from corpuslab.operators import grouping as G
from corpuslab.operators import similarity as M
from corpuslab.queries import views as V
from corpuslab.queries.views import SQL
from corpuslab.registry import query

#: The operating point of the driver's vectors: most similar pairs that don't chain into one component.
T = 0.40

_N = f"c AS ({SQL['v_corpus']}), u AS (SELECT ord, path, label, source, grp, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v FROM c)"
_PAIRS = _N + ", p AS (SELECT x.ord AS a, y.ord AS b, list_dot_product(x.v, y.v) AS sim FROM u x JOIN u y ON x.ord < y.ord)"


def _cc(edges: str, nodes: str = "u") -> str:
    """A recursive closure over both directions, and each node's least member."""
    return f"e AS ({edges}), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT ord AS v, ord AS g FROM {nodes} UNION SELECT d.b, r.g FROM r JOIN d ON d.a = r.v), cc AS (SELECT v AS ord, min(g) AS root FROM r GROUP BY 1)"


def _rec(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + body


def vectors(spark, sf):
    return V.v_corpus(spark, sf)


_REPORT = "SELECT sum(s)::BIGINT AS n_items, count(*) AS n_groups, count(*) FILTER (s > 1) AS n_multi, sum(CASE WHEN s > 1 THEN s ELSE 0 END)::BIGINT AS items_in_multi, max(s) AS largest, round(max(s) / sum(s), 9) AS largest_share, max(s) / sum(s) > 0.05 AS over_clustered FROM (SELECT root, count(*) AS s FROM cc GROUP BY 1)"


@query("flagship_cluster_report", _rec(_PAIRS, _cc(f"SELECT a, b FROM p WHERE sim >= {T}"), body="SELECT s AS size, count(*) AS clusters, (s * count(*))::BIGINT AS items FROM (SELECT root, count(*) AS s FROM cc GROUP BY 1) GROUP BY 1"))
def _(spark, sf):
    v = vectors(spark, sf)
    sizes = G.with_components(v, M.cosine_pairs(v, T)).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters")).withColumn("items", F.col("size") * F.col("clusters"))


@query("jn6_cosine_pairs", f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= {T}")
def _(spark, sf):
    return M.cosine_pairs(vectors(spark, sf), T).select("a", "b", F.round("sim", 6).alias("sim"))


_HASH = "h AS (SELECT doc_id AS ord, (concat('0x', substr(md5(text), 1, 8))::BIGINT & 268435455) AS h FROM documents)"


@query("jn7_hamming_pairs", f"WITH {_HASH} SELECT x.ord AS a, y.ord AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.ord < y.ord WHERE bit_count(xor(x.h, y.h)) <= 3")
def _(spark, sf):
    h = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(268435455))
    return M.hamming_pairs(V.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), h.alias("h")), 3, width=28)


_NN = "n AS (SELECT x.ord AS id, arg_min(y.ord, (-round(list_dot_product(x.v, y.v), 12), y.ord)) AS ref, max(round(list_dot_product(x.v, y.v), 12)) AS sim FROM u x, u y WHERE x.source <> 'real' AND y.source = 'real' GROUP BY 1)"


@query("jn8_nearest_neighbour", f"WITH {_N}, {_NN} SELECT id, ref, round(sim, 6) AS sim FROM n")
def _(spark, sf):
    v = vectors(spark, sf)
    return M.nearest(C.synthetic(v), C.real(v)).select("id", "ref", F.round("sim", 6).alias("sim"))


@query(
    "jn9_fold_leakage",
    f"WITH {_N}, n AS (SELECT k AS fold, x.ord AS id, max(list_dot_product(x.v, y.v)) AS sim FROM u x, u y, range(3) f(k) WHERE x.ord % 3 = k AND y.ord % 3 <> k GROUP BY 1, 2) SELECT fold::INT AS fold, t AS threshold, round(avg((sim >= t)::INT::DOUBLE), 9) AS leaked FROM n, (VALUES (0.3::DOUBLE), (0.35), (0.4)) g(t) GROUP BY 1, 2",
)
def _(spark, sf):
    v = vectors(spark, sf).select("ord", "v").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    best = M.nearest(v.where("ord % 3 = fold"), v.where("ord % 3 <> fold"), by=["fold"])
    marks = best.withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.35), F.lit(0.4))))
    return marks.groupBy("fold", "threshold").agg(F.round(F.avg((F.col("sim") >= F.col("threshold")).cast("double")), 9).alias("leaked"))


@query("sim11_mean_leakage", f"WITH {_N}, n AS (SELECT k AS fold, x.ord AS id, max(list_dot_product(x.v, y.v)) AS sim FROM u x, u y, range(3) f(k) WHERE x.ord % 3 = k AND y.ord % 3 <> k GROUP BY 1, 2) SELECT t AS threshold, round(avg(l), 9) AS leaked FROM (SELECT fold, t, avg((sim >= t)::INT::DOUBLE) AS l FROM n, (VALUES (0.3::DOUBLE), (0.35), (0.4)) g(t) GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    v = vectors(spark, sf).select("ord", "v").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    best = M.nearest(v.where("ord % 3 = fold"), v.where("ord % 3 <> fold"), by=["fold"])
    marks = best.withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.35), F.lit(0.4))))
    folds = marks.groupBy("fold", "threshold").agg(F.avg((F.col("sim") >= F.col("threshold")).cast("double")).alias("l"))
    return folds.groupBy("threshold").agg(F.round(F.avg("l"), 9).alias("leaked"))


@query("jn15_known_pairs", f"WITH {_N} SELECT x.ord AS a, y.ord AS b FROM u x JOIN u y ON x.grp = y.grp AND x.ord < y.ord")
def _(spark, sf):
    v = vectors(spark, sf)
    x, y = v.alias("x"), v.alias("y")
    return x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.ord") < F.col("y.ord"))).select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b"))


@query("jn16_stratum_pairs", f"WITH {_PAIRS} SELECT CASE WHEN x.label = y.label THEN 'within' ELSE 'across' END AS relation, count(*) AS n, round(avg(sim), 9) AS mean FROM p JOIN u x ON x.ord = a JOIN u y ON y.ord = b WHERE sim >= 0.2 GROUP BY 1")
def _(spark, sf):
    v = vectors(spark, sf)
    side = lambda s: v.select(F.col("ord").alias(s), F.col("label").alias(f"label_{s}"))
    p = M.cosine_pairs(v, 0.2).join(side("a"), "a").join(side("b"), "b")
    relation = F.when(F.col("label_a") == F.col("label_b"), "within").otherwise("across")
    return p.groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 9).alias("mean"))


@query("sim2_components", _rec(_PAIRS, _cc(f"SELECT a, b FROM p WHERE sim >= {T}"), body="SELECT ord, root FROM cc"))
def _(spark, sf):
    v = vectors(spark, sf)
    return G.with_components(v, M.cosine_pairs(v, T)).select("ord", "root")


@query("sim3_duplicate_groups", _rec(_PAIRS, _cc(f"SELECT a, b FROM p WHERE sim >= {T}"), body="SELECT ord, printf('grp_%06d', dense_rank() OVER (ORDER BY root) - 1) AS gid FROM cc"))
def _(spark, sf):
    return G.duplicate_groups(vectors(spark, sf), None, T)[0].select("ord", "gid")


@query("sim3_duplicate_report", _rec(_PAIRS, _cc(f"SELECT a, b FROM p WHERE sim >= {T}"), body=_REPORT))
def _(spark, sf):
    return G.duplicate_groups(vectors(spark, sf), None, T)[1]


@query("sim4_merged_groups", _rec(_PAIRS, _cc(f"SELECT a, b FROM p WHERE sim >= {T} UNION SELECT min(ord) OVER (PARTITION BY grp), ord FROM u"), body="SELECT ord, printf('sub_%06d', dense_rank() OVER (ORDER BY root) - 1) AS gid FROM cc"))
def _(spark, sf):
    return G.merge_groups(vectors(spark, sf), T).select("ord", "gid")


def _curve(ts) -> str:
    part = "SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM p WHERE sim >= {t}) AS links, count(*) AS components, max(s) AS largest, round(max(s) / sum(s), 9) AS share FROM (SELECT root, count(*) AS s FROM cc{i} GROUP BY 1)"
    closures = [_cc(f"SELECT a, b FROM p WHERE sim >= {t}").replace("e AS", f"e{i} AS", 1).replace("d AS", f"d{i} AS", 1).replace("FROM e", f"FROM e{i}").replace("r AS (", f"r{i} AS (", 1).replace("FROM r JOIN d ON d.a = r.v", f"FROM r{i} r JOIN d{i} d ON d.a = r.v").replace("cc AS (", f"cc{i} AS (", 1).replace("FROM r GROUP", f"FROM r{i} GROUP") for i, t in enumerate(ts)]
    return _rec(_PAIRS, *closures, body=" UNION ALL ".join(part.format(t=t, i=i) for i, t in enumerate(ts)))


@query("sim5_percolation", _curve((0.35, 0.4, 0.45)))
def _(spark, sf):
    return G.component_curve(vectors(spark, sf), [0.35, 0.4, 0.45])


@query("aud15_percolation_curve", _curve((0.32, 0.38, 0.42)))
def _(spark, sf):
    return G.component_curve(vectors(spark, sf), [0.32, 0.38, 0.42])


def one_row(spark, schema: str, *values, digits=()):
    digits = digits or [6] * len(values)
    return spark.createDataFrame([tuple(v if isinstance(v, int) or v is None else round(v, d) for v, d in zip(values, digits))], schema)


@query("sim6_null_distribution", f"WITH {_PAIRS} SELECT count(*) AS pairs, round(quantile_cont(sim, 0.5), 6) AS median, round(quantile_cont(sim, 0.9), 6) AS p90, round(quantile_cont(sim, 0.99), 6) AS p99, round(quantile_cont(sim, 0.999), 6) AS p999, round(max(sim), 6) AS maximum FROM p")
def _(spark, sf):
    n, _, q, _, most = M.pair_ranks(vectors(spark, sf), quantiles=[0.5, 0.9, 0.99, 0.999])
    return one_row(spark, "pairs long, median double, p90 double, p99 double, p999 double, maximum double", n, *q, most)


_BEST = "s AS (SELECT i, max(sim) AS score FROM (SELECT a AS i, sim FROM p UNION ALL SELECT b, sim FROM p) GROUP BY 1)"


@query("sim6_threshold_per_item", f"WITH {_PAIRS}, {_BEST}, o AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS m FROM s), t AS (SELECT least(score, 1.0) AS threshold FROM o WHERE rn = floor(0.05::DOUBLE * m) + 1) SELECT round(threshold, 6) AS threshold, round(avg((score > threshold)::INT::DOUBLE), 9) AS achieved FROM s, t GROUP BY threshold")
def _(spark, sf):
    scores = M.best_of_each(vectors(spark, sf))
    t = G.order_statistic(scores, 0.05)
    return scores.agg(F.round(F.avg((F.col("score") > t).cast("double")), 9).alias("achieved")).select(F.lit(round(t, 6)).alias("threshold"), "achieved")


@query("sim6_threshold_per_pair", f"WITH {_PAIRS}, o AS (SELECT sim, row_number() OVER (ORDER BY sim DESC) AS rn, count(*) OVER () AS m FROM p), t AS (SELECT least(sim, 1.0) AS threshold FROM o WHERE rn = floor(0.01::DOUBLE * m) + 1) SELECT round(threshold, 6) AS threshold, round(avg((sim > threshold)::INT::DOUBLE), 9) AS achieved FROM p, t GROUP BY threshold")
def _(spark, sf):
    t, achieved = G.pair_threshold(vectors(spark, sf), 0.01)
    return one_row(spark, "threshold double, achieved double", t, achieved, digits=(6, 9))


@query("sim7_published_threshold", f"WITH {_PAIRS}, {_BEST} SELECT round(avg((score >= 0.5)::INT::DOUBLE), 9) AS rate FROM s")
def _(spark, sf):
    return M.best_of_each(vectors(spark, sf)).agg(F.round(F.avg((F.col("score") >= 0.5).cast("double")), 9).alias("rate"))


@query("sim8_memorisation", f"WITH {_N}, {_NN} SELECT count(*) AS n, round(avg((sim >= {T})::INT::DOUBLE), 9) AS rate, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.5), 6) AS median, round(quantile_cont(sim, 0.95), 6) AS p95, round(max(sim), 6) AS maximum, CASE WHEN avg((sim >= {T})::INT::DOUBLE) >= 0.05 THEN 'do not release' WHEN avg((sim >= {T})::INT::DOUBLE) >= 0.01 THEN 'review matches' ELSE 'no concern' END AS note FROM n")
def _(spark, sf):
    from corpuslab.functions.scalars import release_note

    v = vectors(spark, sf)
    r = G.memorisation(C.synthetic(v), C.real(v), T)[0]
    return r.select("n", F.round("rate", 9).alias("rate"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "maximum")], release_note(F.col("rate")).alias("note"))


@query("srt2_top_matches", f"WITH {_N}, {_NN} SELECT id, ref, round(sim, 6) AS sim FROM n ORDER BY n.sim DESC, id LIMIT 25")
def _(spark, sf):
    v = vectors(spark, sf)
    return G.memorisation(C.synthetic(v), C.real(v), T)[1].select("id", "ref", F.round("sim", 6).alias("sim"))


_REAL = "u2 AS (SELECT * FROM u WHERE source = 'real')"


@query("sim9_identity_diversity", _rec(_PAIRS, _REAL, _cc("SELECT a, b FROM p WHERE sim >= 0.35 AND a % 3 = 0 AND b % 3 = 0", "u2"), body="SELECT sum(s)::BIGINT AS n_detected, count(*) AS n_clusters, round(exp(sum(-(s / t) * ln(s / t))), 9) AS effective, round(max(s / t), 9) AS largest_share, round(avg(s), 9) AS mean_size FROM (SELECT s, sum(s) OVER () AS t FROM (SELECT root, count(*) AS s FROM cc GROUP BY 1))"))
def _(spark, sf):
    return G.identity_diversity(C.real(vectors(spark, sf)), 0.35)


@query("sim9_cluster_coverage", _rec(_PAIRS, _REAL, _cc("SELECT a, b FROM p WHERE sim >= 0.35 AND a % 3 = 0 AND b % 3 = 0", "u2"), "n AS (SELECT y.ord AS id, max(list_dot_product(x.v, y.v)) >= 0.35 AS hit FROM u x, u y WHERE x.source <> 'real' AND y.source = 'real' GROUP BY 1)", body="SELECT count(*) AS n_clusters, count(*) FILTER (hit) AS n_covered, round(avg(hit::INT::DOUBLE), 9) AS coverage FROM (SELECT root, bool_or(hit) AS hit FROM cc JOIN n ON id = ord GROUP BY 1)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return G.cluster_coverage(C.synthetic(v), C.real(v), 0.35)


@query("sim10_chance_rate", f"WITH {_PAIRS} SELECT t AS threshold, round(avg((sim >= t)::INT::DOUBLE), 9) AS chance FROM p, (VALUES (0.2::DOUBLE), (0.3), (0.4)) g(t) GROUP BY 1")
def _(spark, sf):
    n, _, _, counts, _ = M.pair_ranks(vectors(spark, sf), thresholds=[0.2, 0.3, 0.4])
    return spark.createDataFrame([(t, round(c / n, 9)) for t, (c, _) in zip((0.2, 0.3, 0.4), counts)], "threshold double, chance double")


@query("sim12_capture_control", f"WITH {_PAIRS} SELECT count(*) AS pairs, round(quantile_cont(sim, 0.99), 6) AS p99, round(avg((sim >= 0.3)::INT::DOUBLE), 9) AS tail FROM p JOIN u x ON x.ord = a JOIN u y ON y.ord = b WHERE x.label = 0 AND y.label = 0")
def _(spark, sf):
    n, _, (p99,), ((tail, _),), _ = M.pair_ranks(vectors(spark, sf).where("label = 0"), quantiles=[0.99], thresholds=[0.3])
    return one_row(spark, "pairs long, p99 double, tail double", n, p99, tail / n, digits=(0, 6, 9))


@query("sim13_pool_null", f"WITH {_PAIRS}, q AS (SELECT p.* FROM p JOIN u x ON x.ord = a JOIN u y ON y.ord = b WHERE x.grp <> y.grp) SELECT count(*) AS pairs, round(quantile_cont(sim, 0.999), 6) AS p999 FROM q")
def _(spark, sf):
    n, _, (p999,), _, _ = M.pair_ranks(vectors(spark, sf), quantiles=[0.999], apart="grp")
    return one_row(spark, "pairs long, p999 double", n, p999)


_CONTAMINATION = (
    f"WITH {_PAIRS}, t AS (SELECT k AS trial, ord, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('|', k, ord)), ord) > floor(0.74::DOUBLE * (SELECT count(*) FROM u)) AS held FROM u, range(200) r(k)), "
    "b AS (SELECT a, b FROM p WHERE sim >= 0.35 UNION ALL SELECT b, a FROM p WHERE sim >= 0.35), "
    "l AS (SELECT DISTINCT x.trial, x.ord FROM t x JOIN b ON b.a = x.ord JOIN t y ON y.trial = x.trial AND y.ord = b.b WHERE x.held AND NOT y.held) "
    "SELECT t.trial, round(count(l.ord) / count(*), 9) AS leaked FROM t LEFT JOIN l ON l.trial = t.trial AND l.ord = t.ord WHERE held GROUP BY 1"
)


@query("sim14_split_contamination", _CONTAMINATION)
def _contamination(spark, sf):
    v = vectors(spark, sf)
    trials = v.select("ord").withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    place = F.row_number().over(W.partitionBy("trial").orderBy(order_key(F.col("trial"), F.col("ord")), "ord"))
    t = trials.withColumn("held", place > math.floor(0.74 * v.count()))
    p = M.cosine_pairs(v, 0.35)
    both = p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    train = t.where("NOT held").select("trial", F.col("ord").alias("b"))
    hit = t.where("held").join(both, F.col("ord") == F.col("a")).join(train, ["trial", "b"], "left_semi").select("trial", "ord").distinct().withColumn("hit", F.lit(1.0))
    return t.where("held").join(hit, ["trial", "ord"], "left").groupBy("trial").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("leaked"))


#: Published folds, a split by items, one by groups, and pairs drawn at random, over nine thresholds.
_REGIMES = (
    f"WITH {_PAIRS}, m AS (SELECT *, ord % 3 AS fold, md5(concat_ws('|', 21, ord)) < '4' AS by_item, md5(concat_ws('|', 22, grp)) < '4' AS by_group FROM u), "
    "g(t) AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]::DOUBLE[])), "
    "f AS (SELECT x.fold AS k, x.ord, max(list_dot_product(x.v, y.v)) AS sim FROM m x JOIN m y ON x.fold <> y.fold GROUP BY 1, 2), "
    "i AS (SELECT x.ord, max(list_dot_product(x.v, y.v)) AS sim FROM m x JOIN m y ON x.by_item AND NOT y.by_item GROUP BY 1), "
    "h AS (SELECT x.ord, max(list_dot_product(x.v, y.v)) AS sim FROM m x JOIN m y ON x.by_group AND NOT y.by_group GROUP BY 1) "
    "SELECT 'folds' AS regime, t AS threshold, round(avg(l), 9) AS leaked FROM (SELECT k, t, avg((sim >= t)::INT::DOUBLE) AS l FROM f, g GROUP BY 1, 2) GROUP BY 2 "
    "UNION ALL SELECT 'items', t, round(avg((sim >= t)::INT::DOUBLE), 9) FROM i, g GROUP BY 2 UNION ALL SELECT 'groups', t, round(avg((sim >= t)::INT::DOUBLE), 9) FROM h, g GROUP BY 2 "
    "UNION ALL SELECT 'chance', t, round(avg((sim >= t)::INT::DOUBLE), 9) FROM p, g GROUP BY 2"
)


@query("aud16_leakage_curve", _REGIMES)
def _(spark, sf):
    v = vectors(spark, sf).select("ord", "v", "grp")
    held = lambda seed, c: order_key(seed, F.col(c)) < "4"
    folds = v.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    found = M.nearest(folds.where("ord % 3 = fold"), folds.where("ord % 3 <> fold"), by=["fold"]).select(F.lit("folds").alias("regime"), "fold", "sim")
    for regime, test in (("items", held(21, "ord")), ("groups", held(22, "grp"))):
        best = M.nearest(v.where(test), v.where(~test))
        found = found.unionByName(best.select(F.lit(regime).alias("regime"), F.lit(0).alias("fold"), "sim"))
    return G.leakage_curve(found, v, [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6])

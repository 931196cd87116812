"""Duplicate and identity groups, threshold calibration, memorisation and diversity audits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators.components import components
from corpuslab.operators.corpus import first_appearance_ids, group_report
from corpuslab.operators.similarity import best_of_each, cosine_pairs, detected, hamming_pairs, nearest, pair_ranks
from corpuslab.plans.scratch import cut


def with_components(nodes: DataFrame, edges: DataFrame, key: str = "ord") -> DataFrame:
    """nodes with `root`, the least key of each one's component; a node without links is its own."""
    found = components(edges.select("a", "b")).select(F.col("node").alias("__node"), F.col("label").alias("__root"))
    return nodes.join(found, F.col(key) == F.col("__node"), "left").withColumn("root", F.coalesce("__root", key)).drop("__node", "__root")


def duplicate_groups(records: DataFrame, most_bits: int | None = 8, cosine: float | None = 0.95, key: str = "ord", bits: str = "h", vec: str = "v") -> tuple[DataFrame, DataFrame]:
    """(records with `root` and `gid`, report): components over close hashes and similar vectors, numbered by first appearance."""
    edges = []
    if most_bits is not None and bits in records.columns:
        edges.append(hamming_pairs(records, most_bits, key, bits).select("a", "b"))
    if cosine is not None and vec in records.columns:
        edges.append(cosine_pairs(records, cosine, key, vec).select("a", "b"))
    both = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
    out = first_appearance_ids(with_components(records, both, key), "root", key, "grp_")
    return out, group_report(out, "root")


def merge_groups(records: DataFrame, cosine: float, group: str = "grp", key: str = "ord", vec: str = "v") -> DataFrame:
    """Coarser groups: existing ones, never split, joined where two of their records are similar. Adds `root` and `gid`."""
    star = records.withColumn("__hub", F.min(key).over(W.partitionBy(group))).where(F.col(key) != F.col("__hub")).select(F.col("__hub").alias("a"), F.col(key).alias("b"))
    edges = star.unionByName(cosine_pairs(records, cosine, key, vec).select("a", "b"))
    return first_appearance_ids(with_components(records, edges, key), "root", key, "sub_")


def component_curve(records: DataFrame, thresholds: list[float], key: str = "ord", vec: str = "v") -> DataFrame:
    """threshold, links, components, largest, share: by nested contraction. The pairs are made once, for the lowest threshold; each
    lower threshold links the components of the one above."""
    n = records.count()
    pairs = cut(cosine_pairs(records, min(thresholds), key, vec), "pairs")
    state, out = None, None
    for t in sorted(thresholds, reverse=True):
        own = pairs.where(F.col("sim") >= t)
        links = own.count()
        edges = own.select("a", "b")
        if state is not None:
            names = state.select(F.col("node"), F.col("label"))
            for side in ("a", "b"):
                edges = edges.join(names.select(F.col("node").alias("__n"), F.col("label").alias("__l")), F.col(side) == F.col("__n"), "left").withColumn(side, F.coalesce("__l", side)).drop("__n", "__l")
            edges = edges.where("a <> b").distinct()
        found = components(edges)
        if state is not None:
            up = found.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
            moved = state.join(up, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label"))
            found = moved.unionByName(found.join(state.select("node"), "node", "left_anti"))
        state = cut(found, "components")
        sizes = state.groupBy("label").agg(F.count(F.lit(1)).alias("s")).agg(F.count(F.lit(1)).alias("c"), F.sum("s").alias("m"), F.max("s").alias("x"))
        largest = F.coalesce("x", F.lit(min(n, 1)))
        row = sizes.select(
            F.lit(float(t)).alias("threshold"), F.lit(links).cast("long").alias("links"), (F.lit(n) - F.coalesce("m", F.lit(0)) + F.col("c")).cast("long").alias("components"),
            largest.cast("long").alias("largest"), F.round(largest / F.lit(float(max(n, 1))), 9).alias("share"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class Calibration:
    """What a null distribution says about a threshold."""

    mode: str
    n: int
    pairs: int
    median: float
    p90: float
    p99: float
    p999: float
    maximum: float
    threshold: float
    achieved: float
    reference: float | None
    reference_rate: float | None
    usable: bool | None
    recommended: float | None
    curve: DataFrame | None


def order_statistic(scores: DataFrame, rate: float) -> float | None:
    """The smallest t with at most this share of scores above it: the (k + 1)-th largest, k = floor(rate * m), at most 1."""
    m = scores.count()
    k = math.floor(rate * m)
    if not m:
        return None
    top = scores.orderBy(F.desc("score")).limit(k + 1).agg(F.min("score")).first()[0]
    return min(top, 1.0)


def pair_threshold(records: DataFrame, rate: float, key: str = "ord", vec: str = "v", apart: str | None = None) -> tuple[float | None, float | None]:
    """(the smallest t with at most this share of pairs above it, that share)."""
    at = lambda n: [n - 1 - math.floor(rate * n)]
    n, ranked, _, _, _ = pair_ranks(records, at, key=key, vec=vec, apart=apart)
    if not n:
        return None, None
    t = min(ranked[0], 1.0)
    return t, pair_ranks(records, thresholds=[t], key=key, vec=vec, apart=apart)[3][0][1] / n


def calibrate(records: DataFrame, rate: float = 0.01, mode: str = "per_item", known: str | None = None, reference: float | None = None, grid: list[float] | None = None, cap: float = 0.05, key: str = "ord", vec: str = "v") -> Calibration:
    """A threshold at a target false-positive rate from a corpus's own pairs, and the lowest
    threshold from it on at which the largest component stays within the cap. `known` names a column: pairs of one value of it are known, and no
    part of the null distribution; in components they count."""
    n = records.count()
    if n < 3:
        raise ValueError("calibration needs at least 3 records")
    limits = [] if reference is None else [reference]
    pairs, _, (median, p90, p99, p999), counts, most = pair_ranks(records, quantiles=[0.5, 0.9, 0.99, 0.999], thresholds=limits, key=key, vec=vec, apart=known)
    if mode == "per_pair":
        t, achieved = pair_threshold(records, rate, key, vec, known)
        at_reference = None if reference is None else counts[0][0] / pairs
    elif mode == "per_item":
        scores = cut(best_of_each(records, key, vec, known), "null_scores")
        t = order_statistic(scores, rate)
        share = lambda hit: scores.agg(F.avg(hit.cast("double"))).first()[0]
        achieved, at_reference = share(F.col("score") > t), None if reference is None else share(F.col("score") >= reference)
    else:
        raise ValueError(f"unknown mode {mode}")
    points = grid or [max(median, 0.0) + (1 - max(median, 0.0)) * i / 8 for i in range(9)]
    candidates = sorted({p for p in [t, *points, *[t + (1 - t) * i / 39 for i in range(40)]] if p >= t})
    curve = component_curve(records, sorted({*points, *candidates}), key, vec)
    fits = [r["threshold"] for r in curve.where(F.col("share") <= cap).collect() if r["threshold"] >= t]
    return Calibration(mode, n, pairs, median, p90, p99, p999, most, t, achieved, reference, at_reference, None if reference is None else at_reference <= 2 * rate, min(fits) if fits else None, curve)


def memorisation(generated: DataFrame, reference: DataFrame, threshold: float = 0.95, k: int = 25, key: str = "ord", vec: str = "v") -> tuple[DataFrame, DataFrame]:
    """(report, the k closest matches): how often generated records have a reference record at least this similar."""
    best = cut(nearest(generated, reference, key, vec), "nearest")
    rate = F.avg((F.col("sim") >= threshold).cast("double"))
    report = best.agg(
        F.count(F.lit(1)).alias("n"), rate.alias("rate"), F.avg("sim").alias("mean"), F.percentile("sim", 0.5).alias("median"), F.percentile("sim", 0.95).alias("p95"), F.max("sim").alias("maximum"),
    )
    return report, best.orderBy(F.desc("sim"), "id").limit(k)


def identity_diversity(records: DataFrame, threshold: float = 0.60, key: str = "ord", vec: str = "v") -> DataFrame:
    """One row: detected, clusters, effective clusters, the largest share, the mean size. Nothing detected gives zeros."""
    seen = records.where(detected(F.col(vec)))
    sizes = with_components(seen, cosine_pairs(seen, threshold, key, vec), key).groupBy("root").agg(F.count(F.lit(1)).alias("s"))
    total = sizes.agg(F.sum("s").alias("t"))
    p = F.col("s") / F.col("t")
    return sizes.crossJoin(F.broadcast(total)).agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("n_detected"), F.count(F.lit(1)).alias("n_clusters"), F.round(F.coalesce(F.exp(F.sum(-p * F.log(p))), F.lit(0.0)), 9).alias("effective"),
        F.round(F.coalesce(F.max(p), F.lit(0.0)), 9).alias("largest_share"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 9).alias("mean_size"),
    )


def cluster_coverage(synthetic: DataFrame, reference: DataFrame, threshold: float, key: str = "ord", vec: str = "v") -> DataFrame:
    """One row: the share of reference clusters with a member that a synthetic record is at least this similar to."""
    seen = reference.where(detected(F.col(vec)))
    clusters = with_components(seen, cosine_pairs(seen, threshold, key, vec), key)
    hit = nearest(seen, synthetic.where(detected(F.col(vec))), key, vec).select("id", (F.col("sim") >= threshold).alias("hit"))
    by = clusters.join(hit, F.col(key) == F.col("id"), "left").groupBy("root").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    return by.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if("hit").alias("n_covered"), F.round(F.avg(F.col("hit").cast("double")), 9).alias("coverage"))


def leakage_curve(best: DataFrame, records: DataFrame, thresholds: list[float], key: str = "ord", vec: str = "v") -> DataFrame:
    """regime, threshold, leaked: for each regime the share of held-out records whose best training record (regime, fold, sim) is at least as similar as the
    threshold, the mean of the regime's folds; and under 'chance' the share of all pairs."""
    marks = best.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    folds = marks.groupBy("regime", "fold", "threshold").agg(F.avg((F.col("sim") >= F.col("threshold")).cast("double")).alias("l"))
    n, _, _, counts, _ = pair_ranks(records, thresholds=thresholds, key=key, vec=vec)
    chance = records.sparkSession.createDataFrame([("chance", float(t), round(c / n, 9) if n else None) for t, (c, _) in zip(thresholds, counts)], "regime string, threshold double, leaked double")
    return folds.groupBy("regime", "threshold").agg(F.round(F.avg("l"), 9).alias("leaked")).unionByName(chance)

"""Audits of labels, duplicates, folds, provenance, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators.corpus import numbered


def exact_duplicates(items: DataFrame, digest: str) -> DataFrame:
    """digest, n: contents that occur more than once."""
    return items.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array, as sorted[n // 2] is."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def pair_consistency(items: DataFrame, digest: str, label: str, count: str) -> DataFrame:
    """One row over groups of exactly two: pairs, agreement of labels and counts, the upper median, mean and greatest difference."""
    g = items.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("l0"), F.max(label).alias("l1"), F.min(count).alias("c0"), F.max(count).alias("c1")).where("n = 2")
    d = g.groupBy((F.col("c1") - F.col("c0")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l0") == F.col("l1")).alias("same"))
    # A row for each difference of counts.
    so_far = d.withColumn("after", F.sum("n").over(W.orderBy("d"))).withColumn("m", F.sum("n").over(W.partitionBy()))
    return so_far.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("same"), F.lit(0)).alias("same_label"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("n"))), F.lit(0)).alias("same_count"),
        F.min(F.when(F.col("after") > F.floor(F.col("m") / 2), F.col("d"))).alias("median"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"), F.max("d").alias("greatest"),
    )


def fold_leakage(items: DataFrame, digest: str, label: str, fold: str) -> DataFrame:
    """fold, n, free, forced: test members whose content is also outside the fold; free if a copy there has the same label. Counts by
    (content, label, fold) are joined, so hot contents don't multiply."""
    own = items.groupBy(digest, label, fold).agg(F.count(F.lit(1)).alias("n"))
    by_label = F.sum("n").over(W.partitionBy(digest, label)) - F.col("n")
    by_fold = F.sum("n").over(W.partitionBy(digest)) - F.sum("n").over(W.partitionBy(digest, fold))
    seen = own.withColumn("same", by_label > 0).withColumn("any", by_fold > 0)
    return seen.groupBy(fold).agg(
        F.sum("n").cast("long").alias("n"), F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0)).cast("long").alias("free"),
        F.coalesce(F.sum(F.when(F.col("any") & ~F.col("same"), F.col("n"))), F.lit(0)).cast("long").alias("forced"),
    )


def rebanded(df: DataFrame, count: str, order: str, histogram: DataFrame) -> DataFrame:
    """Adds `matched`: grades dealt by rank of the count so that they have the target histogram (label, n)."""
    ranked = numbered(df, [F.col(count), F.col(order)], "__rn")
    # A row for each grade.
    edges = histogram.select("label", F.sum("n").over(W.orderBy("label")).alias("hi"), (F.sum("n").over(W.orderBy("label")) - F.col("n")).alias("lo"))
    return ranked.join(F.broadcast(edges), (F.col("__rn") > F.col("lo")) & (F.col("__rn") <= F.col("hi"))).withColumnRenamed("label", "matched").drop("__rn", "lo", "hi")


def quantile_bands(df: DataFrame, value: str, q: int = 5) -> DataFrame:
    """Rows with `band`: bands between quantiles, closed at both ends, so a row on an edge is in two."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("e"))
    bands = edges.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(q)), lambda i: F.struct(F.element_at("e", i).alias("lo"), F.element_at("e", i + 1).alias("hi")))).alias("band", "x"))
    bands = bands.select("band", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    return df.join(F.broadcast(bands), F.col(value).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def stratum_confound(df: DataFrame, stratum: str, order: str, cls: str) -> DataFrame:
    """cls, n, on_mode: the share of each class in the most frequent stratum."""
    top = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).agg(F.max_by(stratum, F.struct("n", -F.col("f"))).alias("__top"))
    flagged = df.crossJoin(F.broadcast(top)).withColumn("on", F.col(stratum) == F.col("__top"))
    return flagged.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("on").cast("double")).alias("on_mode"))


def rule_quality(df: DataFrame, rule: Column, truth: Column) -> DataFrame:
    """sensitivity, specificity of a rule; null where undefined."""
    r = df.select(rule.alias("r"), truth.alias("t"))
    return r.agg(F.avg(F.when(F.col("t"), F.col("r").cast("double"))).alias("sensitivity"), F.avg(F.when(~F.col("t"), 1 - F.col("r").cast("double"))).alias("specificity"))


def last_state(log: DataFrame, name: str = "name", path: str = "path", reason: str = "blocked_reason", order: str = "ord") -> DataFrame:
    """name, state: 'ok' once any attempt gave a path; else by the last attempt, '429' or 'empty'."""
    kind = F.when(F.coalesce(F.col(reason), F.lit("")).contains("429"), "429").otherwise("empty")
    return log.groupBy(name).agg(F.when(F.bool_or(F.col(path).isNotNull()), "ok").otherwise(F.max_by(kind, order)).alias("state"))


def refusal_yield(states: DataFrame, by: str, target: int) -> DataFrame:
    """by, ok, empty, throttled, yield, needed: prompts needed to reach the target; infinity where nothing has come."""
    s = states.groupBy(by).agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "empty").alias("empty"), F.count_if(F.col("state") == "429").alias("throttled"))
    y = F.coalesce(F.try_divide("ok", F.col("ok") + F.col("empty")), F.lit(0.0))
    need = F.when(y > 0, F.greatest(F.lit(target) - F.col("ok"), F.lit(0)) / F.when(y > 0, y)).otherwise(F.lit(float("inf")))
    return s.select(by, "ok", "empty", "throttled", y.alias("yield"), need.alias("needed"))


def persistently_refused(log: DataFrame, least: int = 2, name: str = "name", path: str = "path", reason: str = "blocked_reason") -> DataFrame:
    """Names with so many empty answers, throttling not counted, and no success."""
    empty = F.col(path).isNull() & ~F.coalesce(F.col(reason), F.lit("")).contains("429")
    return log.groupBy(name).agg(F.count_if(empty).alias("empties"), F.bool_or(F.col(path).isNotNull()).alias("ok")).where((F.col("empties") >= least) & ~F.col("ok")).select(name, "empties")


def concordance(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, continuity: 100 times the share of concordant pairs of different labels, ties half. cells: y_true, y_pred, n; pairs of cells
    stand for pairs of rows."""
    by = by or []
    x = cells.select(*by, F.col("y_true").alias("t1"), F.col("y_pred").alias("p1"), F.col("n").alias("n1"))
    y = cells.select(*by, F.col("y_true").alias("t2"), F.col("y_pred").alias("p2"), F.col("n").alias("n2"))
    pairs = (x.join(y, by) if by else x.crossJoin(y)).where("t1 < t2")
    score = F.when(F.col("p1") < F.col("p2"), 1.0).when(F.col("p1") == F.col("p2"), 0.5).otherwise(0.0)
    w = F.col("n1") * F.col("n2")
    return pairs.groupBy(*by).agg((100 * F.try_divide(F.sum(score * w), F.sum(w))).alias("continuity"))


def scope(cells: DataFrame, by: list[str] | None = None, k: int = 4) -> DataFrame:
    """by, scope: 100 times the range of the mean predictions by label over k - 1."""
    by = by or []
    m = cells.groupBy(*by, "y_true").agg((F.sum(F.col("y_pred") * F.col("n")) / F.sum("n")).alias("m"))
    return m.groupBy(*by).agg((100 * (F.max("m") - F.min("m")) / (k - 1)).alias("scope"))


def saturation(means: DataFrame, by: list[str], grade: str, mean: str, step: float = 0.05) -> DataFrame:
    """by, saturates_at: the first grade whose mean is at most the one before plus `step`; null if none."""
    prev = F.lag(mean).over(W.partitionBy(*by).orderBy(grade))
    return means.withColumn("__p", prev).groupBy(*by).agg(F.min(F.when(F.col(mean) <= F.col("__p") + step, F.col(grade))).alias("saturates_at"))


def monotone(gaps: DataFrame, by: list[str], order: str, gap: str) -> DataFrame:
    """by, rising: whether every gap is above the one before."""
    up = F.col(gap) > F.lag(gap).over(W.partitionBy(*by).orderBy(order))
    return gaps.withColumn("__up", up).groupBy(*by).agg(F.coalesce(F.bool_and("__up"), F.lit(True)).alias("rising"))


def scatter(vectors: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """within, between, ratio: mean squared distance to the class centroid, and of centroids to their unweighted mean."""
    flat = vectors.select(label, F.posexplode(vec).alias("d", "x"))
    c = flat.groupBy(label, "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    within = c.groupBy(label).agg(F.sum("v").alias("w")).agg(F.avg("w").alias("within"))
    between = c.groupBy("d").agg(F.var_pop("m").alias("b")).agg(F.sum("b").alias("between"))
    return within.crossJoin(between).withColumn("ratio", F.try_divide("between", "within"))


def margins(vectors: DataFrame, train: DataFrame, key: str = "ord", label: str = "label", vec: str = "v") -> DataFrame:
    """key, label, margin: the distance to the nearest other class's centroid less that to the own. Centroids, a row for each class, are broadcast."""
    c = train.select(label, F.posexplode(vec).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"))
    c = c.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("__c")).withColumnRenamed(label, "__l")
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vec), F.col("__c"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    far = vectors.select(key, label, vec).crossJoin(F.broadcast(c)).select(key, label, d.alias("d"), (F.col("__l") == F.col(label)).alias("own"))
    return far.groupBy(key, label).agg((F.min(F.when(~F.col("own"), F.col("d"))) - F.min(F.when(F.col("own"), F.col("d")))).alias("margin"))


def small_n_bias(predictions: DataFrame, n: int, draws: int, key: str = "ord") -> DataFrame:
    """observed, mean, lo, hi, at_least: the scope of all predictions (y_true, y_pred), and of draws of n records of each grade: their mean, 95% range and
    the share that reaches the observed one. A draw's records are the least n by its digest, found with a partial limit in each task."""
    from corpuslab.functions.draws import order_key

    wide = predictions.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    place = F.row_number().over(W.partitionBy("draw", "y_true").orderBy(order_key(F.col("draw"), F.col(key)), key))
    picked = wide.withColumn("rn", place).where(F.col("rn") <= n).withColumn("n", F.lit(1))
    scopes = scope(picked, ["draw"])
    observed = scope(predictions.withColumn("n", F.lit(1)).withColumn("draw", F.lit(-1).cast("long")), ["draw"]).select(F.col("scope").alias("observed"))
    q = lambda p: F.percentile("scope", p)
    # One row of the observed value.
    both = scopes.crossJoin(F.broadcast(observed))
    return both.agg(F.first("observed").alias("observed"), F.avg("scope").alias("mean"), q(0.025).alias("lo"), q(0.975).alias("hi"), F.avg((F.col("scope") >= F.col("observed") - 1e-9).cast("double")).alias("at_least"))

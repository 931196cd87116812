"""Intervals, bootstraps, tests and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpuslab.functions import tails
from corpuslab.functions.draws import draw
from corpuslab.operators.corpus import numbered
from corpuslab.operators.metrics import confusion

#: Critical values are looked up to this many degrees of freedom, and the normal value beyond.
MOST_DF = 400
NORMAL = 1.959963984540054


def critical(df: Column, level: float = 0.95) -> Column:
    values = F.array(*[F.lit(v) for _, v in tails.t_table(MOST_DF, level)])
    return F.when(df < 1, None).when(df <= MOST_DF, F.element_at(values, F.least(F.greatest(df, F.lit(1)), F.lit(MOST_DF)).cast("int"))).otherwise(NORMAL)


@F.udf(T.DoubleType())
def t_p_value(t, df):
    """Two-sided; a row for each test, not for each datum."""
    return None if t is None or df is None or df < 1 else tails.t_two_sided(t, df)


@F.udf(T.DoubleType())
def chi2_p_value(x, df):
    return None if x is None or df is None or df < 1 else tails.chi2_upper(x, df)


def mean_ci(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by, n, point, lo, hi: Student's interval of finite values; without values all null, with one only the point."""
    ok = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    s = df.groupBy(*by).agg(F.count(ok).alias("n"), F.avg(ok).alias("point"), F.stddev_samp(ok).alias("sd"))
    half = F.col("sd") / F.sqrt("n") * critical(F.col("n") - 1, level)
    return s.select(*by, "n", "point", (F.col("point") - half).alias("lo"), (F.col("point") + half).alias("hi"))


def bootstrap_cells(pred: DataFrame, n_boot: int, seed: int, order: str = "ord", columns: tuple[str, ...] = ("y_true", "y_pred")) -> DataFrame:
    """draw, columns, n: each draw's cells. Rows are numbered, a draw picks n of the numbers, and only its cells are kept."""
    n = pred.count()
    rows = numbered(pred.select(*dict.fromkeys((*columns, order))), [F.col(order)], "i", 0).select(*columns, "i")
    draws = pred.sparkSession.range(n_boot * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), (F.col("id") % max(n, 1)).alias("j"))
    picked = draws.withColumn("i", draw(max(n, 1), seed, F.col("draw"), F.col("j")))
    return picked.join(rows, "i").groupBy("draw", *columns).agg(F.count(F.lit(1)).alias("n"))


def bootstrap_metric(pred: DataFrame, metric, n_boot: int = 10000, seed: int = 0, level: float = 0.95, order: str = "ord") -> DataFrame:
    """point, lo, hi. metric: from cells and grouping columns to a table with `value`."""
    point = metric(confusion(pred), []).select(F.col("value").alias("point"))
    values = metric(bootstrap_cells(pred, n_boot, seed, order), ["draw"])
    q = values.agg(F.percentile("value", (1 - level) / 2).alias("lo"), F.percentile("value", (1 + level) / 2).alias("hi"))
    return point.crossJoin(q)


def paired_bootstrap(pred: DataFrame, metric, n_boot: int = 10000, seed: int = 0, level: float = 0.95, order: str = "ord") -> DataFrame:
    """point, lo, hi, p: of metric(b) - metric(a) on the same draws. pred: y_true, y_pred_a, y_pred_b; rows without one of the
    predictions are an error of the caller's join and raise."""
    if pred.where(F.col("y_pred_a").isNull() | F.col("y_pred_b").isNull()).limit(1).count():
        raise ValueError("both arms need a prediction for every row")
    arm = lambda df, by, a: metric(df.withColumnRenamed(f"y_pred_{a}", "y_pred").groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n")), by)
    whole = pred.groupBy("y_true", "y_pred_a", "y_pred_b").agg(F.count(F.lit(1)).alias("n"))
    point = arm(whole, [], "b").select(F.col("value").alias("b")).crossJoin(arm(whole, [], "a").select(F.col("value").alias("a"))).select((F.col("b") - F.col("a")).alias("point"))
    cells = bootstrap_cells(pred, n_boot, seed, order, ("y_true", "y_pred_a", "y_pred_b"))
    both = arm(cells, ["draw"], "b").select("draw", F.col("value").alias("b")).join(arm(cells, ["draw"], "a").select("draw", F.col("value").alias("a")), "draw")
    d = both.select((F.col("b") - F.col("a")).alias("d"))
    low, high = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    q = d.agg(F.percentile("d", (1 - level) / 2).alias("lo"), F.percentile("d", (1 + level) / 2).alias("hi"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
    return point.crossJoin(q)


def bootstrap_mean(df: DataFrame, value: str, order: str, n_boot: int = 20000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """point, lo, hi of the mean."""
    cells = bootstrap_cells(df, n_boot, seed, order, (value,))
    means = cells.groupBy("draw").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("m"))
    q = means.agg(F.percentile("m", (1 - level) / 2).alias("lo"), F.percentile("m", (1 + level) / 2).alias("hi"))
    return df.agg(F.avg(value).alias("point")).crossJoin(q)


def holm(tests: DataFrame, p: str = "p", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """name, p, adjusted_p, reject: Holm's step-down; the adjusted value is min(1, p (m - rank)), not made monotone. A row for each test."""
    w = W.orderBy(p, name)
    m, rank = F.count(F.lit(1)).over(W.partitionBy()), F.row_number().over(w) - 1
    ok = tests.select(name, p, m.alias("m"), rank.alias("rank")).withColumn("ok", F.col(p) <= alpha / (F.col("m") - F.col("rank")))
    return ok.select(name, p, F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("rank"))).alias("adjusted_p"), (F.min(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1).alias("reject"))


def trend(runs: DataFrame, by: list[str], x: str, y: str, seed: str = "seed", level: float = 0.95) -> DataFrame:
    """by, n, slope, lo, hi, t, p: the mean of the seeds' least-squares slopes (two finite points at least), Student's interval and test."""
    finite = runs.where(F.col(y).isNotNull() & ~F.isnan(y))
    slopes = finite.groupBy(*by, seed).agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("points")).where("points >= 2 AND slope IS NOT NULL")
    s = slopes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("slope"), F.stddev_samp("slope").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    half = se * critical(F.col("n") - 1, level)
    t = F.try_divide("slope", se)
    return s.select(*by, "n", "slope", (F.col("slope") - half).alias("lo"), (F.col("slope") + half).alias("hi"), t.alias("t")).withColumn("p", t_p_value("t", F.col("n") - 1))


def first_crossing(curve: DataFrame, by: list[str], k: str, y: str, target: str) -> DataFrame:
    """by, k, reached: where y first reaches the target, interpolated from the point before; infinity if never."""
    w = W.partitionBy(*by).orderBy(k)
    c = curve.where(F.col(y).isNotNull()).withColumns({"__rn": F.row_number().over(w), "__k0": F.lag(k).over(w), "__y0": F.lag(y).over(w)})
    hit = F.col(y) >= F.col(target)
    at = c.groupBy(*by).agg(F.min_by(F.struct(F.col(k).alias("k"), F.col(y).alias("y"), "__k0", "__y0", F.col(target).alias("t")), F.when(hit, F.col("__rn"))).alias("h"), F.bool_or(hit).alias("reached"))
    rise = F.col("h.y") - F.col("h.__y0")
    between = F.when(rise > 0, F.col("h.__k0") + (F.col("h.t") - F.col("h.__y0")) / F.when(rise > 0, rise) * (F.col("h.k") - F.col("h.__k0"))).otherwise(F.col("h.k"))
    found = F.when(~F.col("reached"), F.lit(float("inf"))).when(F.col("h.__k0").isNull(), F.col("h.k")).otherwise(between)
    return at.select(*by, found.cast("double").alias("k"), "reached")


def chi2_independence(cells: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """chi2, df, p, v: Pearson's statistic of a contingency table with its zero cells left out, and Cramer's V."""
    t = cells.withColumn("__r", F.sum(n).over(W.partitionBy(row))).withColumn("__c", F.sum(n).over(W.partitionBy(column)))
    s = t.agg(F.sum(F.col(n) * F.col(n) / (F.col("__r") * F.col("__c"))).alias("s"), F.sum(n).alias("total"), F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c"))
    x = F.col("total") * (F.col("s") - 1)
    d = (F.col("r") - 1) * (F.col("c") - 1)
    v = F.sqrt(F.try_divide(x, F.col("total") * (F.least("r", "c") - 1)))
    return s.select(x.alias("chi2"), d.alias("df"), v.alias("v")).withColumn("p", chi2_p_value("chi2", "df"))


def paired_t(df: DataFrame, by: list[str], diff: str, level: float = 0.95) -> DataFrame:
    """by, n, mean, sd, t, p, lo, hi, positive."""
    s = df.where(F.col(diff).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"), F.count_if(F.col(diff) > 0).alias("positive"))
    se = F.col("sd") / F.sqrt("n")
    half = se * critical(F.col("n") - 1, level)
    return s.select(*by, "n", "mean", "sd", F.try_divide("mean", se).alias("t"), (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "positive").withColumn("p", t_p_value("t", F.col("n") - 1))


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """f, df1, df2 of a one-way analysis of variance."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("m2"))
    between = F.col("m2") - F.col("n") * F.col("grand") * F.col("grand")
    return s.select(F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def variance_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """ratio: the mean variance within rows over the columns, to the variance of the rows' means; both with n - 1."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / len(columns)
    rows = df.withColumn("__m", mean).withColumn("__v", F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - F.col("__m")) ** 2) / (len(columns) - 1))
    return rows.agg(F.try_divide(F.avg("__v"), F.var_samp("__m")).alias("ratio"))


def learning_curve(df: DataFrame, by: list[str], n: str, y: str) -> DataFrame:
    """by, slope, intercept: y against the binary logarithm of n."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.log2(n)).alias("slope"), F.regr_intercept(F.col(y), F.log2(n)).alias("intercept"))

"""Metrics of predictions (y_true, y_pred) by groups. Undefined is null; every class 0 .. k-1 is in a confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.corpus import average_rank, ordinal_rank

K = 4


def confusion(pred: DataFrame, by: list[str] | None = None, k: int = K) -> DataFrame:
    """by, y_true, y_pred, n: dense, with zero cells."""
    by = by or []
    n = pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    groups = pred.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    cells = groups.select("*", side("y_true")).select("*", side("y_pred"))
    return cells.join(n, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_scores(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, cls, support, recall, f1: from confusion cells. A class that is only predicted has f1 0."""
    by = by or []
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("cls"), F.lit(True).alias("t")), F.struct(F.col("y_pred").alias("cls"), F.lit(False).alias("t")))).alias("x"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit"))
    s = sides.groupBy(*by, F.col("x.cls").alias("cls")).agg(
        F.sum(F.when(F.col("x.t"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.t"), F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("x.t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp")
    )
    return s.select(*by, "cls", F.col("support").cast("long").alias("support"), F.try_divide("tp", "support").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def qwk(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, qwk: quadratic-weighted kappa; null without rows or without expected disagreement."""
    by = by or []
    d = (F.col("y_true") - F.col("y_pred")) ** 2
    moments = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(d * F.col("n")).alias("observed"), F.sum(F.col("n") * F.col("y_true")).alias("st"), F.sum(F.col("n") * F.col("y_pred")).alias("sp"),
        F.sum(F.col("n") * F.col("y_true") ** 2).alias("st2"), F.sum(F.col("n") * F.col("y_pred") ** 2).alias("sp2"),
    )
    # The expected squared difference of independent marginals needs only their first two moments.
    expected = F.try_divide(F.col("st2") + F.col("sp2"), F.col("n")) - 2 * F.try_divide(F.col("st") * F.col("sp"), F.col("n") * F.col("n"))
    return moments.select(*by, F.when(expected > 0, 1 - F.try_divide(F.try_divide("observed", "n"), expected)).alias("qwk"))


def evaluate(pred: DataFrame, by: list[str] | None = None, k: int = K, tail: tuple[int, ...] = (2, 3)) -> DataFrame:
    """by, n, accuracy, mae, balanced_accuracy, macro_f1, tail_recall, qwk."""
    by = by or []
    cells = confusion(pred, by, k)
    flat = cells.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n"), F.try_divide(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"),
        F.try_divide(F.sum(F.abs(F.col("y_true") - F.col("y_pred")) * F.col("n")), F.sum("n")).alias("mae"),
    )
    scores = class_scores(cells, by).groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("cls").isin(*tail), F.col("recall"))).alias("tail_recall"))
    kappa = qwk(cells, by)
    if by:
        return flat.join(scores, by).join(kappa, by)
    return flat.crossJoin(scores).crossJoin(kappa)


def calibration_error(pred: DataFrame, confidence: str, correct: str, by: list[str] | None = None, bins: int = 15) -> DataFrame:
    """by, ece: bins are (i / bins, (i + 1) / bins]; a confidence of 0 is in none. Edges are compared as they are, not by rounding up."""
    by = by or []
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    at = F.size(F.filter(edges, lambda e: e < F.col(confidence))) - 1
    binned = pred.withColumn("__bin", at).groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    total = F.sum("n")
    gap = F.sum(F.when((F.col("__bin") >= 0) & (F.col("__bin") < bins), F.col("n") * F.abs(F.col("a") - F.col("c"))).otherwise(0.0))
    return binned.groupBy(*by).agg(F.try_divide(gap, total).alias("ece"))


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """by, auc: by ranks, the mean rank among equals; null without one of the classes."""
    r = average_rank(df.withColumn("__pos", positive), by, score, "__r")
    s = r.groupBy(*by).agg(F.sum(F.when(F.col("__pos"), F.col("__r"))).alias("r"), F.count_if("__pos").alias("p"), F.count_if(~F.col("__pos")).alias("q"))
    return s.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def pearson(x: str, y: str) -> Column:
    """An aggregate: null where a column is constant."""
    d = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(d > 0, F.covar_pop(x, y) / F.when(d > 0, d))


def spearman(df: DataFrame, by: list[str], x: str, y: str, order: str | None = None) -> DataFrame:
    """by, rho, n: of average ranks, or with `order` of ordinal ranks, equals in that order. Null below 3 rows or for a constant column."""
    if order:
        r = ordinal_rank(ordinal_rank(df, by, x, order, "__x"), by, y, order, "__y")
    else:
        r = average_rank(average_rank(df, by, x, "__x"), by, y, "__y")
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(F.lit(1)) < 3)
    return r.groupBy(*by).agg(F.when(~flat, pearson("__x", "__y")).alias("rho"), F.count(F.lit(1)).alias("n"))

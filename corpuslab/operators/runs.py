"""Run records: flattening, shared arms, curves, trends, exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.operators.statistics import first_crossing, mean_ci, trend

_METRICS = "STRUCT<balanced_accuracy:DOUBLE, accuracy:DOUBLE, macro_f1:DOUBLE, mae:DOUBLE, qwk:DOUBLE, ece:DOUBLE, per_class_recall:MAP<STRING,DOUBLE>, n:INT>"
RUN = (
    "run_id STRING, arm STRING, config STRUCT<arm:STRING, mix_kind:STRING, synthetic_fraction:DOUBLE, real_budget_fraction:DOUBLE, synthetic_multiplier:DOUBLE, generator:STRING, pool:STRING, arch:STRING, init:STRING, seed:INT>, "
    f"provenance STRUCT<config_hash:STRING, dataset_hash:STRING, git_sha:STRING>, train_summary STRUCT<n:INT>, val {_METRICS}, test {_METRICS}, "
    "val_predictions STRUCT<images:ARRAY<STRING>, y_true:ARRAY<INT>, y_pred:ARRAY<INT>>"
)


def load_runs(spark: SparkSession, root: str, pattern: str = "run_*.json") -> DataFrame:
    """One row for each run_id, the first by path: flattened, with test metrics where there are any, else validation. NaN is null."""
    reader = spark.read.schema(RUN).options(multiLine=True, recursiveFileLookup=True, pathGlobFilter=pattern, allowNonNumericNumbers=True, mode="PERMISSIVE")
    return flatten(reader.json(root).withColumn("path", F.col("_metadata.file_path")))


def flatten(raw: DataFrame) -> DataFrame:
    def metric(name):
        v = F.coalesce(F.col(f"test.{name}"), F.col(f"val.{name}")) if name != "n" else F.coalesce("test.n", "val.n")
        return F.nanvl(v, F.lit(None).cast("double")).alias(name) if name != "n" else v.alias("n_eval")

    flat = raw.select(
        "run_id", F.coalesce("config.arm", "arm").alias("arm"), F.col("config.mix_kind").alias("mix_kind"), F.col("config.synthetic_fraction").alias("frac"),
        F.col("config.real_budget_fraction").alias("budget"), F.col("config.synthetic_multiplier").alias("k"), F.col("config.generator").alias("generator"), F.col("config.arch").alias("arch"),
        F.col("config.init").alias("init"), F.col("config.seed").alias("seed"), F.col("train_summary.n").alias("n_train"), F.when(F.col("test").isNotNull(), "test").otherwise("val").alias("split"),
        *[metric(m) for m in ("balanced_accuracy", "accuracy", "macro_f1", "mae", "qwk", "ece", "n")], "path",
    )
    return flat.withColumn("__rn", F.row_number().over(W.partitionBy("run_id").orderBy("path"))).where("__rn = 1 AND run_id IS NOT NULL").drop("__rn")


def expand_shared(runs: DataFrame, shared: str = "none") -> DataFrame:
    """Runs without a generator count for every generator there is; a null generator is one that isn't `shared`."""
    is_shared = F.col("generator").eqNullSafe(F.lit(shared))
    own = runs.where(~is_shared)
    # A row for each generator.
    names = own.select("generator").distinct()
    copies = runs.where(is_shared).drop("generator").crossJoin(F.broadcast(names))
    return own.unionByName(copies)


def summarise(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """by, n_seeds, n, point, lo, hi: null keys are kept as groups."""
    ci = mean_ci(runs, by, metric)
    seeds = runs.groupBy(*by).agg(F.count_distinct("seed").alias("n_seeds"))
    cond = [ci[k].eqNullSafe(seeds[k]) for k in by]
    return ci.join(seeds, cond).select(*[ci[k] for k in by], "n_seeds", "n", "point", "lo", "hi")


def on_grid(runs: DataFrame, cells: list[str], x: str, metric: str) -> DataFrame:
    """cells, seed, x, metric: every seed of a cell at every x of the cell; null where there was no run. Two runs at one point raise."""
    once = runs.groupBy(*cells, "seed", x).agg(F.count(F.lit(1)).alias("__n"), F.first(metric).alias(metric))
    once = once.withColumn(metric, F.when(F.col("__n") == 1, F.col(metric)).otherwise(F.raise_error(F.lit("two runs at one point of the grid")).cast("double"))).drop("__n")
    return runs.select(*cells, "seed").distinct().join(runs.select(*cells, x).distinct(), cells).join(once, [*cells, "seed", x], "left")


def substitution_trend(runs: DataFrame, metric: str, cells: list[str] | None = None) -> DataFrame:
    """The trend of a metric over the synthetic fraction in each (generator, init)."""
    cells = cells or ["generator", "init"]
    return trend(on_grid(expand_shared(runs), cells, "frac", metric), cells, "frac", metric)


def exchange_rates(runs: DataFrame, metric: str) -> DataFrame:
    """generator, init, budget, target_budget, target, k, reached: how many times its size in synthetic records a real budget needs to
    reach the next budget's baseline. The last budget has no target, and an undefined one is left out."""
    mean = runs.where(F.col(metric).isNotNull()).groupBy("generator", "init", "budget", "k").agg(F.avg(metric).alias("y"))
    base = mean.where("k = 0").select("generator", "init", "budget", F.col("y").alias("base"))
    w = W.partitionBy("generator", "init").orderBy("budget")
    targets = base.withColumn("target", F.lead("base").over(w)).withColumn("target_budget", F.lead("budget").over(w)).where(F.col("target").isNotNull())
    curve = mean.join(targets.drop("base"), ["generator", "init", "budget"])
    found = first_crossing(curve, ["generator", "init", "budget", "target_budget", "target"], "k", "y", "target")
    return found.select("generator", "init", "budget", "target_budget", "target", "k", "reached")


def matched_seeds(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """seed, a, b, kind: 'both', or the set that alone has the seed."""
    x, y = a.groupBy("seed").agg(F.avg(metric).alias("a")), b.groupBy("seed").agg(F.avg(metric).alias("b"))
    j = x.join(y, "seed", "full")
    return j.withColumn("kind", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both"))


def plot_points(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """by, mean, sem: the standard error counts at least one run."""
    g = runs.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))
    return g.select(*by, "mean", (F.col("sd") / F.sqrt(F.greatest("n", F.lit(1)))).alias("sem"))


def pending(planned: DataFrame, done: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs without a record."""
    return planned.join(done.select(key), key, "left_anti")


def smoke_verdict(trends: DataFrame, gap: float) -> DataFrame:
    """trends (slope, lo, hi) with `passed` and `reason`: with a gap between the processes the slope must fall, without one its
    interval must hold zero. A slope that isn't known passes neither."""
    ok = (F.col("slope") < 0) if gap > 0 else ((F.col("lo") <= 0) & (F.col("hi") >= 0))
    wanted = "a negative slope" if gap > 0 else "an interval that holds zero"
    passed = F.coalesce(ok, F.lit(False))
    return trends.withColumn("passed", passed).withColumn("reason", F.when(~F.col("passed"), F.lit(f"expected {wanted}")))

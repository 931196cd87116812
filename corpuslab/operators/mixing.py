"""Budget-matched mixtures, largest-remainder quotas, resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions.draws import draw, order_key
from corpuslab.functions.scalars import arm_name


class ShortageError(ValueError):
    """A class has fewer records than its quota."""


@dataclass(frozen=True)
class MixSpec:
    """One arm of a design: 'substitution', 'real_subset' or 'additive'."""

    kind: str
    synthetic_fraction: float = 0.0
    real_budget_fraction: float = 1.0
    synthetic_multiplier: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.kind not in ("substitution", "real_subset", "additive"):
            raise ValueError(f"unknown kind {self.kind}")
        if not 0 <= self.synthetic_fraction <= 1 or not 0 < self.real_budget_fraction <= 1 or self.synthetic_multiplier < 0:
            raise ValueError("a fraction is out of range")


def arms(spark: SparkSession, specs: list[MixSpec]) -> DataFrame:
    """One row for each spec, named: a sweep is one table."""
    rows = [(i, s.kind, s.synthetic_fraction, s.real_budget_fraction, s.synthetic_multiplier, s.seed) for i, s in enumerate(specs)]
    df = spark.createDataFrame(rows, "arm_id int, kind string, p double, rbf double, k double, seed int")
    return df.withColumn("arm", arm_name(F.col("kind"), F.col("p"), F.col("rbf"), F.col("k")))


def substitution_arms(fractions=(0.0, 0.25, 0.5, 0.75, 1.0), seed: int = 0) -> list[MixSpec]:
    return [MixSpec("substitution", f, seed=seed) for f in fractions]


def control_arms(fractions=(0.25, 0.5, 0.75), seed: int = 0) -> list[MixSpec]:
    return [MixSpec("real_subset", f, seed=seed) for f in fractions]


def additive_arms(budgets=(0.25, 0.5, 0.75, 1.0), multipliers=(0.0, 0.5, 1.0, 2.0, 4.0, 8.0), seed: int = 0) -> list[MixSpec]:
    return [MixSpec("additive", 0.0, b, k, seed) for b in budgets for k in multipliers]


def largest_remainder(weights: DataFrame, by: list[str], total: Column, weight: str = "n", item: str = "label", out: str = "quota") -> DataFrame:
    """Adds quotas that sum to the total within `by`: floors of the exact shares, and one more for the largest fractions, the first
    items among equals. All 0 if the total or the weights are. `by` and the items are a small design table."""
    w = W.partitionBy(*by)
    weight_sum = F.sum(weight).over(w)
    df = weights.withColumn("__total", total).withColumn("__exact", F.when((weight_sum > 0) & (F.col("__total") > 0), F.col("__total") * F.col(weight) / weight_sum).otherwise(0.0))
    df = df.withColumn("__floor", F.floor("__exact")).withColumn("__frac", F.round(F.col("__exact") - F.col("__floor"), 9))
    df = df.withColumn("__left", F.when((weight_sum > 0) & (F.col("__total") > 0), F.col("__total") - F.sum("__floor").over(w)).otherwise(0))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("__frac"), item))
    return df.withColumn(out, (F.col("__floor") + (rank <= F.col("__left")).cast("int")).cast("long")).drop("__total", "__exact", "__floor", "__frac", "__left")


def permutation(records: DataFrame, seed, by: list[str] | None = None, key: str = "ord", out: str = "rn") -> DataFrame:
    """Seeded ranks from 0 within `by`: a prefix of one length holds every shorter one."""
    return records.withColumn(out, F.row_number().over(W.partitionBy(*(by or [])).orderBy(order_key(seed, F.col(key)), key)) - 1)


def rotated(ranked: DataFrame, seed: int, n_seeds: int, by: list[str], rank: str = "rn") -> DataFrame:
    """Ranks turned by (seed mod n_seeds) blocks of size floor(n / n_seeds), so seeds start in different places of one permutation."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    offset = F.lit(seed % n_seeds) * F.floor(n / n_seeds)
    return ranked.withColumn(rank, F.pmod(F.col(rank) - offset, n))


def build_mixtures(real: DataFrame, pool: DataFrame, design: DataFrame, n_seeds: int = 5, strict: bool = True) -> DataFrame:
    """arm_id, arm, seed, part, ord, label: the records of each arm, all arms in one job.

    Both parts follow the real histogram. Real records come from a permutation by seed, synthetic ones from one permutation that
    the seed rotates. With `strict`, a class that is short of its quota raises ShortageError.
    """
    histogram = real.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = real.count()
    budget = F.bround(F.lit(total) * F.col("rbf"))
    n_real = F.when(F.col("kind") == "additive", budget).otherwise(F.bround(budget * (1 - F.col("p"))))
    n_synth = F.when(F.col("kind") == "additive", F.bround(budget * F.col("k"))).when(F.col("kind") == "substitution", budget - n_real).otherwise(0)
    sized = design.withColumn("n_real", n_real.cast("long")).withColumn("n_synth", n_synth.cast("long"))
    parts = sized.withColumn("part", F.explode(F.array(F.lit("real"), F.lit("synthetic")))).withColumn("want", F.when(F.col("part") == "real", F.col("n_real")).otherwise(F.col("n_synth")))
    # A row for each arm, part and class.
    quotas = largest_remainder(parts.crossJoin(F.broadcast(histogram)), ["arm_id", "part"], F.col("want"))
    quotas = quotas.select("arm_id", "arm", "seed", "part", "label", "quota")
    if strict:
        have = histogram.select(F.lit("real").alias("part"), "label", F.col("n").alias("have")).unionByName(pool.groupBy("label").agg(F.count(F.lit(1)).alias("have")).withColumn("part", F.lit("synthetic")))
        short = quotas.join(have, ["part", "label"], "left").where(F.col("quota") > F.coalesce("have", F.lit(0))).first()
        if short:
            raise ShortageError(f"{short['part']} records of class {short['label']}: {short['quota']} wanted, {short['have'] or 0} there")
        if quotas.groupBy("arm_id").agg(F.sum("quota").alias("q")).where("q = 0").first():
            raise ValueError("an arm is empty")
    seeds = design.select("seed").distinct()
    by = ["seed", "label"]
    own = permutation(real.select("ord", "label").crossJoin(F.broadcast(seeds)), F.col("seed"), by).withColumn("part", F.lit("real"))
    shared = permutation(pool.select("ord", "label"), "pool", ["label"]).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("label"))).crossJoin(F.broadcast(seeds))
    offset = (F.col("seed") % n_seeds) * F.floor(F.col("n") / n_seeds)
    shared = shared.withColumn("rn", F.pmod(F.col("rn") - offset, F.col("n"))).withColumn("part", F.lit("synthetic")).drop("n")
    ranked = own.unionByName(shared)
    return ranked.join(F.broadcast(quotas), ["seed", "label", "part"]).where(F.col("rn") < F.col("quota")).select("arm_id", "arm", "seed", "part", "ord", "label")


def resampled(records: DataFrame, target: DataFrame, seed, key: str = "ord") -> DataFrame:
    """label, draw, ord: records to a target histogram (label, want): without replacement where a class has enough, else with."""
    ranked = permutation(records, seed, ["label"], key).select(F.col("label"), F.col("rn"), F.col(key))
    sizes = records.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = target.join(sizes, "label").where("want > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") - 1)))
    wanted = wanted.withColumn("rn", F.when(F.col("want") <= F.col("n"), F.col("draw")).otherwise(draw(F.col("n"), seed, F.col("label"), F.col("draw"))))
    return wanted.join(ranked, ["label", "rn"]).select("label", "draw", key)

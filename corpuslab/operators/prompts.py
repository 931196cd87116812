"""Prompt designs and toy corpora: deterministic tables made from ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions.draws import draw, uniform
from corpuslab.operators.mixing import largest_remainder

# The axes of a prompt and how many values each has, the regimes, the shares of the classes of the toy corpus, and the least and
# greatest number of spots in each class.
AXES = {"age": 3, "sex": 2, "tone": 6, "view": 3, "light": 4, "distance": 3, "scene": 4}
REGIMES = ("plain", "diverse", "matched")
PRIOR = (0.40, 0.33, 0.19, 0.08)
BINS = ((0, 5), (6, 20), (21, 50), (51, 80))


def prompt_stream(spark: SparkSession, regime: str, seed: int, n: int) -> DataFrame:
    """i, seed, and a choice on each axis. A plain prompt takes the first value everywhere; a matched one varies only tone."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime}")
    df = spark.range(n).withColumnRenamed("id", "i").withColumn("seed", F.lit(seed) * 1000003 + F.col("i"))
    for axis, size in AXES.items():
        free = regime == "diverse" or regime == "matched" and axis == "tone"
        df = df.withColumn(axis, draw(size, seed, F.col("i"), axis) if free else F.lit(0).cast("long"))
    return df


def grid(spark: SparkSession) -> DataFrame:
    """All combinations of the axes."""
    one = spark.range(1).select()
    return reduce(lambda df, a: df.withColumn(a[0], F.explode(F.sequence(F.lit(0), F.lit(a[1] - 1)))), AXES.items(), one)


def coverage_prompts(spark: SparkSession, per_grade: int, tones: int = 6, scenes: int = 8) -> DataFrame:
    """Prompts that cycle through tones and scenes, interleaved so that every prefix is balanced over grades."""
    g = spark.range(4).withColumnRenamed("id", "grade").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_grade - 1).cast("long"))))
    return g.select("grade", "i", (F.col("i") % tones).alias("tone"), ((F.col("i") * 5 + F.col("grade")) % scenes).alias("scene"), (F.col("i") * 4 + F.col("grade") + 1).cast("int").alias("place"))


def balanced_design(spark: SparkSession, per_cell: int, tones: int = 6, substrates: int = 24) -> DataFrame:
    """grade, tone, i, substrate: each substrate as often as any other at each grade."""
    g = spark.range(4).withColumnRenamed("id", "grade").withColumn("tone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tones - 1).cast("long"))))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_cell - 1).cast("long"))))
    return g.withColumn("substrate", (F.col("i") + 7 * F.col("grade") + 3 * F.col("tone")) % substrates)


def toy_sizes(spark: SparkSession, n: int) -> DataFrame:
    prior = spark.createDataFrame([(i, p) for i, p in enumerate(PRIOR)], "label int, n double")
    return largest_remainder(prior, [], F.lit(n)).select("label", "quota")


def toy_latents(spark: SparkSession, per_class: int, seed: int = 0, gap: float = 0.0) -> DataFrame:
    """label, i, lesions: uniform within the class's bin, pulled towards the mean of all by `gap`."""
    bins = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(BINS)], "label int, lo int, hi int")
    df = bins.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_class - 1).cast("long"))))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * uniform(seed, F.col("label"), F.col("i"))
    mean = sum(p * (lo + hi) / 2 for p, (lo, hi) in zip(PRIOR, BINS))
    return df.select("label", "i", (value * (1 - gap) + mean * gap).alias("lesions"))


def filled(df: DataFrame, template: str, tokens: dict[str, list[str]], out: str = "prompt") -> DataFrame:
    """Adds the template with each {axis} replaced by the token that the axis column picks from a list."""
    text = F.lit(template)
    for axis, names in tokens.items():
        token = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(axis) + 1).cast("int"))
        text = F.replace(text, F.lit(f"{{{axis}}}"), token)
    return df.withColumn(out, text)

"""Skin-tone measures on pixel tables (img, px, r, g, b) with channels from 0 to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslab.functions import scalars as S

LEAST_PIXELS = 32
LUMINANCE = (0.2126729, 0.7151522, 0.0721750)


def estimate(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, n, ita, coverage, bin: the typology angle of the medians of L and b over skin-like pixels.

    Lit pixels have L between 15 and 95; below 32 of them all count. Of those, pixels redder than the 90th percentile are dropped, and
    below 32 left none are. Fewer than 32 pixels in all give null.
    """
    lightness, a, b = S.lab(F.col("r"), F.col("g"), F.col("b"))
    w = W.partitionBy(*by)
    p = pixels.select(*by, lightness.alias("L"), a.alias("a"), b.alias("bb"))
    lit = (F.col("L") > 15) & (F.col("L") < 95)
    p = p.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("lit", lit | (F.count_if(lit).over(w) < LEAST_PIXELS)).where("lit")
    p = p.withColumn("cut", F.percentile("a", 0.9).over(w))
    keep = F.col("a") <= F.col("cut")
    p = p.withColumn("keep", keep | (F.count_if(keep).over(w) < LEAST_PIXELS)).where("keep")
    m = p.groupBy(*by).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("kept"), F.percentile("L", 0.5).alias("L"), F.percentile("bb", 0.5).alias("bb"))
    angle = F.when(F.col("kept") >= LEAST_PIXELS, S.ita(F.col("L"), F.col("bb")))
    return m.select(*by, "n", angle.alias("ita"), (F.col("kept") / F.col("n")).alias("coverage"), S.tone_bin(angle).alias("bin"), (F.col("bb") <= 0).alias("degenerate"))


def exposed(pixels: DataFrame, stops: list[float]) -> DataFrame:
    """Every pixel at every exposure, with `ev`."""
    ev = F.explode(F.array(*[F.lit(float(s)) for s in stops]))
    p = pixels.withColumn("ev", ev)
    return p.withColumns({c: F.when(F.col("ev") == 0, F.col(c)).otherwise(S.expose(F.col(c), F.col("ev"))) for c in ("r", "g", "b")})


def grey_world(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Channels balanced to one mean in linear light, then the 90th percentile of luminance set to 0.7."""
    w = W.partitionBy(*by)
    linear = pixels.withColumns({c: S.srgb_to_linear(F.col(c)) for c in ("r", "g", "b")})
    means = {f"m_{c}": F.greatest(F.avg(c).over(w), F.lit(1e-6)) for c in ("r", "g", "b")}
    linear = linear.withColumns(means).withColumn("grey", (F.col("m_r") + F.col("m_g") + F.col("m_b")) / 3)
    linear = linear.withColumns({c: F.col(c) * F.col("grey") / F.col(f"m_{c}") for c in ("r", "g", "b")})
    lum = sum(k * F.col(c) for k, c in zip(LUMINANCE, ("r", "g", "b")))
    linear = linear.withColumn("lum", lum).withColumn("p90", F.percentile("lum", 0.9).over(w))
    gain = F.when(F.col("p90") > 1e-6, 0.7 / F.when(F.col("p90") > 1e-6, F.col("p90"))).otherwise(1.0)
    return linear.withColumns({c: S.linear_to_srgb(F.col(c) * gain) for c in ("r", "g", "b")}).drop("m_r", "m_g", "m_b", "grey", "lum", "p90")


def sensitivity(wide: DataFrame, base: str, variants: list[str], key: str) -> DataFrame:
    """One row for each variant: mean, mean absolute and greatest change of the angle, and the share of rows whose bin flips; variant
    'any' has the share that flips under one of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("x")) for v in variants]))
    long = wide.select(key, F.col(base).alias("b"), pairs.alias("p")).select(key, "b", "p.variant", (F.col("p.x") - F.col("b")).alias("d"), (S.tone_bin(F.col("p.x")) != S.tone_bin(F.col("b"))).alias("flip"))
    each = long.groupBy("variant").agg(F.avg("d").alias("mean"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("greatest"), F.avg(F.col("flip").cast("double")).alias("flips"))
    anyone = long.groupBy(key).agg(F.bool_or("flip").alias("flip")).agg(F.avg(F.col("flip").cast("double")).alias("flips"))
    empty = F.lit(None).cast("double")
    return each.unionByName(anyone.select(F.lit("any").alias("variant"), empty.alias("mean"), empty.alias("mean_abs"), empty.alias("greatest"), "flips"))


def coverage_summary(df: DataFrame, angle: str) -> DataFrame:
    """n, median, iqr, range, darkest_share, evenness: entropy of the six bins over its greatest value."""
    n = df.where(F.col(angle).isNotNull()).groupBy(S.tone_bin(F.col(angle)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy())
    h = n.withColumn("p", p).agg(F.sum(-F.col("p") * F.log("p")).alias("h"), F.coalesce(F.max(F.when(F.col("bin") == "dark", F.col("p"))), F.lit(0.0)).alias("dark"))
    q = lambda x: F.percentile(angle, x)
    s = df.agg(F.count(angle).alias("n"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), (F.max(angle) - F.min(angle)).alias("range"))
    return s.crossJoin(h).select("n", "median", "iqr", "range", F.col("dark").alias("darkest_share"), (F.col("h") / F.log(F.lit(6.0))).alias("evenness"))

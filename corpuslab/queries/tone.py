"""Tone measures on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import scalars as S
from corpuslab.operators import tone as N
from corpuslab.queries import views as V
from corpuslab.queries.views import sql
from corpuslab.registry import query

_LIN = "CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE (({c} + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END"
_ENC = "CASE WHEN {c} <= 0.0031308::DOUBLE THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * {c} ** (1 / 2.4::DOUBLE) - 0.055::DOUBLE END"


def _lab(src: str, keys: str = "img, px") -> str:
    """CTEs lin, xyz and lab over a relation with r, g, b."""
    f = "CASE WHEN {v} > 216 / 24389::DOUBLE THEN cbrt({v}) ELSE (24389 / 27::DOUBLE * {v} + 16) / 116 END"
    return (
        f"lin AS (SELECT {keys}, {', '.join(_LIN.format(c=c) + f' AS {c}' for c in 'rgb')} FROM {src}), "
        f"xyz AS (SELECT {keys}, (0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y, (0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b) / 1.08883::DOUBLE AS z FROM lin), "
        f"lab AS (SELECT {keys}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (SELECT {keys}, {f.format(v='x')} AS fx, {f.format(v='y')} AS fy, {f.format(v='z')} AS fz FROM xyz))"
    )


_BIN = "CASE WHEN {v} IS NULL THEN NULL WHEN {v} >= 55 AND {v} < 90 THEN 'very_light' WHEN {v} >= 41 AND {v} < 55 THEN 'light' WHEN {v} >= 28 AND {v} < 41 THEN 'intermediate' WHEN {v} >= 10 AND {v} < 28 THEN 'tan' WHEN {v} >= -30 AND {v} < 10 THEN 'brown' ELSE 'dark' END"


def _est(keys: str) -> str:
    """CTE est over lab: the typology angle by keys."""
    return (
        f"lit AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, count(*) FILTER (l > 15 AND l < 95) OVER (PARTITION BY {keys}) AS nl FROM lab) WHERE (l > 15 AND l < 95) OR nl < 32), "
        f"cuts AS (SELECT {keys}, quantile_cont(a, 0.9) AS cut FROM lit GROUP BY ALL), kept AS (SELECT * FROM (SELECT lit.*, a <= cut AS ok, count(*) FILTER (a <= cut) OVER (PARTITION BY {keys}) AS nk FROM lit JOIN cuts USING ({keys})) WHERE ok OR nk < 32), "
        f"est AS (SELECT {keys}, any_value(n) AS n, CASE WHEN count(*) >= 32 THEN degrees(atan2(quantile_cont(l, 0.5) - 50, greatest(quantile_cont(bb, 0.5), 1e-6))) END AS ita, count(*) / any_value(n) AS coverage FROM kept GROUP BY ALL)"
    )


_P = sql("v_pixels", body="").rstrip()


@query("fn8_lab", _P + ", " + _lab("v_pixels") + " SELECT px, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS bb FROM lab")
def _(spark, sf):
    l, a, b = S.lab(F.col("r"), F.col("g"), F.col("b"))
    return V.v_pixels(spark, sf).select("px", F.round(l, 6).alias("l"), F.round(a, 6).alias("a"), F.round(b, 6).alias("bb"))


@query("fn9_redness", _P + ", lin AS (SELECT px, " + ", ".join(_LIN.format(c=c) + f" AS {c}" for c in "rgb") + " FROM v_pixels), xy AS (SELECT px, (0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM lin) SELECT px, round(500 * (CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787::DOUBLE * x + 16 / 116::DOUBLE END - CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787::DOUBLE * y + 16 / 116::DOUBLE END), 6) AS a FROM xy")
def _(spark, sf):
    return V.v_pixels(spark, sf).select("px", F.round(S.redness(F.col("r"), F.col("g"), F.col("b")), 6).alias("a"))


@query("fn10_ita", _P + ", " + _lab("v_pixels") + " SELECT px, round(degrees(atan2(l - 50, greatest(bb, 1e-6))), 6) AS ita, bb <= 0 AS degenerate FROM lab")
def _(spark, sf):
    l, _, b = S.lab(F.col("r"), F.col("g"), F.col("b"))
    p = V.v_pixels(spark, sf).select("px", l.alias("l"), b.alias("b"))
    return p.select("px", F.round(S.ita(F.col("l"), F.col("b")), 6).alias("ita"), (F.col("b") <= 0).alias("degenerate"))


_ANGLES = "(SELECT o_orderkey AS k, (o_orderkey % 2000) / 10.0::DOUBLE - 100 AS v FROM orders)"


@query("fn11_tone_bins", f"SELECT k, {_BIN.format(v='v')} AS bin, CASE {_BIN.format(v='v')} WHEN 'very_light' THEN 'light' WHEN 'light' THEN 'light' WHEN 'intermediate' THEN 'intermediate' WHEN 'tan' THEN 'intermediate' ELSE 'dark' END AS coarse FROM {_ANGLES}")
def _(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 2000) / 10.0 - 100).alias("v"))
    return a.select("k", S.tone_bin(F.col("v")).alias("bin")).withColumn("coarse", S.tone_coarse(F.col("bin")))


@query("fn11b_tone_bins_open", f"SELECT k, CASE WHEN v >= 55 THEN 'very_light' ELSE {_BIN.format(v='v')} END AS bin FROM {_ANGLES}")
def _(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 2000) / 10.0 - 100).alias("v"))
    return a.select("k", S.tone_bin_open(F.col("v")).alias("bin"))


@query("fn12_exposure", _P + ", e AS (SELECT px, least(greatest((" + _LIN.format(c="r") + ") * 2 ** 0.5::DOUBLE, 0), 1) AS x FROM v_pixels) SELECT px, round(" + _ENC.format(c="x") + ", 9) AS r FROM e")
def _(spark, sf):
    return V.v_pixels(spark, sf).select("px", F.round(S.expose(F.col("r"), F.lit(0.5)), 9).alias("r"))


@query("fn13_grey_world", _P + ", lin AS (SELECT img, px, " + ", ".join(_LIN.format(c=c) + f" AS {c}" for c in "rgb") + " FROM v_pixels), m AS (SELECT img, greatest(avg(r), 1e-6) AS mr, greatest(avg(g), 1e-6) AS mg, greatest(avg(b), 1e-6) AS mb FROM lin GROUP BY 1), w AS (SELECT img, px, r * (mr + mg + mb) / 3 / mr AS r, g * (mr + mg + mb) / 3 / mg AS g, b * (mr + mg + mb) / 3 / mb AS b FROM lin JOIN m USING (img)), q AS (SELECT img, quantile_cont(0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b, 0.9) AS p FROM w GROUP BY 1), e AS (SELECT px, least(greatest(r * CASE WHEN p > 1e-6 THEN 0.7 / p ELSE 1 END, 0), 1) AS x FROM w JOIN q USING (img)) SELECT px, round(" + _ENC.format(c="x") + ", 6) AS r FROM e")
def _(spark, sf):
    return N.grey_world(V.v_pixels(spark, sf), ["img"]).select("px", F.round("r", 6).alias("r"))


@query("fn14_naive_exposure", _P + " SELECT px, round(least(greatest(r * 2 ** -0.5::DOUBLE, 0), 1), 9) AS r FROM v_pixels")
def _(spark, sf):
    return V.v_pixels(spark, sf).select("px", F.round(S.expose_naive(F.col("r"), F.lit(-0.5)), 9).alias("r"))


_GRP = "p2 AS (SELECT img % 20 AS img, px, r, g, b FROM v_pixels)"


def _images(spark, sf):
    return V.v_pixels(spark, sf).withColumn("img", F.col("img") % 20)


@query("ton1_estimate", _P + f", {_GRP}, " + _lab("p2") + ", " + _est("img") + f" SELECT img, n, round(ita, 6) AS ita, round(coverage, 9) AS coverage, {_BIN.format(v='ita')} AS bin FROM est")
def _(spark, sf):
    e = N.estimate(_images(spark, sf), ["img"])
    return e.select("img", "n", F.round("ita", 6).alias("ita"), F.round("coverage", 9).alias("coverage"), "bin")


_EV = "ev AS (SELECT * FROM (VALUES (-0.5::DOUBLE), (0.0), (0.5)) x(ev)), ex0 AS (SELECT img, px, ev, " + ", ".join(f"least(greatest(({_LIN.format(c=c)}) * 2 ** ev, 0), 1) AS {c}" for c in "rgb") + " FROM p2, ev), ex AS (SELECT ex0.img, ex0.px, ex0.ev, " + ", ".join(f"CASE WHEN ex0.ev = 0 THEN p2.{c} ELSE {_ENC.format(c=f'ex0.{c}')} END AS {c}" for c in "rgb") + " FROM ex0 JOIN p2 USING (px))"


@query("ton5_variants", _P + f", {_GRP}, {_EV}, " + _lab("ex", "img, px, ev") + ", " + _est("img, ev") + " SELECT img, ev, round(ita, 6) AS ita FROM est")
def _(spark, sf):
    return N.estimate(N.exposed(_images(spark, sf), [-0.5, 0.0, 0.5]), ["img", "ev"]).select("img", "ev", F.round("ita", 6).alias("ita"))


@query("ton2_tone_strata", _P + f", {_GRP}, " + _lab("p2") + ", " + _est("img") + f" SELECT {_BIN.format(v='ita')} AS bin, count(*) AS n FROM est GROUP BY 1")
def _(spark, sf):
    return N.estimate(_images(spark, sf), ["img"]).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("ton3_sensitivity", _P + f", {_GRP}, {_EV}, " + _lab("ex", "img, px, ev") + ", " + _est("img, ev") + ", w AS (SELECT a.img, a.ita AS b, c.ev, c.ita - a.ita AS d, " + f"{_BIN.format(v='c.ita')} <> {_BIN.format(v='a.ita')}" + " AS flip FROM est a JOIN est c ON a.img = c.img AND a.ev = 0 AND c.ev <> 0) SELECT CASE WHEN ev < 0 THEN 'm05' ELSE 'p05' END AS variant, round(avg(d), 6) AS mean, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS greatest, round(avg(flip::INT::DOUBLE), 9) AS flips FROM w GROUP BY 1 UNION ALL SELECT 'any', NULL, NULL, NULL, round(avg(f::INT::DOUBLE), 9) FROM (SELECT img, bool_or(flip) AS f FROM w GROUP BY 1)")
def _(spark, sf):
    e = N.estimate(N.exposed(_images(spark, sf), [-0.5, 0.0, 0.5]), ["img", "ev"])
    at = lambda v: F.max(F.when(F.col("ev") == v, F.col("ita")))
    wide = e.groupBy("img").agg(at(0.0).alias("base"), at(-0.5).alias("m05"), at(0.5).alias("p05"))
    s = N.sensitivity(wide, "base", ["m05", "p05"], "img")
    return s.select("variant", *[F.round(c, 6).alias(c) for c in ("mean", "mean_abs", "greatest")], F.round("flips", 9).alias("flips"))


@query("ton4_degenerate_share", _P + ", " + _lab("v_pixels") + " SELECT count(*) AS n, round(avg((bb <= 0)::INT::DOUBLE), 9) AS share, round(avg(l) FILTER (bb > 0), 6) AS mean_l FROM lab")
def _(spark, sf):
    l, _, b = S.lab(F.col("r"), F.col("g"), F.col("b"))
    p = V.v_pixels(spark, sf).select(l.alias("l"), b.alias("b"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("b") <= 0).cast("double")), 9).alias("share"), F.round(F.avg(F.when(F.col("b") > 0, F.col("l"))), 6).alias("mean_l"))


@query("aud11_coverage_summary", _P + ", " + _lab("v_pixels") + f", e AS (SELECT degrees(atan2(l - 50, greatest(bb, 1e-6))) AS ita FROM lab), b AS (SELECT {_BIN.format(v='ita')} AS bin, count(*) AS n FROM e GROUP BY 1), h AS (SELECT sum(-p * ln(p)) AS h, coalesce(max(p) FILTER (bin = 'dark'), 0) AS dark FROM (SELECT bin, n / sum(n) OVER () AS p FROM b)) SELECT count(*) AS n, round(quantile_cont(ita, 0.5), 6) AS median, round(quantile_cont(ita, 0.75) - quantile_cont(ita, 0.25), 6) AS iqr, round(max(ita) - min(ita), 6) AS range, round(any_value(dark), 9) AS darkest_share, round(any_value(h) / ln(6), 9) AS evenness FROM e, h")
def _(spark, sf):
    l, _, b = S.lab(F.col("r"), F.col("g"), F.col("b"))
    p = V.v_pixels(spark, sf).select(l.alias("l"), b.alias("b")).select(S.ita(F.col("l"), F.col("b")).alias("ita"))
    c = N.coverage_summary(p, "ita")
    return c.select("n", *[F.round(x, 6).alias(x) for x in ("median", "iqr", "range")], F.round("darkest_share", 9).alias("darkest_share"), F.round("evenness", 9).alias("evenness"))

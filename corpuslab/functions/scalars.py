"""Scalar functions on columns. Undefined results are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cases(value: Column, limits, names, strict: bool = True) -> Column:
    """The name of the first limit that the value is below (or at most, if not strict); the last name otherwise."""
    out = None
    for limit, name in zip(limits, names):
        test = value < limit if strict else value <= limit
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.when(value.isNotNull(), out.otherwise(F.lit(names[-1])))


def severity_band(count: Column) -> Column:
    """Lesion count to grade: up to 5, 20, 50, more."""
    return cases(count, (5, 20, 50), (0, 1, 2, 3), strict=False).cast("int")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval of k in n; null where n is 0."""
    n = F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def percent3(fraction: Column) -> Column:
    """A fraction as three digits of percent, rounding half to even."""
    return F.lpad(F.bround(fraction * 100).cast("int").cast("string"), 3, "0")


def general(value: Column) -> Column:
    """A number in its shortest usual form: 2.0 is 2, 0.5 is 0.5."""
    return F.regexp_replace(F.regexp_replace(value.cast("double").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def arm_name(kind: Column, fraction: Column, budget: Column, multiplier: Column) -> Column:
    """sub_p025, realonly_p050, add_n050_k2."""
    add = F.concat(F.lit("add_n"), percent3(budget), F.lit("_k"), general(multiplier))
    return F.when(kind == "substitution", F.concat(F.lit("sub_p"), percent3(fraction))).when(kind == "real_subset", F.concat(F.lit("realonly_p"), percent3(fraction))).when(kind == "additive", add)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def srgb_to_linear(c: Column) -> Column:
    """A channel from 0 to 1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    c = F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


# sRGB to XYZ under D65, the white point, and the constants of CIE Lab.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LAB_EPSILON, LAB_KAPPA = 216 / 24389, 24389 / 27
# The rounded constants of the redness measure.
XYZ_SHORT = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a, b of sRGB channels from 0 to 1."""
    linear = [srgb_to_linear(c) for c in (r, g, b)]
    xyz = [reduce(lambda x, y: x + y, [w * c for w, c in zip(row, linear)]) / white for row, white in zip(XYZ, WHITE)]
    f = [F.when(v > LAB_EPSILON, F.cbrt(v)).otherwise((LAB_KAPPA * v + 16) / 116) for v in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def redness(r: Column, g: Column, b: Column) -> Column:
    """a of Lab by the rounded constants."""
    linear = [srgb_to_linear(c) for c in (r, g, b)]
    x, y = (reduce(lambda p, q: p + q, [w * c for w, c in zip(XYZ_SHORT[i], linear)]) / WHITE[i] for i in (0, 1))
    f = [F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in (x, y)]
    return 500 * (f[0] - f[1])


def ita(lightness: Column, b: Column) -> Column:
    """Individual typology angle in degrees."""
    return F.degrees(F.atan2(lightness - 50, F.greatest(b, F.lit(1e-6))))


# Limits of the typology angle, lightest last, and the coarse groups.
TONES = ((-30.0, "dark"), (10.0, "brown"), (28.0, "tan"), (41.0, "intermediate"), (55.0, "light"), (90.0, "very_light"))


def tone_bin(angle: Column) -> Column:
    """The bin [low, high) of an angle; dark below all and from 90 on."""
    out = F.when((angle >= 90.0) | (angle < -30.0), "dark")
    for (low, _), (high, name) in zip(TONES[:-1], TONES[1:]):
        out = out.when((angle >= low) & (angle < high), name)
    return out


def tone_bin_open(angle: Column) -> Column:
    """As tone_bin, but very light from 55 on without an end."""
    return F.when(angle >= 55.0, "very_light").otherwise(tone_bin(angle))


def tone_coarse(name: Column) -> Column:
    return F.when(name.isin("very_light", "light"), "light").when(name.isin("intermediate", "tan"), "intermediate").when(name.isin("brown", "dark"), "dark")


def expose(c: Column, stops: Column) -> Column:
    """A channel exposed by so many stops in linear light."""
    return linear_to_srgb(srgb_to_linear(c) * F.pow(F.lit(2.0), stops))


def expose_naive(c: Column, stops: Column) -> Column:
    """The same on the encoded channel, clipped."""
    return F.greatest(F.least(c * F.pow(F.lit(2.0), stops), F.lit(1.0)), F.lit(0.0))


def stops_tag(stops: Column) -> Column:
    """-0.5 is m05, 0.3 is p03."""
    return F.concat(F.when(stops < 0, "m").otherwise("p"), F.lpad(F.bround(F.abs(stops) * 10).cast("int").cast("string"), 2, "0"))


def discriminability_note(auc: Column) -> Column:
    return F.when(auc >= 0.99, "trivially separable").when(auc >= 0.90, "easily separable").when(auc >= 0.70, "partly separable").when(auc.isNotNull(), "hard to separate")


def release_note(rate: Column) -> Column:
    return F.when(rate >= 0.05, "do not release").when(rate >= 0.01, "review matches").when(rate.isNotNull(), "no concern")


def fitzpatrick(prompt: Column) -> Column:
    """The skin type that a prompt names, in Roman numerals; empty if none."""
    return F.regexp_extract(prompt, r"Fitzpatrick (I{1,3}V?|IV|VI?)\b", 1)


def generator_label(kind: Column, n_synthetic: Column, configured: Column) -> Column:
    return F.when(kind == "real_subset", "real_subset").when(n_synthetic == 0, "none").otherwise(configured)


def object_hash(fields: dict[str, Column]) -> Column:
    """16 hex digits of the SHA-256 of an object as JSON with sorted keys, spaces after commas and colons. Strings are written without escapes."""

    def value(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("null")).otherwise(F.when(F.typeof(c) == "string", F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string")))

    body = [x for i, (k, c) in enumerate(sorted(fields.items())) for x in (F.lit(("" if not i else ", ") + f'"{k}": '), value(c))]
    return F.substring(F.sha2(F.concat(F.lit("{"), *body, F.lit("}")), 256), 1, 16)

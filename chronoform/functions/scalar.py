"""Scalar and array expressions on columns; nothing here starts a job or a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """x within [lo, hi]; a bound of None does not bind."""
    x = x if hi is None else F.least(x, hi if isinstance(hi, Column) else F.lit(hi))
    return x if lo is None else F.greatest(x, lo if isinstance(lo, Column) else F.lit(lo))


def combined_change(pixel, histogram, luminance, edge) -> Column:
    """Weighted change of a row, at most 1."""
    return F.least(F.lit(1.0), 0.45 * col(pixel) + 0.35 * col(histogram) + 0.12 * col(luminance) + 0.08 * col(edge))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    """Mean of an array of doubles; null if it is empty."""
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def pairwise(a: Column, b: Column, f) -> Column:
    """Sum of f over the elements of two arrays."""
    return total(F.zip_with(a, b, f))


def bhattacharyya(a, b) -> Column:
    """Distance of two histograms, 0 to 1."""
    a, b = col(a), col(b)
    overlap = pairwise(a, b, lambda x, y: F.sqrt(x * y)) / F.sqrt(total(a) * total(b))
    return F.sqrt(clamp(1 - overlap, 0.0, 1.0))


def entropy(counts: Column) -> Column:
    """Base-2 entropy of an array of counts; empty bins do not count."""
    n = total(F.transform(counts, lambda c: c.cast("double")))
    return -total(F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / n * F.log2(c / n)))


def dhash_bits(raster, width: int, height: int) -> Column:
    """One bit for each horizontal neighbour pair: 1 if the right one is brighter."""
    raster = col(raster)
    at = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])
    return F.transform(at, lambda i: (F.get(raster, i + 1) > F.get(raster, i)).cast("int"))


def hamming(a, b) -> Column:
    """Number of places at which two bit arrays differ."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def global_ssim(a, b, span: float = 255.0) -> Column:
    """Structural similarity over one window, with population variances."""
    a, b = col(a), col(b)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb, n = mean(a), mean(b), F.size(a)
    va = total(F.transform(a, lambda x: (x - ma) * (x - ma))) / n
    vb = total(F.transform(b, lambda x: (x - mb) * (x - mb))) / n
    cov = pairwise(a, b, lambda x, y: (x - ma) * (y - mb)) / n
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def frame_time(seq, numerator, denominator, mapped=None) -> Column:
    """Seconds of a frame: the timestamp map's if there is one, else by the exact rate."""
    plain = col(seq) * col(denominator) / col(numerator)
    return plain if mapped is None else F.coalesce(col(mapped), plain)


def angle_delta(a, b) -> Column:
    """Shortest signed turn from b to a, in degrees, within [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0


def easing(name: str, p) -> Column:
    """A named easing curve of progress p, which is kept within [0, 1]."""
    p = clamp(col(p), 0.0, 1.0)
    if name == "hold":
        return F.lit(0.0) * p
    if name == "linear":
        return p
    if name == "ease_in":
        return p * p
    if name == "ease_out":
        return 1 - (1 - p) * (1 - p)
    if name == "ease_in_out":
        return 3 * p * p - 2 * p * p * p
    if name == "hermite":  # end slopes .68 and .12
        return (p * p * p - 2 * p * p + p) * 0.68 + (-2 * p * p * p + 3 * p * p) + (p * p * p - p * p) * 0.12
    if name == "overshoot":
        s = 1.70158
        return 1 + (s + 1) * F.pow(p - 1, F.lit(3.0)) + s * F.pow(p - 1, F.lit(2.0))
    if name == "settle":
        end = 1 - float(np.exp(-6.0) * (np.cos(3 * np.pi) + 0.2 * np.sin(3 * np.pi)))
        return (1 - F.exp(-6.0 * p) * (F.cos(3 * np.pi * p) + 0.2 * F.sin(3 * np.pi * p))) / end
    raise ValueError(f"no easing named {name}")


def bezier_knots(x1: float, x2: float, n: int = 256) -> list[float]:
    """The parameter at which a cubic Bezier easing has come to i / n of its way, for each i, by bisection."""
    out = []
    for i in range(n + 1):
        lo, hi = 0.0, 1.0
        for _ in range(50):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if 3 * (1 - t) ** 2 * t * x1 + 3 * (1 - t) * t**2 * x2 + t**3 < i / n else (lo, t)
        out.append((lo + hi) / 2)
    return out


def bezier_easing(x1: float, y1: float, x2: float, y2: float, steps: int = 3) -> Callable[[Column], Column]:
    """A cubic Bezier easing as a function of progress: the parameter between two knots of a table, refined by Newton steps, then its height. No Python."""
    knots = bezier_knots(x1, x2)
    table = F.expr("array(" + ", ".join(f"{t!r}D" for t in knots) + ")")

    def refined(t: Column, p: Column) -> Column:
        x = 3 * (1 - t) * (1 - t) * t * x1 + 3 * (1 - t) * t * t * x2 + t * t * t
        slope = 3 * (1 - t) * (1 - t) * x1 + 6 * (1 - t) * t * (x2 - x1) + 3 * t * t * (1 - x2)
        return clamp(t - F.when(F.abs(slope) < 1e-9, 0.0).otherwise((x - p) / slope), 0.0, 1.0)

    def ease(progress: Column) -> Column:
        p = clamp(progress, 0.0, 1.0)
        at = F.least(F.floor(p * (len(knots) - 1)), F.lit(len(knots) - 2)).cast("int")
        t = F.array(F.get(table, at) + (F.get(table, at + 1) - F.get(table, at)) * (p * (len(knots) - 1) - at))  # arrays of one, so that each step is worked out once
        for _ in range(steps):
            t = F.transform(t, lambda x: refined(x, p))
        return F.get(F.transform(t, lambda x: 3 * (1 - x) * (1 - x) * x * y1 + 3 * (1 - x) * x * x * y2 + x * x * x), F.lit(0))

    return ease


def matrix_parameters(m, source_width, source_height, frame_width, frame_height) -> Column:
    """A 3 x 3 matrix (array of 9, by rows) as centre, scale against contain, rotation, anisotropy, shear and perspective.

    The linear part is taken at the source's centre; its singular values and polar rotation are in closed form.
    """
    m = col(m)
    at = [F.get(m, F.lit(i)) for i in range(9)]
    sw, sh, fw, fh = (col(x).cast("double") for x in (source_width, source_height, frame_width, frame_height))
    x, y = sw / 2, sh / 2
    nx, ny, d = at[0] * x + at[1] * y + at[2], at[3] * x + at[4] * y + at[5], at[6] * x + at[7] * y + at[8]
    a, b = (at[0] * d - nx * at[6]) / (d * d), (at[1] * d - nx * at[7]) / (d * d)
    c, e = (at[3] * d - ny * at[6]) / (d * d), (at[4] * d - ny * at[7]) / (d * d)
    q, r = F.hypot(a + e, c - b) / 2, F.hypot(a - e, c + b) / 2  # singular values are q + r and |q - r|
    norms = F.hypot(a, c) * F.hypot(b, e)
    rotation = F.atan2(c - b, a + e)  # of the nearest rotation, also of a mirroring matrix, whose smaller singular direction is turned over
    return F.struct(
        (nx / d / fw).alias("center_x"),
        (ny / d / fh).alias("center_y"),
        (F.sqrt(F.abs(a * e - b * c)) / F.least(fw / sw, fh / sh)).alias("scale"),
        F.degrees(rotation).alias("rotation"),
        (F.abs((q + r) - F.abs(q - r)) / F.greatest(F.lit(1e-12), ((q + r) + F.abs(q - r)) / 2)).alias("anisotropy"),
        (F.abs(a * b + c * e) / F.greatest(F.lit(1e-12), norms)).alias("shear"),
        F.hypot(at[6] * sw, at[7] * sh).alias("perspective"),
    )


def recovery_confidence(inlier_ratio, matches, rmse) -> Column:
    """Confidence of a fitted row from its inliers, matches and residual."""
    return clamp(0.42 * col(inlier_ratio) + 0.28 * F.least(F.lit(1.0), col(matches) / 120.0) + 0.30 * F.exp(-col(rmse) / 2.5), 0.0, 1.0)


def select_model(rmse, median, inlier, perspective, perspective_gain, anisotropy, shear, affine_gain, similarity_rmse, similarity_inlier) -> Column:
    """The simplest motion model that the fits support; unknown if none is good enough."""
    bad = (col(rmse) > 2.35) | (col(median) > 1.75) | (col(inlier) < 0.38)
    return (
        F.when(bad, "unknown")
        .when((col(perspective) >= 0.012) & (col(perspective_gain) >= 0.08), "homography")
        .when(((col(anisotropy) >= 0.025) | (col(shear) >= 0.025)) & (col(affine_gain) >= 0.08), "affine")
        .when((col(similarity_rmse) > 2.35) | (col(similarity_inlier) < 0.38), "unknown")
        .otherwise("similarity")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def canonical_hash(*fields: Column | str, names: tuple[str, ...] | None = None) -> Column:
    """SHA-256 of compact JSON of the fields as text, sorted by name, so that no two different rows read alike; null is null.

    Columns given by expression need ``names``.
    """
    named = sorted(zip(names or fields, map(col, fields), strict=True), key=lambda x: x[0])
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in named]), {"ignoreNullFields": "false"}), 256)


def stripped(value: Column, kind: DataType, volatile: frozenset[str], constants: dict[str, str]) -> Column:
    """A value as text in its own structure, at any depth without the volatile fields and with constants in place of references; fields sorted."""
    if isinstance(kind, StructType):
        kept = sorted((f for f in kind.fields if f.name not in volatile), key=lambda f: f.name)
        inner = [(F.lit(constants[f.name]) if f.name in constants else stripped(value.getField(f.name), f.dataType, volatile, constants)).alias(f.name) for f in kept]
        return F.when(value.isNotNull(), F.struct(*inner)) if inner else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: stripped(x, kind.elementType, volatile, constants))
    return value.cast("string")


def normalize_words(text) -> Column:
    """Lower-cased runs of letters, digits and underscores, joined by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def normalize_letters(text) -> Column:
    """Lower case, the letter yo as ye, and everything but letters and digits dropped between words."""
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(col(text)), "ё", "е"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")

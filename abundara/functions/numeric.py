"""Column functions for numbers and statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
#: Coefficients of Abramowitz and Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Weights of the combined deviation score.
WEIGHT_ABUNDANCE, WEIGHT_FOLD, WEIGHT_PERCENTILE = 0.40, 0.45, 0.15


def clamp_limit(n: int | None, default: int, cap: int) -> int:
    """Limits of zero and below mean the default."""
    return default if n is None or n <= 0 else min(n, cap)


def rounded(c: Column, digits: int) -> Column:
    """Rounded as SQL engines over binary floats do it: scaled, to the nearest whole number, and back. F.round goes by the shortest decimal text, so 1.005 is 1.01 there and 1.0 here."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def to_double(c: Column) -> Column:
    """Thousands separators dropped; what isn't a number is 0."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double"), F.lit(0.0))


def to_long(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def bucketize(c: Column, edges: Sequence[tuple[int, int, str]], otherwise: str) -> Column:
    """Label of the first inclusive range that holds the value; nulls and the rest get `otherwise`."""
    out: Column | None = None
    for low, high, label in edges:
        out = F.when(c.between(low, high), label) if out is None else out.when(c.between(low, high), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


AGE_BRACKETS = ((0, 10, "0-10"), (11, 20, "11-20"), (21, 30, "21-30"), (31, 40, "31-40"), (41, 50, "41-50"), (51, 60, "51-60"))
AGE_REST = "60+"


def ratio_to(value: Column, reference: Column) -> Column:
    """Infinite where there is something to compare and the reference is zero; 1 where both are."""
    return F.when(reference > 0, value / reference).when(value > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))


def log2_fold(value: Column, reference: Column) -> Column:
    return F.ln((value + EPSILON) / (reference + EPSILON)) / F.lit(math.log(2.0))


def digamma(n: Column) -> Column:
    """Derivative of ln gamma at numbers from 1 on, to about 1e-12: six steps up, then the asymptotic series."""
    z = n + F.lit(6.0)
    q = F.lit(1.0) / (z * z)
    series = q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q * (F.lit(1 / 240) - q * F.lit(1 / 132)))))
    out = F.ln(z) - F.lit(0.5) / z - series
    for i in range(6):
        out = out - F.lit(1.0) / (n + F.lit(float(i)))
    return out


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (value - mean) / std).otherwise(F.lit(0.0))


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def percentile_of_z(z: Column) -> Column:
    """Share below in a normal population, 0 to 100; z is cut to 8 either side."""
    return F.lit(50.0) * (F.lit(1.0) + erf(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) / F.lit(math.sqrt(2.0))))


def percentile_deviation(percentile: Column) -> Column:
    return F.abs(percentile - 50.0) / 50.0


def combined_score(abundance: Column, fold: Column, deviation: Column) -> Column:
    return WEIGHT_ABUNDANCE * abundance + WEIGHT_FOLD * F.least(F.abs(fold) / 4.0, F.lit(1.0)) + WEIGHT_PERCENTILE * deviation


def direction(value: Column, reference: Column, fold: Column) -> Column:
    """higher, lower or similar; 0.58 is a fold change of one half."""
    return (
        F.when((reference <= 0) & (value > 0), "higher").when((value <= 0) & (reference > 0), "lower")
        .when(fold >= 0.58, "higher").when(fold <= -0.58, "lower").otherwise("similar")
    )


def direction_by_ratio(ratio: Column) -> Column:
    """The older rule: one and a half times either way."""
    return F.when(ratio >= 1.5, "higher").when(ratio <= 1 / 1.5, "lower").otherwise("similar")


def deviation_level(z: Column, percentile: Column) -> Column:
    return (
        F.when((z >= 2) | (percentile >= 97.5), "high").when((z >= 1) | (percentile >= 85), "moderate")
        .when((z <= -1) | (percentile <= 35), "close_to_healthy").otherwise("mild")
    )


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def std_or_zero(c: Column) -> Column:
    return F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.stddev_pop(c))


def empirical_percentile(value: Column, target: Column) -> Column:
    """Percentage of values up to the target (a column that is constant in the group); 50 if there are none."""
    return F.coalesce(100.0 * F.avg(F.when(value <= target, 1.0).otherwise(0.0)), F.lit(50.0))


def clr(v: Column, pseudo: float = 1e-6) -> Column:
    """Centered log-ratio of an array; negatives count as 0."""
    shifted = F.transform(v, lambda x: F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)) + pseudo)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    closed = F.transform(F.array(shifted), lambda a: F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: F.ln(x / t)))[0])[0]
    return F.transform(F.array(closed), lambda a: F.transform(F.array(total(a) / F.size(a)), lambda m: F.transform(a, lambda x: x - m))[0])[0]


def rms_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays over the square root of their dimension; 0 for none."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, F.sqrt(squares / F.size(a))).otherwise(F.lit(0.0))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def hundredths_text(c: Column, plus: str = "") -> Column:
    """As %.2f writes it, `plus` before what isn't below zero. Numbers of two digits at most are put together from whole ones; a formatter reads its pattern for every row."""
    size = F.abs(c)
    whole = F.floor(size)
    rest = (F.rint(size * 100) - whole * 100).cast("int").cast("string")
    plain = (c != 0) & (size < 1e12) & (F.rint(size * 100) / 100 == size)
    return F.when(plain, F.concat(F.when(c < 0, "-").otherwise(plus), whole.cast("string"), F.lit("."), F.lpad(rest, 2, "0"))).otherwise(F.format_string(f"%{plus}.2f", c))


def signed_text(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull(), "--").otherwise(F.format_string(f"%+.{digits}f", c))


def range_text(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "--").otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def parse_vector(text: Column) -> Column:
    """Numbers of "v1,v2\\n...": commas, tabs and line breaks separate; blanks are skipped, other text is null."""
    parts = F.filter(F.transform(F.split(text, r"[,\n\t]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))

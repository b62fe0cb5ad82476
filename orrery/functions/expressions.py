"""Column expressions: vectors held as array<double>, clipped math, entropies. All of them stay
inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(xs: Column | str) -> Column:
    return F.aggregate(_c(xs), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    """Cosine of two vectors; 0 where either is shorter than floor."""
    n = norm(a) * norm(b)
    return F.when(n > floor, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def scaled(a: Column | str, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return F.transform(_c(a), lambda x: x * by)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def unit(a: Column | str, floor: float = 1e-12) -> Column:
    """The vector at length 1, or zeros where it is shorter than floor."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > floor, x / n).otherwise(F.lit(0.0)))
    return let(_c(a), lambda v: F.when(v.isNotNull(), let(norm(v), lambda n: scaled(v, n))))


def centred(a: Column | str) -> Column:
    """The vector less its own mean."""
    return let(_c(a), lambda v: F.when(v.isNotNull(), let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))))


def centred_cosine(a: Column | str, b: Column | str) -> Column:
    return cosine(centred(a), centred(b))


def pair_features(a: Column | str, b: Column | str) -> Column:
    """Both vectors, the absolute difference and the product, end to end."""
    a, b = _c(a), _c(b)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two arrays as sets; 0 for two empty ones."""
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both > 0, F.size(F.array_intersect(_c(a), _c(b))) / both).otherwise(F.lit(0.0))


def entropy(weights: Column | str) -> Column:
    """Shannon entropy, in nats, of an array of weights; negatives count as 0, no weight gives 0."""
    w = F.transform(_c(weights), lambda x: F.greatest(x, F.lit(0.0)))
    s = total(w)
    terms = F.transform(w, lambda x: F.when((x > 0) & (s > 0), -(x / s) * F.ln(x / s)).otherwise(F.lit(0.0)))
    return total(terms)


def logit(p: Column | str, floor: float = 1e-4) -> Column:
    q = F.greatest(F.least(_c(p), F.lit(1 - floor)), F.lit(floor))
    return F.ln(q / (1 - q))


def normal_llr(x: Column, mean1: Column, sd1: Column, mean0: Column, sd0: Column) -> Column:
    """Log density of x under the first normal less that under the second."""
    one = -F.ln(sd1) - 0.5 * F.pow((x - mean1) / sd1, 2)
    zero = -F.ln(sd0) - 0.5 * F.pow((x - mean0) / sd0, 2)
    return one - zero


def chi2_upper(x: Column, pairs: Column) -> Column:
    """Upper tail of a chi-square with 2 * pairs degrees of freedom, in closed form."""
    half = x / 2
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(
        F.when(pairs > 1, F.sequence(F.lit(1), (pairs - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        first,
        lambda a, k: F.struct((a["term"] * half / k).alias("term"), (a["sum"] + a["term"] * half / k).alias("sum")),
    )
    return F.exp(-half) * series["sum"]


def sign_changes(xs: Column | str, eps: float = 1e-6) -> Column:
    """Sign changes between successive differences, those within eps of 0 left out."""
    xs = _c(xs)
    steps = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: b - a)
    signs = F.transform(F.filter(steps, lambda d: F.abs(d) > eps), lambda d: F.signum(d))
    n = F.size(signs)
    return F.when(n < 2, F.lit(0)).otherwise(
        F.size(F.filter(F.zip_with(F.slice(signs, 1, n - 1), F.slice(signs, 2, n - 1), lambda a, b: a * b), lambda p: p < 0))
    )


def differences(xs: Column | str) -> Column:
    xs = _c(xs)
    return F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: b - a)


def three_way(x: Column, low: Column, high: Column, names=("low", "mid", "high")) -> Column:
    return F.when(x <= low, names[0]).when(x >= high, names[2]).otherwise(names[1])


def triangle_slack(a: Column, b: Column, c: Column) -> Column:
    """Half of what the two shorter sides exceed the longest by."""
    return 0.5 * F.greatest(F.lit(0.0), a + b + c - 2 * F.greatest(a, b, c))


def angle_degrees(a: Column | str, b: Column | str) -> Column:
    """Angle between the lines along two vectors."""
    return F.degrees(F.acos(F.least(F.abs(cosine(a, b)), F.lit(1.0))))


LN2 = math.log(2)

"""Column functions: distances, edge weights, random scores and small helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points given in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = (b - a) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    return 2 * F.asin(F.sqrt(F.pow(F.sin(dlat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon), 2))) * EARTH_KM


def inverse_weight(dist: Column) -> Column:
    return 1 / (1 + dist)


def inverse_sqrt_weight(dist: Column) -> Column:
    return 1 / (1 + F.sqrt(dist))


def exponential_weight(length: float):
    """exp(-d / length), as a function of the distance."""
    return lambda dist: F.exp(-dist / F.lit(float(length)))


def hash_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def arithmetic_unit(seed: int, key: Column) -> Column:
    """A number in [0, 1) from a whole-number key by plain arithmetic, which SQL can follow: a fifth power modulo 1,000,003, which repeats no value."""
    x = F.pmod(key * 7919 + seed * 104729 + 4074, F.lit(1_000_003))
    square = F.pmod(x * x, F.lit(1_000_003))
    return F.pmod(F.pmod(square * square, F.lit(1_000_003)) * x, F.lit(1_000_003)) / F.lit(1_000_003.0)


def beta_score(kind: str, seed: int, *cols: Column, unit: Callable[..., Column] = hash_unit) -> Column:
    """Random scores with the Beta(1,1), Beta(2,2) or Beta(.5,.5) distribution: `flat`, `middle`, `ends`. unit: the uniform numbers."""
    u = unit(seed, *cols)
    if kind == "flat":
        return u
    if kind == "middle":  # the median of three uniforms
        v, w = unit(seed + 1, *cols), unit(seed + 2, *cols)
        return F.greatest(F.least(u, v), F.least(F.greatest(u, v), w))
    if kind == "ends":  # the arcsine law
        return F.pow(F.sin(F.lit(3.141592653589793) * u / 2), 2)
    raise ValueError(kind)


def log_gamma(x: Column) -> Column:
    """Stirling's series for x > 0, eight steps up."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    product = reduce(lambda a, k: a * (x + k), range(1, 8), x)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """The regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    args = F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), z.cast("double").alias("z"))

    def go(acc: Column, m: Column) -> Column:
        p, q, z = acc["p"], acc["q"], acc["z"]
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * acc["d"]), safe(1 + even / acc["c"])
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct(p.alias("p"), q.alias("q"), z.alias("z"), c2.alias("c"), d2.alias("d"), (acc["h"] * d1 * c1 * d2 * c2).alias("h"))

    d0 = 1 / safe(1 - (args["p"] + args["q"]) * args["z"] / (args["p"] + 1))
    start = F.struct(args["p"].alias("p"), args["q"].alias("q"), args["z"].alias("z"), F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, go, lambda acc: acc["h"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log(1 - z)) / p
    value = F.when(z <= 0, F.lit(0.0)).otherwise(front * fraction)
    return F.when(flip, 1 - value).otherwise(value)


def t_tail(t: Column, degrees: Column) -> Column:
    """Probability of a t statistic at least as far from 0, either way."""
    return incomplete_beta(degrees / 2, F.lit(0.5), degrees / (degrees + t * t))


def half_even(p: Column) -> Column:
    """0 or 1: the rounded probability, 0.5 to 0."""
    return F.bround(p).cast("int")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to `places` decimals, halves away from zero, negative zero to zero. By whole numbers where these are exact, as round() is by decimal text."""
    unit = 10.0**places

    def near(c: Column) -> Column:
        whole = F.floor(F.abs(c) * unit + 0.5) / unit
        return F.when(F.abs(c) < 2**50 / unit, F.signum(c) * whole).otherwise(F.round(c, places)) + F.lit(0.0)

    return df.select(*[near(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

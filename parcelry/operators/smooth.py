"""LOWESS over evenly spaced points, by prefix moments.

The tricube weight of a neighbour is a polynomial of its distance, of degree 9 on either side, so every sum over a window is a sum of
moments (powers of the place, times weight and value) over the window's left and right side. Running moments are kept within
blocks of a quarter of a window, around the block's centre and in units of the window, which keeps all powers small: a point
reads the running moments at its window's two ends and its own, and what whole blocks lie between, shifted to its own place by the binomial theorem.
Each point meets three rows and one sum of blocks, whatever the window. Values are taken from a reference of their block, its first value, so
that a level stretch has moments of zero. Where the robust weights have left so little within a window that differences of sums can't tell it,
the few points that still have weight are summed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import held
from .prefix import with_running
from .quantiles import quantiles, with_quantiles

#: Powers 0 to 11: the weight's 9 and the line's 2. Moments of the weight come first, then those of weight times value.
POWERS = 12
#: Blocks in a window.
BLOCKS = 4
#: A residual below this share of the value is rounding: the point lies on its line.
ROUNDING = 1e-15
#: What differences of running moments may lose, as a share of the robust weights (times values) in the blocks they come from.
NOISE = 1e-12
#: A window whose weights, or their spread, are below this share of its blocks' robust weights is summed point by point.
THIN = 1e-3


def shifted(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments (rows x 24) around a point that lies `by` before the old one."""
    powers = by[:, None] ** np.arange(POWERS)
    out = np.zeros_like(moments)
    for half in (0, POWERS):
        for m in range(POWERS):
            for low in range(m + 1):
                out[:, half + m] += comb(m, low) * powers[:, m - low] * moments[:, half + low]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * POWERS)


def lifted(moments: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments (rows x 24) of values that are `by` more."""
    return np.concatenate((moments[:, :POWERS], moments[:, POWERS:] + by[:, None] * moments[:, :POWERS]), axis=1)


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column _T lifted by _lift and moved by _by."""
    for batch in batches:
        moved = shifted(lifted(_matrix(batch.column("_T")), batch.column("_lift").to_numpy()), batch.column("_by").to_numpy())
        at = batch.schema.get_field_index("_T")
        yield batch.set_column(at, batch.schema.field(at), pa.array(list(moved), pa.list_(pa.float64())))


def line_at(i: np.ndarray, k: np.ndarray, b: np.ndarray, s: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The local line of each point at its own place, its weight, and whether the point's window is thin. weight: the robust weights of its blocks."""
    e = s + k - 1
    centre = lambda at: (at // b) * b + (b - 1) / 2
    here = centre(i)
    near = ((s // b) == (i // b))[:, None]
    before = np.where(near, own - start, left + own - shifted(start, (centre(s) - here) / k))
    near = ((e // b) == (i // b))[:, None]
    after = np.where(near, end - own, total - own + right + shifted(end, (centre(e) - here) / k))
    reach = np.maximum(np.maximum(i - s, e - i), 1)
    scale = (k / reach)[:, None] ** (np.arange(2 * POWERS) % POWERS)
    before, after = (shifted(m, -(i - here) / k) * scale for m in (before, after))
    weighed = lambda m: sum(c * (before[:, m + d] * (-1) ** (d // 3) + after[:, m + d]) for d, c in ((0, 1), (3, -3), (6, 3), (9, -1)))
    a, x, xx, v, xv = (weighed(m) for m in (0, 1, 2, POWERS, POWERS + 1))
    det = a * xx - x * x
    thin = (weight > 0) & ~((a > THIN * weight) & (det > THIN * weight * np.maximum(xx, 0)) & (xx > THIN * weight / k))
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.where(det * reach**2 > 1e-12 * a * a, (v * xx - xv * x) / det, v / a)
    return fit, a, thin


def _one_by_one(thin: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, _i, _exact): how far the local line of a thin window's point lies above it, summed over the points that have weight."""
    asked = thin.select(*by, "_i", "_k", "_s", F.col("_y").alias("_yi"), F.explode(F.sequence(F.floor(F.col("_s") / F.col("_b")), F.floor((F.col("_s") + F.col("_k") - 1) / F.col("_b")))).alias("_blk"))
    known = points.filter("_r > 0").select(*by, "_blk", F.col("_i").alias("_j"), F.col("_y").alias("_yj"), "_r")
    met = asked.join(known, [*by, "_blk"]).filter(F.col("_j").between(F.col("_s"), F.col("_s") + F.col("_k") - 1))
    reach = F.greatest(F.col("_i") - F.col("_s"), F.col("_s") + F.col("_k") - 1 - F.col("_i"), F.lit(1))
    d = (F.col("_j") - F.col("_i")).cast("double")
    w = F.col("_r") * F.pow(1 - F.pow(F.abs(d) / reach, F.lit(3)), F.lit(3))
    met = met.select(*by, "_i", d.alias("_d"), w.alias("_w"), F.coalesce(F.col("_yj") - F.col("_yi"), F.lit(0.0)).alias("_g")).filter("_w > 0")
    terms = {"a": F.lit(1.0), "b": F.col("_d"), "c": F.col("_d") * F.col("_d"), "p": F.col("_g"), "q": F.col("_d") * F.col("_g")}
    sums = met.groupBy(*by, "_i").agg(*[F.sum(F.col("_w") * t).alias(n) for n, t in terms.items()])
    line = F.when(F.expr("a * c - b * b > 1e-12 * a * a"), F.expr("(p * c - q * b) / (a * c - b * b)")).otherwise(F.expr("p / a"))
    return sums.select(*by, "_i", line.alias("_exact"))


def _round(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """points (*by, _i, _y, _k, _n, _b, _s, _r, _blk, _ref) with _gap, the local line less the value, and _err, what it may be off by."""
    u = (F.col("_i") - F.col("_blk") * F.col("_b") - (F.col("_b") - 1) / 2) / F.col("_k")
    value = F.coalesce(F.col("_r") * (F.col("_y") - F.col("_ref")), F.lit(0.0))
    weights = {"m": F.col("_r"), "g": value}
    names = [f"_{half}{m}" for half in weights for m in range(POWERS)]
    own = points.withColumn("_u", u).withColumn("_h", F.abs(value))
    own = own.withColumns({f"_{half}{m}": w * F.pow(F.col("_u"), F.lit(m)) if m else w for half, w in weights.items() for m in range(POWERS)}).drop("_u")
    run = with_running(own, [*by, "_blk"], [F.col("_i")], [*names, "_h"])
    run = held(run.select(*points.columns, F.col("cum__h").alias("_H"), F.array(*[F.col(f"cum_{n}") for n in names]).alias("_P"), F.array(*[F.col(f"cum_{n}") - F.col(n) for n in names]).alias("_E")))
    totals = run.groupBy(*by, "_blk").agg(F.max_by("_P", "_i").alias("_T"), F.max_by("_H", "_i").alias("_h"), F.first("_ref").alias("_theirs"))

    e = F.col("_s") + F.col("_k") - 1
    blocks = dict(_A=F.floor(F.col("_s") / F.col("_b")), _D=F.floor(e / F.col("_b")))
    keys = run.withColumns(blocks).select(*by, "_A", "_blk", "_D", "_k", "_b", "_ref").distinct()
    each = keys.select(*by, "_A", F.col("_blk").alias("_I"), "_D", "_ref", (F.col("_b") / F.col("_k")).alias("_step"), F.explode(F.sequence("_A", "_D")).alias("_blk"))
    each = each.join(totals, [*by, "_blk"]).withColumn("_by", (F.col("_blk") - F.col("_I")) * F.col("_step")).withColumn("_lift", F.col("_theirs") - F.col("_ref"))
    moved = each.withColumn("_m", F.col("_T")[0]).mapInArrow(_shift, each.withColumn("_m", F.col("_T")[0]).schema)
    side = lambda cond: F.array(*[F.coalesce(F.sum(F.when(cond, F.col("_T")[m])), F.lit(0.0)) for m in range(2 * POWERS)])
    inside = F.col("_blk") < F.col("_D")
    between = moved.groupBy(*by, "_A", F.col("_I").alias("_blk"), "_D").agg(
        side(F.col("_blk") < F.col("_I")).alias("_low"),
        side((F.col("_blk") > F.col("_I")) & (F.col("_blk") < F.col("_D"))).alias("_up"),
        side(F.col("_blk") == F.col("_I")).alias("_all"),
        F.coalesce(F.sum(F.when(inside, F.col("_m"))), F.lit(0.0)).alias("_weight"),
        F.coalesce(F.sum(F.when(inside, F.col("_h") + F.abs("_lift") * F.col("_m"))), F.lit(0.0)).alias("_size"),
    )
    ends = ["_start", "_end", "_first", "_latest", "_Hend"]
    met = (
        run.withColumns(blocks | {"_last": e})
        .join(run.select(*by, F.col("_i").alias("_s"), F.col("_E").alias("_start"), F.col("_ref").alias("_first")), [*by, "_s"])
        .join(run.select(*by, F.col("_i").alias("_last"), F.col("_P").alias("_end"), F.col("_ref").alias("_latest"), F.col("_H").alias("_Hend")), [*by, "_last"])
        .join(between, [*by, "_A", "_blk", "_D"])
        .select(*points.columns, "_E", *ends, "_low", "_up", "_all", "_weight", "_size")
    )
    kept = points.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k, b, s = (batch.column(c).to_numpy().astype(float) for c in ("_i", "_k", "_b", "_s"))
            ref, first, latest, h_end, weight, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_ref", "_first", "_latest", "_Hend", "_weight", "_size"))
            own, start, end, low, up, total = (_matrix(batch.column(c)) for c in ("_E", "_start", "_end", "_low", "_up", "_all"))
            weight, size = weight + end[:, 0], size + h_end + np.abs(latest - ref) * end[:, 0]
            line, a, thin = line_at(i, k, b, s, own, lifted(start, first - ref), lifted(end, latest - ref), low, up, total, weight)
            gap = line - (batch.column("_y").to_numpy(zero_copy_only=False) - ref)
            gap = np.where(thin | (weight <= 0), 0.0, gap)
            with np.errstate(divide="ignore", invalid="ignore"):
                err = np.where(thin | (weight <= 0), 0.0, NOISE * size / a)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(gap, pa.float64()), pa.array(err, pa.float64()), pa.array(thin)], names=[*kept, "_gap", "_err", "_thin"])

    more = [T.StructField("_gap", T.DoubleType()), T.StructField("_err", T.DoubleType()), T.StructField("_thin", T.BooleanType())]
    fitted = held(met.mapInArrow(fit, T.StructType([*points.schema.fields, *more])))
    thin = fitted.filter("_thin")
    if thin.isEmpty():
        return fitted.drop("_thin")
    exact = fitted.join(_one_by_one(thin, points, by), [*by, "_i"], "left")
    return held(exact.select(*kept, F.when(F.col("_thin"), F.coalesce("_exact", F.lit(0.0))).otherwise(F.col("_gap")).alias("_gap"), "_err"))


def lowess(curve: DataFrame, x: str, y: str, by: Sequence[str] = (), frac: float = 0.05, robust: int = 3) -> DataFrame:
    """Local linear smooth of y over evenly spaced x (numbered from its least value in each group), with `robust` reweighting rounds.

    The k = frac n (truncated; at least 2) nearest points of a point are k in a row. After each round but the last a point's residual,
    over six times the group's median, gives its bisquare weight in the next. Rows (*by, x, y_smooth).
    """
    by = list(by)
    stats = curve.groupBy(*by).agg(F.count("*").alias("_n"), F.min(x).alias("_x0"), F.coalesce(F.avg(y), F.lit(0.0)).alias("_mean"))
    points = curve.join(stats, by) if by else curve.crossJoin(F.broadcast(stats))  # one row
    k = F.least(F.greatest(F.lit(2), F.floor(F.lit(frac) * F.col("_n") + 1e-10)), F.col("_n")).cast("bigint")
    points = points.select(*by, F.col(x).alias("_x"), (F.col(y) - F.col("_mean")).cast("double").alias("_y"), "_mean", (F.col(x) - F.col("_x0")).cast("bigint").alias("_i"), k.alias("_k"), "_n")
    start = F.least(F.greatest(F.col("_i") - F.floor(F.col("_k") / 2), F.lit(0)), F.col("_n") - F.col("_k"))
    points = points.select("*", F.greatest(F.lit(1), F.floor(F.col("_k") / BLOCKS)).cast("bigint").alias("_b"), start.cast("bigint").alias("_s"), F.lit(1.0).alias("_r"))
    points = held(points.withColumn("_blk", F.floor(F.col("_i") / F.col("_b"))))
    refs = points.groupBy(*by, "_blk").agg(F.coalesce(F.min_by("_y", F.when(F.col("_y").isNotNull(), F.col("_i"))), F.lit(0.0)).alias("_ref"))
    points = held(points.join(refs, [*by, "_blk"]).select(*points.columns, "_ref"))
    columns = points.columns
    for left in range(robust, -1, -1):
        fitted = _round(points, by)
        if not left:
            return fitted.select(*by, F.col("_x").alias(x), (F.col("_y") + F.col("_mean") + F.col("_gap")).alias(f"{y}_smooth"))
        error = F.abs("_gap")
        noise = F.greatest(ROUNDING * (F.abs("_y") + F.abs("_mean")), F.col("_err"))
        off = fitted.withColumn("_off", F.when(error > noise, error).otherwise(0.0))
        off = with_quantiles(off, quantiles(off, F.col("_off"), [0.5], by, "_m").withColumn("_m", F.col("_m")[0]), by)
        t = F.when(F.col("_m") == 0, (F.col("_off") > 0).cast("double")).otherwise(F.least(F.col("_off") / (6 * F.col("_m")), F.lit(1.0)))
        points = off.withColumn("_r", F.pow(1 - t * t, F.lit(2))).select(*columns)

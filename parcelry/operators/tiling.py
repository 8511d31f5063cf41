"""Tiles: hexagons and squares by arithmetic, ready-made columns, tile tables, adjacency and statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import held
from .prefix import with_running
from .quantiles import quantiles, with_quantiles

KM_PER_DEGREE = 111.194
HEX_STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
SQUARE_STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def bounds(points: DataFrame) -> DataFrame:
    """One row: min_lat, max_lat, min_lon, max_lon."""
    return points.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def _round(v: Column) -> Column:
    return F.floor(v + 0.5)


def projected(points: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """Every point at each resolution with x, y from the minimum corner (degrees of latitude) and the tile width w."""
    flat = points.crossJoin(F.broadcast(bounds(points)))
    scale = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    width, height = (F.col("max_lon") - F.col("min_lon")) * scale, F.col("max_lat") - F.col("min_lat")
    return (
        flat.withColumn("x", (F.col("lon") - F.col("min_lon")) * scale)
        .withColumn("y", F.col("lat") - F.col("min_lat"))
        .withColumn("_extent", F.greatest(width, height, F.lit(1e-9)))
        .withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in resolutions])))
        .withColumn("w", F.col("_extent") / F.col("resolution"))
        .drop("min_lat", "max_lat", "min_lon", "max_lon", "_extent")
    )


def tile_key(a: Column, b: Column, resolution: Column) -> Column:
    """A non-negative number for cell (a, b); occupied cells lie within resolution + 2 of the origin's row and column."""
    off = resolution + 2
    return (a + off) * (4 * resolution + 8) + (b + off)


def hexagons(points: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """(pid, resolution, q, r, tile_id): the pointy-top hexagon of each point, `resolution` hexagons across."""
    at = projected(points, resolutions).withColumn("s", F.col("w") / math.sqrt(3))
    at = at.withColumn("fq", (F.lit(math.sqrt(3) / 3) * F.col("x") - F.col("y") / 3) / F.col("s")).withColumn("fr", (F.lit(2.0 / 3.0) * F.col("y")) / F.col("s"))
    at = at.withColumn("fz", -F.col("fq") - F.col("fr"))
    rounded = at.select("pid", "resolution", "fq", "fr", "fz", _round(F.col("fq")).alias("q0"), _round(F.col("fr")).alias("r0"), _round(F.col("fz")).alias("z0"))
    dq, dr, dz = (F.abs(F.col(a) - F.col(b)) for a, b in (("q0", "fq"), ("r0", "fr"), ("z0", "fz")))
    fix_q, fix_r = (dq > dr) & (dq > dz), ~((dq > dr) & (dq > dz)) & (dr > dz)
    q = F.when(fix_q, -F.col("r0") - F.col("z0")).otherwise(F.col("q0"))
    r = F.when(fix_r, -F.col("q0") - F.col("z0")).otherwise(F.col("r0"))
    return rounded.select("pid", "resolution", q.alias("q"), r.alias("r")).withColumn("tile_id", tile_key(F.col("q"), F.col("r"), F.col("resolution")))


def squares(points: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """(pid, resolution, q, r, tile_id) on a square grid."""
    at = projected(points, resolutions)
    cells = at.select("pid", "resolution", F.floor(F.col("x") / F.col("w")).alias("q"), F.floor(F.col("y") / F.col("w")).alias("r"))
    return cells.withColumn("tile_id", tile_key(F.col("q"), F.col("r"), F.col("resolution")))


def ready_made(df: DataFrame, col: str, key: str = "pid") -> DataFrame:
    """(pid, tile_id) from any column; numbers from 0 in the order of its values."""
    values = df.select(col).distinct().filter(F.col(col).isNotNull())
    numbered = held(with_running(values, [], [F.col(col)]).select(col, (F.col("pos") - 1).alias("tile_id")))
    return df.select(key, col).join(F.broadcast(numbered) if numbered.count() < 100_000 else numbered, col).select(key, "tile_id")


def square_table(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """One row per occupied square: parcels, centre, area and corners as WKT (degrees)."""
    info = projected(points, [1]).select("w").limit(1).withColumnRenamed("w", "_extent").crossJoin(bounds(points))
    cells = tiles.groupBy("resolution", "tile_id", "q", "r").agg(F.count("*").alias("n_parcels"))
    flat = cells.crossJoin(F.broadcast(info)).withColumn("s", F.col("_extent") / F.col("resolution"))
    scale = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    lon = lambda k: F.col("min_lon") + (F.col("q") + k) * F.col("s") / scale
    lat = lambda k: F.col("min_lat") + (F.col("r") + k) * F.col("s")
    ring = F.concat_ws(", ", *[F.format_string("%.5f %.5f", lon(i), lat(j)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    area = F.pow(F.col("s") * KM_PER_DEGREE, 2)
    return flat.select("resolution", "tile_id", "n_parcels", lon(0.5).alias("cx"), lat(0.5).alias("cy"), area.alias("area_km2"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def block_table(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """One row per ready-made tile: parcels, their mean place, and the box around them with its area."""
    found = tiles.select("pid", "tile_id").join(points.select("pid", "lat", "lon"), "pid").groupBy("tile_id")
    ends = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    boxes = found.agg(F.count("*").alias("n_parcels"), F.avg("lon").alias("cx"), F.avg("lat").alias("cy"), *ends)
    width = (F.col("max_lon") - F.col("min_lon")) * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    return boxes.withColumn("area_km2", width * (F.col("max_lat") - F.col("min_lat")) * KM_PER_DEGREE**2)


def with_tile_stats(tiles: DataFrame, stats: DataFrame) -> DataFrame:
    """The statistics of its tile beside each parcel; tiles without statistics have nulls."""
    return tiles.join(stats, ["resolution", "tile_id"], "left")


def tile_table(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """One row per occupied hexagon: parcels, centre and corners as WKT (degrees)."""
    info = projected(points, [1]).select("w").limit(1).withColumnRenamed("w", "_extent").crossJoin(bounds(points))
    cells = tiles.groupBy("resolution", "tile_id", "q", "r").agg(F.count("*").alias("n_parcels"))
    flat = cells.crossJoin(F.broadcast(info)).withColumn("s", F.col("_extent") / F.col("resolution") / math.sqrt(3))
    scale = F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    x = F.col("s") * (F.lit(math.sqrt(3)) * F.col("q") + F.lit(math.sqrt(3) / 2) * F.col("r"))
    y = F.col("s") * 1.5 * F.col("r")
    flat = flat.withColumn("cx", F.col("min_lon") + x / scale).withColumn("cy", F.col("min_lat") + y)
    corner = lambda k: F.format_string(
        "%.5f %.5f",
        F.col("cx") + F.col("s") * math.cos(math.radians(60 * k - 30)) / scale,
        F.col("cy") + F.col("s") * math.sin(math.radians(60 * k - 30)),
    )
    ring = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[corner(k % 6) for k in range(7)]), F.lit("))"))
    area = F.lit(1.5 * math.sqrt(3)) * F.pow(F.col("s") * KM_PER_DEGREE, 2)
    return flat.select("resolution", "tile_id", "n_parcels", "cx", "cy", area.alias("area_km2"), ring.alias("wkt"))


def adjacency(tiles: DataFrame, steps: Sequence[tuple[int, int]] = HEX_STEPS) -> DataFrame:
    """(resolution, src, dst) for touching pairs of occupied tiles, both ways."""
    cells = tiles.select("resolution", "tile_id", "q", "r").distinct()
    moves = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in steps])
    near = cells.withColumn("m", F.explode(moves))
    near = near.select("resolution", F.col("tile_id").alias("src"), tile_key(F.col("q") + F.col("m.a"), F.col("r") + F.col("m.b"), F.col("resolution")).alias("dst"))
    return near.join(cells.select("resolution", F.col("tile_id").alias("dst")), ["resolution", "dst"], "left_semi").select("resolution", "src", "dst")


def tile_stats(tiles: DataFrame, data: DataFrame, target: str, features: Sequence[str] = ()) -> DataFrame:
    """Per tile: n, sum and rate of the target; of each feature mean, deviation, extremes and quartiles."""
    aggs = [F.count("*").alias("n"), F.sum(target).alias("sum"), F.avg(target).alias("rate")]
    for c in features:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    tile, rows = ["resolution", "tile_id"], tiles.join(data, "pid")
    out = rows.groupBy(*tile).agg(*aggs)
    if not features:
        return out
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = rows.select(*tile, F.explode(values).alias("x")).select(*tile, "x.*")
    found = quantiles(long, F.col("value"), [0.25, 0.5, 0.75], [*tile, "feature"], "q")
    wide = found.groupBy(*tile).agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_q_{c}") for c in features])
    named = [F.col(f"_q_{c}")[k].alias(f"{c}_{name}") for c in features for k, name in enumerate(("q25", "median", "q75"))]
    return with_quantiles(out, wide, tile).select(*out.columns, *named)


def parcel_tile_stats(tiles: DataFrame, data: DataFrame, target: str, features: Sequence[str] = ()) -> DataFrame:
    """The statistics of its tile beside each parcel: resolution, tile_id, pid and the columns of `tile_stats`, null where no parcel of the tile has data."""
    return tiles.select("resolution", "tile_id", "pid").join(tile_stats(tiles, data, target, features), ["resolution", "tile_id"], "left")

"""Preparation of parcel tables: columns, rows, missing values, categories, scaling, lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import beta_score, hash_unit
from .prefix import with_running


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def labelled_and_located(df: DataFrame, label: str = "dangerous", lon: str = "lon") -> DataFrame:
    return df.dropna(subset=[label, lon])


def label_int(label: str = "dangerous") -> Column:
    return F.col(label).cast("int")


def vertical_split(df: DataFrame, target: Sequence[str], location: Sequence[str], dropped: Sequence[str] = (), key: str = "pid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, targets, locations), each with the key, of the labelled and located rows."""
    rows = labelled_and_located(df, target[0], location[0]).drop(*dropped)
    features = [c for c in rows.columns if c not in {key, *target, *location}]
    return rows.select(key, *features), rows.select(key, *target), rows.select(key, *location)


def fill_missing(df: DataFrame, value: int = -1, keep: Sequence[str] = ("pid",)) -> DataFrame:
    """Numbers and strings alike: a missing value becomes -1 or '-1', so that it is its own category."""
    strings = [c for c, t in df.dtypes if t == "string" and c not in keep]
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint") and c not in keep]
    return df.fillna(value, subset=numbers).fillna(str(value), subset=strings)


def categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """The sorted levels of each column, found in one pass; levels are few, and become columns."""
    found = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first()
    return {c: list(found[c]) for c in cols}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each column becomes {column}_{level} with 0 or 1; a level not listed is 0 everywhere."""
    dummies = [F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}") for c, vs in levels.items() for v in vs]
    return df.select(*[c for c in df.columns if c not in levels], *dummies)


def lookup(df: DataFrame, wanted: DataFrame, key: str = "pid", order: str | None = None) -> DataFrame:
    """Rows of df for each row of wanted, repeats kept; with `order`, in the order of that column of wanted."""
    found = wanted.join(df, key)
    return found.orderBy(order) if order else found


def semi(df: DataFrame, keys: DataFrame, key: str = "pid") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str = "pid") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def contains(col: str, part: str) -> Column:
    """Null doesn't contain anything."""
    return F.coalesce(F.col(col).contains(part), F.lit(False))


def open_band(col: str, low: float, high: float) -> Column:
    return (F.col(col) > low) & (F.col(col) < high)


def closed_band(col: str, low: float, high: float) -> Column:
    return F.col(col).between(low, high)


def route_requests(edges: DataFrame, points: DataFrame, base: str = "/table/v1/foot/") -> DataFrame:
    """(src, n_dst, request): one request per source, its own place first, then its neighbours' in the order of dst."""
    at = points.select("pid", F.format_string("%.6f,%.6f", F.col("lon"), F.col("lat")).alias("at"))
    far = edges.join(at.withColumnsRenamed({"pid": "dst", "at": "far"}), "dst")
    listed = far.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "far"))).alias("x"))
    own = listed.join(at.withColumnsRenamed({"pid": "src", "at": "own"}), "src")
    places = F.concat_ws(";", F.col("own"), F.transform("x", lambda e: e["far"]))
    return own.select("src", F.size("x").alias("n_dst"), F.concat(F.lit(base), places, F.lit("?sources=0")).alias("request"))


def standardise(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), role: str = "role", train: str = "train") -> DataFrame:
    """Each column less the train rows' mean, over their population deviation (1 where that is 0)."""
    stats = df.filter(F.col(role) == train).groupBy(*by).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def class_pair(prob: str = "prob") -> Column:
    """(1 - p, p)."""
    return F.array(1 - F.col(prob), F.col(prob))


def positive_class(pair: str) -> Column:
    return F.element_at(F.col(pair), 2)


def over_train_max(df: DataFrame, col: str, by: Sequence[str] = (), role: str = "role", train: str = "train") -> DataFrame:
    """The column divided by the train rows' largest value of each group; the maxima are aggregated and joined back."""
    top = df.filter(F.col(role) == train).groupBy(*by).agg(F.max(col).alias("_top"))
    joined = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))
    return joined.select(*[F.try_divide(F.col(c), F.col("_top")).alias(c) if c == col else F.col(c) for c in df.columns])


def recode_distances(edges: DataFrame, sentinel: float = 1e5) -> DataFrame:
    """Edges that were asked for (below the sentinel), with w = 1 / (1 + dist); a weight of 1 (no distance) is 0."""
    w = 1 / (1 + F.col("dist"))
    return edges.filter(F.col("dist") < sentinel).withColumn("w", F.when(w == 1.0, 0.0).otherwise(w))


def feature_table(predictions: DataFrame, features: DataFrame, names: Sequence[str] | str | None = None, key: str = "pid") -> DataFrame:
    """The model's score alone (None), with chosen features, or with 'All'."""
    if names is None:
        return predictions
    chosen = [c for c in features.columns if c != key] if names == "All" else list(names)
    return predictions.join(features.select(key, *chosen), key)


def node_table(points: DataFrame, predictions: DataFrame, labels: DataFrame, key: str = "pid") -> DataFrame:
    """Every node with role ('none' outside the experiment), score and label."""
    return points.select(key).join(predictions, key, "left").join(labels, key, "left").fillna("none", subset=["role"])


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def uniqueness(df: DataFrame, key: str = "pid") -> DataFrame:
    """(n_rows, n_keys, is_unique)."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def row_sample(df: DataFrame, n: int, key: str = "pid", seed: int = 0, order: Column | None = None) -> DataFrame:
    """n rows without replacement, the first in a seeded hash order."""
    return df.orderBy(order if order is not None else hash_unit(seed, F.col(key)), key).limit(n)


def resample(df: DataFrame, n: int, key: str = "pid", seed: int = 0, unit: Callable[..., Column] = hash_unit, draw: str = "draw") -> DataFrame:
    """Exactly n rows with replacement, each with the number of its draw, from 0; of an empty table none.

    A draw is a place in the order of `key`, which must tell rows apart, taken from the seed and the draw's number alone, so that
    reruns agree. Rows are numbered by ranges, draws are made in parallel, and the two meet by place, which spreads evenly.
    unit: the uniform numbers.
    """
    placed = with_running(df, [], [F.col(key)], position="_place")
    total = df.count()
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").alias(draw), (F.floor(unit(seed, F.col("id")) * total) + 1).alias("_place"))
    return draws.join(placed, "_place").select(*df.columns, draw)


def random_scores(df: DataFrame, kind: str = "flat", seed: int = 0, key: str = "pid", name: str = "prob") -> DataFrame:
    return df.withColumn(name, beta_score(kind, seed, F.col(key)))


def select_data(predictions: DataFrame, features: DataFrame, labels: DataFrame, location: DataFrame, tiles: DataFrame, train_size: float, resolution: int, split: int) -> DataFrame:
    """One experiment: score, role, label, features, place and tile of each of its parcels."""
    chosen = (F.col("train_size") == train_size) & (F.col("resolution") == resolution) & (F.col("split") == split)
    return (
        predictions.filter(chosen)
        .join(tiles.filter(F.col("resolution") == resolution).drop("resolution"), "pid")
        .join(labels, "pid")
        .join(location, "pid")
        .join(features, "pid")
    )


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)

"""Logistic regressions of all experiments and penalties together, one job a step.

A step is one pass over the train rows: each task adds its rows to the loss, gradient and second derivatives of every experiment and
penalty, the sums meet by experiment, and there the small system is solved. Only coefficients come to the driver, which sends them
out for the next pass; experiments are fitted in blocks of a bounded number of coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import held

#: Coefficients that a pass carries to its tasks (32 MB); more experiments are fitted in further blocks.
BLOCK = 4_000_000
#: (L1, L2) penalties on the sum of the losses; the intercept has none.
Penalty = tuple[float, float]


def complete(df: DataFrame, features: Sequence[str]) -> Column:
    """Rows that a fit can use: a label and all features are there."""
    return reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.col("label").isNotNull())


def move(gradient: np.ndarray, second: np.ndarray, beta: np.ndarray, penalty: Penalty) -> np.ndarray:
    """The way from beta to the least value of the loss's parabola with its penalties."""
    l1, l2 = (np.append(np.full(len(beta) - 1, v), 0.0) for v in penalty)
    if not l1.any():
        return np.linalg.lstsq(second + np.diag(l2), -(gradient + l2 * beta), rcond=None)[0]
    new, bend = beta.copy(), second.diagonal() + l2
    slope = gradient.copy()  # of the loss alone, at new
    for _ in range(2000):
        most = 0.0
        for j in np.flatnonzero(bend > 0):
            best = new[j] * bend[j] - slope[j] - l2[j] * new[j]
            best = np.sign(best) * max(abs(best) - l1[j], 0.0) / bend[j]
            if best != new[j]:
                slope += second[:, j] * (best - new[j])
                most, new[j] = max(most, abs(best - new[j])), best
        if most < 1e-12:
            break
    return new - beta


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, live: np.ndarray) -> DataFrame:
    """(e, s, pos, value): loss, gradient and upper second derivatives of each experiment and penalty still moving, at beta."""
    width = beta.shape[2]
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            e, y = batch.column("e").to_numpy(), batch.column("label").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, width - 1)
            for one in np.unique(e):
                own = e == one
                z = np.column_stack([(x[own] - mean[one]) * scale[one], np.ones(own.sum())])
                for s in np.flatnonzero(live[one]):
                    t = z @ beta[one, s]
                    p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
                    loss = np.logaddexp(0, t) - y[own] * t
                    part = np.concatenate([[loss.sum()], z.T @ (p - y[own]), ((z * (p * (1 - p))[:, None]).T @ z)[upper]])
                    sums[one, s] = sums.get((one, s), 0) + part
        for (one, s), part in sums.items():
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, one), pa.int32()), pa.array(np.full(n, s), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(part)], names=["e", "s", "pos", "value"])

    return rows.mapInArrow(add, "e int, s int, pos int, value double").groupBy("e", "s", "pos").agg(F.sum("value").alias("value"))


def _solved(sums: DataFrame, beta: np.ndarray, penalties: Sequence[Penalty]) -> DataFrame:
    """(e, s, loss, step): the penalised loss at beta and the way on, each system solved where its sums meet."""
    width = beta.shape[2]

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        e, s, v = int(own["e"].iloc[0]), int(own["s"].iloc[0]), own["value"].to_numpy()
        second = np.zeros((width, width))
        second[np.triu_indices(width)] = v[1 + width :]
        second = second + np.triu(second, 1).T
        (l1, l2), at = penalties[s], beta[e, s]
        loss = v[0] + l1 * np.abs(at[:-1]).sum() + l2 / 2 * (at[:-1] ** 2).sum()
        return pd.DataFrame({"e": [e], "s": [s], "loss": [loss], "step": [move(v[1 : 1 + width], second, at, penalties[s])]})

    return sums.groupBy("e", "s").applyInPandas(solve, "e int, s int, loss double, step array<double>")


def _fit(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, penalties: Sequence[Penalty], steps: int) -> np.ndarray:
    """Newton steps, halved while the loss rises, until a step is under 1e-9 everywhere."""
    beta = np.zeros((len(mean), len(penalties), mean.shape[1] + 1))
    trial, way, size = beta.copy(), np.zeros_like(beta), np.ones(beta.shape[:2])
    least, live = np.full(beta.shape[:2], np.inf), np.ones(beta.shape[:2], dtype=bool)
    for _ in range(steps):
        for r in _solved(_sums(rows, mean, scale, trial, live), trial, penalties).collect():
            at = r["e"], r["s"]
            if r["loss"] <= least[at] + 1e-12 * abs(r["loss"]):
                beta[at], least[at], way[at], size[at] = trial[at], r["loss"], r["step"], 1.0
            else:
                size[at] /= 2
            trial[at] = beta[at] + size[at] * way[at]
            live[at] = np.abs(size[at] * way[at]).max() > 1e-9
        if not live.any():
            break
    return trial


def fits(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), penalties: Sequence[Penalty] = ((0.0, 0.0),), standard: bool = True, steps: int = 60) -> DataFrame:
    """(*by, setting, single, coefficients): a fit for each experiment with train rows and each penalty, numbered as given.

    df: *by, role, label (0 or 1) and features. coefficients are those of the features as they are, then the intercept. Rows where a
    feature or the label is null are not fitted. Where the train rows have one class, `single` is its label and there are no
    coefficients. Where classes can be told apart without error, and no penalty holds them, coefficients are those after the last step.
    Penalties weigh the features in units of their standard deviation, or, without `standard`, as they are. A column that is constant in
    an experiment has coefficient 0.
    """
    by, features, p, spark = list(by), list(features), len(features), df.sparkSession
    train = df.filter((F.col("role") == "train") & complete(df, features)).select(*by, F.col("label").cast("double"), *[F.col(c).cast("double") for c in features])
    stats = [F.count("*").alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"), F.array(*[F.avg(c) for c in features]).alias("_mean"), F.array(*[F.stddev(c) for c in features]).alias("_std")]
    found = train.groupBy(*by).agg(*stats).filter("_n > 0").collect()  # experiments are few
    key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.select(*by).schema.fields)
    lead = f"{key_type}, " if by else ""
    out, mixed = [], []
    for r in found:
        key = tuple(r[b] for b in by)
        if r["_low"] == r["_high"]:
            out += [(*key, s, float(r["_low"]), None) for s in range(len(penalties))]
        else:
            mixed.append((key, r))
    block = max(1, BLOCK // (len(penalties) * (p + 1)))
    for start in range(0, len(mixed), block):
        some = mixed[start : start + block]
        mean = np.array([r["_mean"] for _, r in some], dtype=float).reshape(-1, p)
        std = np.array([r["_std"] for _, r in some], dtype=float).reshape(-1, p)
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        if not standard:
            mean, scale = np.zeros_like(mean), (std > 0).astype(float)
        numbered = spark.createDataFrame([(*key, e) for e, (key, _) in enumerate(some)], f"{lead}_e int")
        rows = held(matched(train, numbered, by).select(F.col("_e").alias("e"), "label", F.array(*features).alias("x")))
        beta = _fit(rows, mean, scale, penalties, steps)
        for e, (key, r) in enumerate(some):
            for s in range(len(penalties)):
                plain = beta[e, s, :-1] * scale[e]
                out.append((*key, s, None, [*map(float, plain), float(beta[e, s, -1] - plain @ mean[e])]))
    return spark.createDataFrame(out, f"{lead}setting int, single double, coefficients array<double>")


def matched(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """df joined with a table keyed by `by`, null keys alike; all rows with all where there is no key (the table has one experiment)."""
    names = {b: f"_key_{k}" for k, b in enumerate(by)}
    on = reduce(lambda a, b: a & df[b].eqNullSafe(F.col(names[b])), by, F.lit(True))
    return df.join(table.withColumnsRenamed(names), on).drop(*names.values())


def scored(df: DataFrame, features: Sequence[str], table: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ("pid", "role", "label")) -> DataFrame:
    """(*keep, setting, prob): the fits applied to df's rows; null where a feature is null."""
    t = reduce(lambda a, x: a + x, [F.col("coefficients")[k] * F.col(c) for k, c in enumerate(features)], F.col("coefficients")[len(features)])
    prob = F.coalesce(F.col("single"), F.when(t >= 0, 1 / (1 + F.exp(-t))).otherwise(F.exp(t) / (1 + F.exp(t))))
    return matched(df, table, by).select(*keep, "setting", prob.alias("prob"))

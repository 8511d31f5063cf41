"""Model jobs on Spark ML; their scores have the columns of predictions."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import held, save_predictions, scratch
from . import logistic
from .metrics import log_loss

KEY = ["train_size", "resolution", "split"]


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def scores(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("prob"))


def fit_and_score(df: DataFrame, features: Sequence[str], estimator, keep: Sequence[str] = ("pid", "role", "label")) -> tuple[object, DataFrame]:
    """A fit on the train rows; scores of all rows. df: pid, role, label and features."""
    rows = assembled(df, features)
    model = estimator.fit(rows.filter("role = 'train'"))
    return model, scores(model, rows, keep)


def boosted_trees(**options) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", seed=7, **({"maxIter": 10, "maxDepth": 3} | options))


def logistic_estimator(**options) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", **({"regParam": 0.0, "maxIter": 50} | options))


def tree(**options) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=7, **({"maxDepth": 10} | options))


def experiments(rows: DataFrame, by: Sequence[str]) -> list[tuple[dict, DataFrame, float | None, int]]:
    """Of each experiment of rows (*by, role, label, ..) with train rows its key, its rows, the label of its train rows where they have one class only, and its size."""
    label = F.when(F.col("role") == "train", F.col("label"))
    found = rows.groupBy(*by).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count("*").alias("_n")).filter("_low IS NOT NULL").orderBy(*by).collect()
    out = []
    for e in found:  # experiments are few, a fit is a Spark job
        key = {b: e[b] for b in by}
        own = rows
        for b, v in key.items():
            own = own.filter(F.col(b).eqNullSafe(F.lit(v)))
        out.append((key, own, float(e["_low"]) if e["_low"] == e["_high"] else None, e["_n"]))
    return out


def standing(spark: SparkSession, path: str, schema: T.StructType, name: str, by: Sequence[str]) -> dict[tuple, int]:
    """Rows that a store of predictions holds of each experiment of a model; none where nothing was stored yet."""
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {tuple(r[b] for b in by): r["count"] for r in stored.filter(F.col("model") == name).groupBy(*by).count().collect()}


def per_experiment(
    splits: DataFrame, data: DataFrame, features: Sequence[str], estimator, name: str, by: Sequence[str] = KEY, store: str | None = None, side_by_side: int = 8
) -> DataFrame:
    """One fit for each experiment of splits, train and test scores together: (model, *by, role, pid, prob).

    Where the train rows have one class, its label is every score. Up to `side_by_side` fits run at once, each in a pool of its own, which
    share the cluster evenly under `spark.scheduler.mode` FAIR. Scores go to `store` (a path; a new one in the shared folder if none is
    given), a folder for each experiment. A run that was interrupted goes on where it stopped: experiments whose scores stand there, row for
    row, are not fitted again. Where features or splits change, take another store or another name. `by` holds numbers.
    """
    by, spark = list(by), splits.sparkSession
    rows = held(splits.join(data, "pid"), by)
    path = store or scratch(spark, "fits")
    kinds = rows.schema
    schema = T.StructType([T.StructField("model", T.StringType()), *[kinds[b] for b in by], kinds["role"], kinds["pid"], T.StructField("prob", T.DoubleType())])
    done = standing(spark, path, schema, name, by)

    def fit(job: tuple[int, tuple[dict, DataFrame, float | None, int]]) -> None:
        number, (_, own, single, _) = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number}")
        scored = own.withColumn("prob", F.lit(single)) if single is not None else fit_and_score(own, features, estimator.copy(), [*by, "pid", "role"])[1]
        save_predictions(scored.select(F.lit(name).alias("model"), *by, "role", "pid", "prob"), path, by)

    found = experiments(rows, by)
    open_fits = [e for e in found if done.get(tuple(e[0].values())) != e[3]]
    with ThreadPool(max(1, side_by_side)) as pool:
        pool.map(inheritable_thread_target(spark)(fit), list(enumerate(open_fits)), chunksize=1)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("model") == name).select(*schema.names)


def regularisation_path(
    df: DataFrame,
    features: Sequence[str],
    strengths: Sequence[float] = (0, 1, 10, 50, 100),
    penalties: Sequence[str] = ("l1", "l2"),
    by: Sequence[str] = ("split",),
    cell: Sequence[str] = (),
) -> DataFrame:
    """(*cell, penalty, strength, log_loss): mean test loss over the experiments of a cell. Strengths weigh on the sum of the losses.

    All experiments, penalties and strengths are fitted together. cell: those of `by` that the mean isn't taken over.
    """
    settings = [(p, float(s)) for p in penalties for s in strengths]
    rows = held(df.select(*by, "role", "label", *features))
    found = logistic.fits(rows, features, by, [(s, 0.0) if p == "l1" else (0.0, s) for p, s in settings])
    tested = logistic.scored(rows.filter("role = 'test'"), features, found, by, [*by, "label"])
    losses = log_loss(tested, [*by, "setting"]).groupBy(*cell, "setting").agg(F.avg("log_loss").alias("log_loss"))
    names, values = (F.array(*[F.lit(x[k]) for x in settings]) for k in (0, 1))
    return losses.select(*cell, F.get(names, F.col("setting")).alias("penalty"), F.get(values, F.col("setting")).alias("strength"), "log_loss")


def importance(model, features: Sequence[str], spark, n: int = 10) -> DataFrame:
    """(feature, importance), largest first."""
    pairs = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(pairs[:n], "feature string, importance double")


def one_rule(df: DataFrame, col: str = "year_built", limit: float = 1935) -> DataFrame:
    """The score is whether the column is at most the limit; null is 0."""
    return df.select("pid", F.coalesce((F.col(col) <= limit).cast("double"), F.lit(0.0)).alias("prob"))


def logistic_scores(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ("pid", "role", "label"), penalty: float = 0.0) -> DataFrame:
    """(*keep, prob): a logistic regression for each experiment, fitted together on the train rows, on all rows.

    penalty: half the sum of the squared coefficients weighs so much, beside the sum of the losses.
    """
    rows = held(df)
    return logistic.scored(rows, features, logistic.fits(rows, features, by, [(0.0, penalty)], standard=False), by, keep).drop("setting")


def calibrated(scored: DataFrame, fit_role: str = "calibration", by: Sequence[str] = ()) -> DataFrame:
    """Sigmoid calibration of scores, fitted on a role of its own in each experiment, and applied to all."""
    rows = held(scored.withColumnRenamed("prob", "raw"))
    found = logistic.fits(rows.withColumn("role", F.when(F.col("role") == fit_role, "train")), ["raw"], by)
    return logistic.scored(rows, ["raw"], found, by, [*by, "pid", "role", "label", "raw"]).drop("setting")


def stacked(predictions: DataFrame, labels: DataFrame, models: Sequence[str], by: Sequence[str] = KEY, penalty: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Logistic regression on several models' scores, all experiments together: (*by, pid, role, label, prob) and (*by, term, coefficient).

    Half the sum of the squared coefficients weighs `penalty`, beside the sum of the losses.
    Where the train rows have one class, its label is every score, and there are no coefficients.
    """
    by, models = list(by), list(models)
    wide = held(predictions.groupBy(*by, "pid", "role").pivot("model", models).agg(F.first("prob")).join(labels, "pid"))
    found = logistic.fits(wide, models, by, [(0.0, penalty)], standard=False)
    names = F.array(*[F.lit(m) for m in [*models, "intercept"]])
    terms = found.filter("single IS NULL").select(*by, F.posexplode("coefficients").alias("_k", "coefficient")).select(*by, F.get(names, F.col("_k")).alias("term"), "coefficient")
    return logistic.scored(wide, models, found, by, [*by, "pid", "role", "label"]).drop("setting"), terms

"""Fitting, predicting and inspecting models."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed
from pandwerk.functions.ranks import global_rank
from pandwerk.learning import prep, stacked
from pandwerk.learning.linear_svr import LinearSVR, LinearSVRModel, model_of
from pandwerk.operators import evaluate

LABEL = "clean_floors"
KEYS = ["bag_id", LABEL]


def estimator(algorithm: str, label: str = LABEL) -> Estimator:
    """Default regressor by name: random forest, gradient boosting or linear support vectors."""
    if algorithm == "rfr":
        return RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=30, featureSubsetStrategy="all",
                                     minInstancesPerNode=1, seed=0, maxMemoryInMB=1024)
    if algorithm == "gbr":
        return GBTRegressor(labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1, seed=0)
    if algorithm == "svr":
        return LinearSVR(labelCol=label)
    raise ValueError(f"unknown algorithm {algorithm!r}: choose rfr, gbr or svr")


def prepared(df: DataFrame, features: list[str], keep: list[str] | None = None) -> tuple[PipelineModel, DataFrame]:
    stages = prep.fit(df, features, keep or KEYS)
    return stages, stages.transform(df)


def fit(train: DataFrame, features: list[str], algorithm: str, params: dict | None = None,
        label: str = LABEL) -> tuple[PipelineModel, float]:
    """Preparation and regressor fitted on the train rows, with the wall time in seconds."""
    started = time.monotonic()
    stages, ready = prepared(train, features)
    ready = ready.select(label, prep.FEATURES).persist()
    try:
        base = estimator(algorithm, label)
        fitted = base.copy({base.getParam(k): v for k, v in (params or {}).items()}).fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*stages.stages, fitted]), time.monotonic() - started


def refit(train: DataFrame, subsets: dict[str, list[str]], algorithm: str, best: dict) -> dict[str, PipelineModel]:
    """Other feature sets trained with the best parameters found for one.

    Linear models are fitted together: the columns of all sets are prepared once and every set uses its own.
    """
    if algorithm != "svr":
        return {name: fit(train, features, algorithm, best)[0] for name, features in subsets.items()}
    together, alone = prep.fit_lists(train, subsets, KEYS)
    rows, width = stacked.rows_of(together.transform(train), LABEL, {})
    places = {n: i for i, n in enumerate(prep.input_names(together))}
    columns = {name: tuple(places[n] for n in prep.input_names(stages)) for name, stages in alone.items()}
    rows = rows.persist()
    try:
        found = stacked.fit_together(rows, width, [stacked.Fit(**best, columns=columns[name]) for name in subsets])
    finally:
        rows.unpersist()
    out = {}
    for name, fitted in zip(subsets, found):
        fitted.weights = fitted.weights[[*columns[name], width]]
        out[name] = PipelineModel([*alone[name].stages, model_of(fitted)])
    return out


def parts(model: PipelineModel) -> tuple[PipelineModel, object]:
    """Preparation stages and the regressor of a fitted pipeline."""
    return PipelineModel(model.stages[:-1]), model.stages[-1]


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw and rounded predictions of every row; ``keep`` columns of the input travel along, without a join."""
    carried = [c for c in (keep or []) if c not in KEYS]
    stages, regressor = parts(model)
    source = df if LABEL in df.columns else df.withColumn(LABEL, F.lit(None).cast("int"))
    ready = prep.carrying(stages, carried).transform(source)
    return regressor.transform(ready).select(
        *KEYS, F.col("prediction").alias("pred_value"), F.rint("prediction").alias("pred_value_rounded"),
        *[F.col(prep.CARRIED + c).alias(c) for c in carried])


def evaluate_models(models: dict[tuple, PipelineModel], train: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics of every model on both splits; keys are (model, algorithm, tuning description).

    All models score the same scan: each adds its prediction to the rows, which are then laid out
    one per model.
    """
    scored = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    inputs = [c for c in scored.columns if c not in KEYS]
    results = []
    for i, ((name, algorithm, tuning), model) in enumerate(models.items()):
        scored = predict(model, scored, [*inputs, *[f"_p{j}" for j in range(i)]]).withColumnRenamed(
            "pred_value", f"_p{i}").drop("pred_value_rounded")
        results.append(F.struct(F.lit(name).alias("model"), F.lit(algorithm).alias("algorithm"),
                                F.lit(tuning).alias("tuning_description"), F.col(f"_p{i}").alias("pred_value")))
    laid_out = scored.select(*KEYS, "split", F.explode(F.array(*results)).alias("_m")).select(*KEYS, "split", "_m.*")
    return evaluate.model_table(laid_out.withColumn("pred_value_rounded", F.rint("pred_value")))


def importances(model: PipelineModel, spark) -> DataFrame:
    """Impurity importances, or absolute coefficients of a linear model; heaviest first."""
    stages, regressor = parts(model)
    weights = getattr(regressor, "featureImportances", None)
    values = weights.toArray().tolist() if weights is not None else [abs(c) for c in regressor.coefficients]
    rows = sorted(zip(prep.input_names(stages), map(float, values)), key=lambda r: (r[1], r[0]), reverse=True)
    return spark.createDataFrame(rows, "feature string, weight double")


def _linear_accuracies(pairs: DataFrame, regressor: LinearSVRModel, names: list[str], chosen: list[str]) -> DataFrame:
    """Rows ``(feature, accuracy)`` of a linear model where one column of ``_x`` at a time has the value in ``_other``.

    Products are added in the order of the columns, as the model does, so predictions are the model's own.
    """
    weights, intercept, width = np.array(regressor.coefficients, dtype=float), float(regressor.intercept), len(names)
    places = [names.index(c) for c in chosen]
    label = LABEL

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
            own, lent = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).T * weights[:, None] for c in ("_x", "_other"))
            upto = np.full(batch.num_rows, intercept)
            hits = np.zeros(width, dtype=np.int64)
            for i in range(width):
                total = upto + lent[i]
                for j in range(i + 1, width):
                    total += own[j]
                hits[i] = np.count_nonzero(np.rint(total) == wanted)
                upto = upto + own[i]
            rows = batch.num_rows - batch.column(label).null_count
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int32()), "hits": pa.array(hits[places], pa.int64()),
                                              "rows": pa.array([rows] * len(places), pa.int64())})

    counts = pairs.select(LABEL, "_x", "_other").mapInArrow(score, "place int, hits long, rows long")
    named = F.array(*[F.lit(n) for n in names])
    return counts.groupBy(named[F.col("place")].alias("feature")).agg(F.try_divide(F.sum("hits"), F.sum("rows")).alias("accuracy"))


def permutation_importance(model: PipelineModel, df: DataFrame, repeats: int = 10, seed: int = 42,
                           columns: list[str] | None = None) -> DataFrame:
    """Mean drop in rounded accuracy when one prepared column is shuffled.

    Every repeat puts the rows in a seeded hash order of their ids and lends each row the values of
    the next one, the last row those of the first. One order serves all columns, and all are scored in one pass: a linear
    model on batches of rows, whose sums are shared up to the column replaced; for other models a row is laid out once
    per column with that column's value replaced.
    """
    stages, regressor = parts(model)
    names = prep.input_names(stages)
    chosen = list(columns or names)
    ready = checkpointed(stages.transform(df).select(
        "bag_id", LABEL, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("_x")))
    n = ready.count()
    empty = df.sparkSession.createDataFrame([], "feature string, permutation_importance double")
    if n == 0:
        return empty

    def accuracy(frame: DataFrame, *by: str) -> DataFrame:
        scored = regressor.transform(frame.withColumn(prep.FEATURES, array_to_vector("_x")))
        return scored.groupBy(*by).agg(evaluate.metrics(F.col(LABEL), F.col("prediction"))["accuracy"].alias("accuracy"))

    results = []
    for repeat in range(repeats):
        placed = global_rank(ready.withColumn("_h", F.xxhash64("bag_id", F.lit(f"{seed}-{repeat}"))), "_h", "bag_id")
        lent = placed.select(F.pmod(F.col("_rank") - 1, F.lit(n)).alias("_rank"), F.col("_x").alias("_other"))
        pairs = placed.select("_rank", LABEL, "_x").join(lent, "_rank")
        if isinstance(regressor, LinearSVRModel):
            results.append(checkpointed(_linear_accuracies(pairs, regressor, names, chosen)))
            continue
        laid = pairs.select(LABEL, F.explode(F.array(*[F.struct(
            F.lit(c).alias("feature"), F.concat(F.slice("_x", 1, i), F.array(F.col("_other")[i]),
                                                F.slice("_x", i + 2, len(names) - i - 1)).alias("_x"))
            for c, i in ((c, names.index(c)) for c in chosen)])).alias("_m")).select(LABEL, "_m.*")
        results.append(checkpointed(accuracy(laid, "feature")))
    # the base accuracy is one row
    return (reduce(DataFrame.unionByName, results)
            .crossJoin(F.broadcast(accuracy(ready).withColumnRenamed("accuracy", "_base")))
            .groupBy("feature").agg(F.avg(F.col("_base") - F.col("accuracy")).alias("permutation_importance"))
            .orderBy(F.desc("permutation_importance"), F.desc("feature")))

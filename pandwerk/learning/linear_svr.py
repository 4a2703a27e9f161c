"""Linear epsilon-insensitive regression as a Spark ML estimator."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from pandwerk.learning.prep import FEATURES
from pandwerk.learning.stacked import Fit, Fitted, fit_together, rows_of


class _SvrParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasTol):
    epsilon = Param(Params._dummy(), "epsilon", "width of the tube without loss", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "weight of the loss against the penalty", TypeConverters.toFloat)
    loss = Param(Params._dummy(), "loss", "epsilon_insensitive or squared_epsilon_insensitive", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(featuresCol=FEATURES, labelCol="clean_floors", predictionCol="prediction",
                         maxIter=1000, tol=1e-4, epsilon=0.0, C=1.0, loss="epsilon_insensitive")


class LinearSVRModel(Model, _SvrParams, DefaultParamsReadable, DefaultParamsWritable):
    """Coefficients are a parameter, so the model saves and loads with a pipeline."""

    weights = Param(Params._dummy(), "weights", "coefficients with the intercept last", TypeConverters.toListFloat)
    status = Param(Params._dummy(), "status", "settled, stalled (no better objective for a while) or limit (of iterations)",
                   TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(weights=[], status="limit")

    @property
    def coefficients(self) -> list[float]:
        return self.getOrDefault(self.weights)[:-1]

    @property
    def converged(self) -> bool:
        return self.getOrDefault(self.status) == "settled"

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.weights)[-1]

    def _transform(self, dataset):
        score = F.lit(float(self.intercept))
        for i, w in enumerate(self.coefficients):
            score = score + F.get("_x", F.lit(i)) * F.lit(float(w))
        held = dataset.withColumn("_x", vector_to_array(self.getFeaturesCol()))
        return held.select(*[F.col(f"`{c}`") for c in dataset.columns if c != self.getPredictionCol()], score.alias(self.getPredictionCol()))


class LinearSVR(Estimator, _SvrParams, DefaultParamsReadable, DefaultParamsWritable):
    """Minimises ``|w|^2 / 2 + C * sum(loss)`` by reweighted least squares, a single one of `stacked`'s fits.

    Every iteration is one distributed pass that sums a k-by-k block per task; the driver
    solves a system of the number of features. The intercept is penalised like a feature.
    """

    @keyword_only
    def __init__(self, *, epsilon=0.0, C=1.0, maxIter=1000, tol=1e-4, loss="epsilon_insensitive",
                 labelCol="clean_floors", featuresCol=FEATURES, predictionCol="prediction"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        rows, width = rows_of(dataset, self.getOrDefault(self.labelCol), {}, self.getOrDefault(self.featuresCol))
        rows = rows.persist()
        try:
            found = fit_together(rows, width, [Fit(self.getOrDefault(self.C), self.getOrDefault(self.epsilon), self.getTol(),
                                                   self.getMaxIter(), self.getOrDefault(self.loss))])[0]
        finally:
            rows.unpersist()
        return self._copyValues(model_of(found))


def model_of(found: Fitted) -> LinearSVRModel:
    model = LinearSVRModel()
    model._set(weights=[float(v) for v in found.weights], status=found.status)
    return model

"""Error metrics and reports on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandwerk.functions.quantiles import group_percentiles
from pandwerk.functions.scalar import nan_to_null, round_half_even


def metrics(label: Column, predicted: Column, where: Column | None = None) -> dict[str, Column]:
    """Accuracy, MAE, RMSE and maximum error of rounded predictions as aggregate columns.

    ``where`` restricts them to a class; an empty class gives NULL.
    """
    error = F.abs(label - F.rint(predicted))
    if where is not None:
        error = F.when(where, error)
    return {
        "accuracy": F.avg(F.when(error == 0, 1.0).when(error.isNotNull(), 0.0)),
        "mae": F.avg(error),
        "rmse": F.sqrt(F.avg(error * error)),
        "max_err": F.max(error),
    }


def reported(name: str, c: Column) -> Column:
    """Rounding used in published tables: percentages to 1, errors to 2 decimals."""
    if name == "accuracy":
        return round_half_even(c * 100, 1)
    return round_half_even(c, 2) if name in ("mae", "rmse") else c


def class_metrics(label: Column, predicted: Column, threshold: int, where: Column | None = None) -> dict[str, Column]:
    """The four metrics above and up to the floor threshold."""
    keep = F.lit(True) if where is None else where
    out = {}
    for suffix, test in (("above", label > threshold), ("below", label <= threshold)):
        for name, c in metrics(label, predicted, keep & test).items():
            out[f"{name}_{suffix}"] = c
    return out


def overall(df: DataFrame, label: str = "clean_floors", predicted: str = "pred_value", by: tuple = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in metrics(F.col(label), F.col(predicted)).items()])


def per_class(df: DataFrame, threshold: int = 5, label: str = "clean_floors", predicted: str = "pred_value",
              by: tuple = ()) -> DataFrame:
    both = class_metrics(F.col(label), F.col(predicted), threshold)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in both.items()])


MODEL_KEYS = ("model", "algorithm", "tuning_description")


def model_table(df: DataFrame, label: str = "clean_floors", predicted: str = "pred_value") -> DataFrame:
    """One row per model with the four metrics on both splits, rounded for reporting."""
    out = []
    for name in ("mae", "rmse", "max_err", "accuracy"):
        for split in ("train", "test"):
            c = metrics(F.col(label), F.col(predicted), F.col("split") == split)[name]
            out.append(reported(name, c).alias(f"{name}_{split}"))
    return df.groupBy(*MODEL_KEYS).agg(*out)


def model_table_per_class(df: DataFrame, threshold: int = 5, label: str = "clean_floors",
                          predicted: str = "pred_value") -> DataFrame:
    """One row per model with test metrics above and below the floor threshold."""
    both = class_metrics(F.col(label), F.col(predicted), threshold, F.col("split") == "test")
    return df.groupBy(*MODEL_KEYS).agg(*[
        reported(n.rsplit("_", 1)[0], c).alias(f"{n}_test") for n, c in both.items()])


def with_reference(predictions: DataFrame, reference: DataFrame, key: str = "bag_id") -> DataFrame:
    return predictions.join(reference, key, "left")


def compare_models(results: DataFrame, threshold: int = 5, label: str = "clean_floors") -> DataFrame:
    """Rule of thumb, best model and mean predictor: overall and per class, one row each."""
    mean = results.agg(F.avg(label).alias("mean_no_floors"))
    # the mean is one row
    wide = results.crossJoin(F.broadcast(mean))
    long = wide.select(F.col(label).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("p"))
        for name, c in (("ref_model", "ref_model"), ("best_model", "pred_value"), ("mean", "mean_no_floors"))
    ])).alias("_m")).select("_y", "_m.model", F.col("_m.p").alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    columns = {**metrics(y, p), **class_metrics(y, p, threshold)}
    return long.groupBy("model").agg(*[
        reported(n.removesuffix("_above").removesuffix("_below"), c).alias(n) for n, c in columns.items()])


def with_errors(df: DataFrame, label: str = "clean_floors", predicted: str = "pred_value") -> DataFrame:
    rounded = F.rint(predicted)
    return df.withColumns({"pred_value_rounded": rounded, "error": rounded - F.col(label),
                           "abs_error": F.abs(rounded - F.col(label))})


def abs_error_frequency(df: DataFrame, by: tuple = ()) -> DataFrame:
    return with_errors(df).groupBy(*by, "abs_error").agg(F.count("*").alias("n"))


def mean_abs_error_per_floor(df: DataFrame, label: str = "clean_floors", by: tuple = ()) -> DataFrame:
    return with_errors(df, label).groupBy(*by, label).agg(F.avg("abs_error").alias("mean_abs_error"))


def confusion(df: DataFrame, label: str = "clean_floors", predicted: str = "pred_value", by: tuple = ()) -> DataFrame:
    """Share of each true floor count predicted as each floor count, in long form."""
    counts = (df.where((F.rint(predicted) >= 1) & (F.col(label) >= 1))
              .groupBy(*by, F.col(label).alias("true_floors"), F.rint(predicted).cast("int").alias("pred_floors"))
              .agg(F.count("*").alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "true_floors"))
    return counts.withColumn("share", share)


def gross_errors(df: DataFrame, at_least: int = 5) -> DataFrame:
    return with_errors(df).where(F.col("abs_error") >= at_least)


def rounding_effect(df: DataFrame, label: str = "clean_floors", predicted: str = "pred_value", by: tuple = ()) -> DataFrame:
    """MAE and RMSE with and without rounding."""
    raw, rounded = F.col(predicted) - F.col(label), F.rint(predicted) - F.col(label)
    return df.groupBy(*by).agg(
        F.avg(F.abs(raw)).alias("mae_raw"), F.avg(F.abs(rounded)).alias("mae_rounded"),
        F.sqrt(F.avg(raw * raw)).alias("rmse_raw"), F.sqrt(F.avg(rounded * rounded)).alias("rmse_rounded"))


def floor_histogram(df: DataFrame, label: str = "clean_floors", by: tuple = ()) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))


def floor_percentile(df: DataFrame, p: float = 0.9, label: str = "clean_floors") -> DataFrame:
    return group_percentiles(df, [], label, [p]).select(F.col("q")[0].alias("percentile"))


def merged_class(function: Column) -> Column:
    """Reporting classes: others count as unknown, both non-residential kinds are one."""
    return (F.when(function == "Others", "Unknown")
            .when(function.startswith("Non-residential"), "Non-residential").otherwise(function))


# Classes shown together as 'Other' for a source.
SOURCE_OTHER = {
    "c3_dhg": ("Non-residential", "Mixed-residential", "Unknown"),
    "c4_rho": ("Non-residential", "Unknown"),
}


def class_counts(df: DataFrame, function: str = "bag_function") -> DataFrame:
    """Buildings per reporting class, over all sources (``data_source`` NULL) and per source."""
    merged = merged_class(F.col(function))
    per_source = merged
    for source, classes in SOURCE_OTHER.items():
        per_source = F.when((F.col("data_source") == source) & merged.isin(*classes), "Other").otherwise(per_source)
    # both views start from the same small count table
    counts = (df.where(F.col(function).isNotNull()).groupBy("data_source", function).agg(F.count("*").alias("_c")))
    total = counts.groupBy(merged.alias("class")).agg(F.sum("_c").alias("n")).select(
        F.lit(None).cast("string").alias("data_source"), "class", "n")
    split = counts.groupBy("data_source", per_source.alias("class")).agg(F.sum("_c").alias("n"))
    return total.unionByName(split)


def source_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("data_source").agg(F.count("*").alias("n"))
    # a handful of sources: the unpartitioned window sees one row each
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def scale_medians(study: DataFrame) -> DataFrame:
    """Median absolute volume difference per voxel scale."""
    diff = study.withColumn("_d", nan_to_null(F.abs(F.col("mesh_volume") - F.col("sampled_volume"))))
    return group_percentiles(diff, ["scale"], "_d", [0.5]).select("scale", F.col("q")[0].alias("median_diff"))


def as_long(df: DataFrame, columns: list[str], names: str, values: str, keep: tuple = ()) -> DataFrame:
    """Columns to rows."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_kv")).select(
            *keep, F.col("_kv.k").alias(names), F.col("_kv.v").alias(values))

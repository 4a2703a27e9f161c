"""Removing implausible labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed
from pandwerk.functions.quantiles import group_percentiles

MAX_CLEANED_FLOORS = 17
MIN_STOREY_HEIGHT = 1.5
IQR_REACH = 1.5
ROOF_TYPES = ("slanted", "multiple horizontal", "single horizontal")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given columns."""
    return df.na.drop(subset=columns)


def numeric_columns(df: DataFrame, skip: tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") and f.name not in skip]


def with_storey_height(df: DataFrame) -> DataFrame:
    """Known roof types up to 17 floors, two roof classes, and the average storey height."""
    roof = F.col("bag3d_roof_type")
    return (df.where((F.col("no_floors") <= MAX_CLEANED_FLOORS) & roof.isin(*ROOF_TYPES))
            .withColumn("bag3d_roof_type", F.when(roof == "slanted", "slanted").otherwise("horizontal"))
            .withColumn("avg_h_storey", F.try_divide(F.col("h_70p"), F.col("no_floors"))))


def _fences(df: DataFrame, attribute: str, probs: list[float]) -> DataFrame:
    """Quantiles per floor count; at most one row per permitted floor count."""
    return group_percentiles(df, ["no_floors"], attribute, probs).select("no_floors", "q")


def flag_iqr_outliers(df: DataFrame, attribute: str) -> DataFrame:
    """Flag values beyond 1.5 IQR of their floor count; values on a fence are kept.

    The fences are one row per floor count, joined back instead of a window per floor count.
    """
    fences = _fences(df, attribute, [0.25, 0.75])
    return df.join(fences, "no_floors", "left").withColumn("is_outlier", _beyond(attribute, "q")).drop("q")


def flag_outer_percentiles(df: DataFrame, low: float, high: float, attribute: str) -> DataFrame:
    """Flag values outside the inclusive percentile range of their floor count."""
    fences = _fences(df, attribute, [low, high])
    inside = F.col(attribute).between(F.col("q")[0], F.col("q")[1])
    return df.join(fences, "no_floors", "left").withColumn("is_outlier", ~inside).drop("q")


def height_steps(df: DataFrame) -> DataFrame:
    """All rows with the step that removed them (1 low storeys, 2 and 3 IQR passes, 0 kept)."""
    start = with_storey_height(df)
    high_enough = F.coalesce(F.col("avg_h_storey") > MIN_STOREY_HEIGHT, F.lit(False))
    # both passes read two columns, written once; a fence table has one row per permitted floor count
    heights = checkpointed(start.where(high_enough).select("no_floors", "h_70p"))
    first = F.broadcast(_fences(heights, "h_70p", [0.25, 0.75]).withColumnRenamed("q", "_q1"))
    left = heights.join(first, "no_floors").where(~_beyond("h_70p", "_q1"))
    second = F.broadcast(_fences(left, "h_70p", [0.25, 0.75]).withColumnRenamed("q", "_q2"))
    flagged = start.join(first, "no_floors", "left").join(second, "no_floors", "left")
    step = F.when(~high_enough, 1).when(_beyond("h_70p", "_q1"), 2).when(_beyond("h_70p", "_q2"), 3).otherwise(0)
    return flagged.withColumn("removed_at_step", step).drop("_q1", "_q2")


def _beyond(attribute: str, fences: str) -> Column:
    """Further than 1.5 IQR outside the quartiles; values on a fence are not."""
    value, q1, q3 = F.col(attribute), F.col(fences)[0], F.col(fences)[1]
    reach = (q3 - q1) * IQR_REACH
    return (value < q1 - reach) | (value > q3 + reach)


def step_counts(stepped: DataFrame) -> DataFrame:
    return stepped.groupBy("removed_at_step").agg(F.count("*").alias("n"))


def automatic_labels(df: DataFrame) -> DataFrame:
    """Survivors of the height steps, marked clean."""
    needed = ["bag_id", "no_floors", "h_70p", "bag_function", "bag3d_roof_type"]
    kept = height_steps(complete_rows(df, needed)).where("removed_at_step = 0")
    return kept.withColumn("is_clean", F.lit("y"))


def high_rise_rejected() -> Column:
    """Above 17 recorded floors the storey height must lie within 2 to 4.5 m of the clean count."""
    storey = F.try_divide(F.col("h_70p"), F.col("clean_floors"))
    return (F.col("no_floors") > MAX_CLEANED_FLOORS) & ((storey > 4.5) | (storey < 2))


def volume_rejected() -> Column:
    """Footprint times height within a factor two of the volume; a NaN volume rejects, NULL keeps."""
    prism = F.col("footprint_area") * F.col("h_70p")
    volume = F.col("lod12_volume")
    return F.col("is_clean").isNotNull() & ((prism > volume * 2) | (prism * 2 < volume))


def area_rejected() -> Column:
    """Floor area per storey between 10 m² and 2.5 footprints."""
    per_floor = F.try_divide(F.col("bag_net_internal_area"), F.col("clean_floors"))
    return F.col("is_clean").isNotNull() & ((per_floor < 10) | (per_floor > F.col("footprint_area") * 2.5))


def _unless(rejected: Column, column: str) -> Column:
    return F.when(~F.coalesce(rejected, F.lit(False)), F.col(column))


def apply_plausibility(df: DataFrame) -> DataFrame:
    """High-rise, volume and area rules in this order; only the volume rule drops the count too."""
    step_1 = df.withColumn("is_clean", _unless(high_rise_rejected(), "is_clean"))
    step_2 = step_1.withColumn("_bad", volume_rejected()).withColumns({
        "is_clean": _unless(F.col("_bad"), "is_clean"), "clean_floors": _unless(F.col("_bad"), "clean_floors")}).drop("_bad")
    return step_2.withColumn("is_clean", _unless(area_rejected(), "is_clean"))

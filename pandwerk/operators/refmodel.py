"""Rule-of-thumb floor counts from height or area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AREA_OFFSET = 0.4


def with_reference_model(df: DataFrame, ceiling_height: float = 2.65) -> DataFrame:
    """Height-based, area-based and combined counts, rounded half-even and unrounded."""
    by_height = F.col("h_70p") / F.lit(float(ceiling_height))
    by_area = F.try_divide(F.col("bag_net_internal_area"), F.col("footprint_area"))
    return (df.withColumns({
        "floors_height_based": F.rint(by_height).cast("int"),
        "floors_height_based_unrounded": by_height,
        "floors_area_based": F.rint(by_area + F.lit(AREA_OFFSET)).cast("int"),
        "floors_area_based_unrounded": by_area})
        .withColumns({
            "ref_model": F.coalesce("floors_height_based", "floors_area_based"),
            "ref_model_unrounded": F.coalesce("floors_height_based_unrounded", "floors_area_based_unrounded")}))

"""Floor-count labels: standardising the suppliers' tables and their sanity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.scalar import pad_id

MAX_FLOORS = 48


def _label(bag_id, floors: Column, notes: Column) -> list[Column]:
    return [pad_id(bag_id).alias("bag_id"), floors.cast("int").alias("no_floors"), notes.alias("notes")]


def from_storey_range(df: DataFrame) -> DataFrame:
    """Total, highest and lowest storey; basements are taken off the total.

    With both storeys recorded the total must agree with their range. Equal highest and lowest
    storeys match no branch and give NULL, which the sanity rule drops.
    """
    total, high, low = F.col("aantalbouwlagen"), F.col("hoogstebouwlaag"), F.col("laagstebouwlaag")
    without_basement = total - F.abs(low)
    agrees = without_basement == high + 1
    range_rule = F.when(high > low, without_basement).when(high < low, total - F.abs(high))
    low_rule = (F.when(low >= 0, total)
                .when((low < 0) & (total >= F.abs(low)), without_basement))
    floors = (F.when(high.isNotNull(), F.when(agrees, range_rule))
              .when(low.isNull(), total)
              .otherwise(low_rule))
    notes = F.concat(F.coalesce("ligging", F.lit("")), F.lit("; "), F.coalesce("typewoonobject", F.lit("")))
    return df.select(*_label("identificatie", floors, notes))


def from_plain_counts(df: DataFrame) -> DataFrame:
    return df.select(*_label("pand_id", F.col("floors"), F.lit(None).cast("string")))


# Note texts that later rules match on.
FLAT_NOTE, HOUSE_NOTE, LEVEL_NOTE = "galerijflat; ", "woonhuis; ", "etage or woonlaag: "


def from_flats_and_houses(flats: DataFrame, houses: DataFrame) -> DataFrame:
    def text(*parts):
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p), F.lit("")) for i, p in enumerate(parts)])

    flat_notes = text(FLAT_NOTE + LEVEL_NOTE, "et_wl")
    house_notes = text(HOUSE_NOTE + LEVEL_NOTE, "et_wl", "; basement: ", "kelder_j_n", "; loft: ", "vliering_j_n")
    return (flats.select(*_label("pand_id", F.col("hoogste_bouwlaag"), flat_notes))
            .unionByName(houses.select(*_label("pand_id", F.col("aantalbouwlagen_pand"), house_notes))))


def from_unit_levels(df: DataFrame) -> DataFrame:
    """Highest unit level plus one; blank levels say nothing."""
    level = F.col("object_etageniveau")
    return (df.where(level != "").groupBy("pnd_id_bag").agg(F.max(level.cast("int")).alias("top"))
            .select(*_label("pnd_id_bag", F.col("top") + 1, F.lit(None).cast("string"))))


def plausible(df: DataFrame) -> DataFrame:
    return df.where(F.col("no_floors").between(1, MAX_FLOORS))


def correct_levels(df: DataFrame, corrections: DataFrame | None = None, apply_level_shift: bool = False) -> DataFrame:
    """Supplier-specific corrections on ids ``(bag_id, no_floors)``.

    The level shift for gallery flats is off by default because it has never had an effect on
    the published labels; turning it on applies the evident intent.
    """
    floors = F.col("no_floors")
    if apply_level_shift:
        is_flat = F.col("notes").contains(FLAT_NOTE.rstrip("; "))
        is_et, is_wl = F.col("notes").contains("ET"), F.col("notes").contains("WL")
        shifted = is_flat & (is_et | (is_wl & ((floors == 2) | (floors >= 7))))
        floors = F.when(shifted, floors + 1).otherwise(floors)
    out = df.withColumn("no_floors", floors)
    if corrections is None:
        return out
    fixes = corrections.groupBy("bag_id").agg(F.min("no_floors").alias("_fixed"))
    return (out.join(fixes, "bag_id", "left")
            .withColumn("no_floors", F.coalesce("_fixed", "no_floors")).drop("_fixed"))


def standardised(sources: dict[str, DataFrame]) -> DataFrame:
    """All suppliers in one frame with their name in ``data_source``."""
    frames = [df.withColumn("data_source", F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def merge_manual(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Append hand-checked labels: the recorded count where confirmed, else the observed one."""
    checked = manual.select(
        "bag_id", F.when(F.col("is_clean") == "y", F.col("td_floors")).otherwise(F.col("actual_floors"))
        .cast("int").alias("no_floors"), "is_clean")
    return automatic.select("bag_id", "no_floors", "is_clean").unionByName(checked)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Strict mode: fail when a key occurs twice."""
    found = duplicate_keys(df, key).limit(5).collect()
    if found:
        raise ValueError(f"duplicate {key}: {[r[key] for r in found]}")
    return df

"""Attribute enrichment of buildings from the registers.

Every source is reduced to one row per key before it is joined, so a left join never multiplies
rows, and all columns of one source travel in a single join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.joins import lookup
from pandwerk.operators import predicates

SENTINEL_YEAR = 1005
DWELLING = "woonfunctie"
OTHER_USE = "overige gebruiksfunctie"
# Dwelling types of the source and the four classes they map to.
BUILDING_TYPES = {
    "vrijstaande woning": "detached",
    "twee-onder-een-kap": "semi-detached",
    "hoekwoning": "terraced",
    "tussenwoning/geschakeld": "terraced",
    "appartement": "apartment",
}


def one_per_key(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` and then by the columns themselves, so that only equal rows tie.

    Combines map-side, so copies of a key cost nothing.
    """
    packed = F.struct(*columns)
    return (df.groupBy(key).agg(F.min_by(packed, F.struct(*order, *columns)).alias("_row"))
            .select(key, *[F.col("_row")[c].alias(c) for c in columns]))


def attach(base: DataFrame, *sources: DataFrame, on: str = "bag_id") -> DataFrame:
    """Left join sources that hold one row per key; unmatched rows keep NULLs."""
    return reduce(lambda df, src: df.join(src, on, "left"), sources, base)


def construction_year(c: Column) -> Column:
    return F.nullif(c, F.lit(SENTINEL_YEAR))


def cadastre_attributes(pand: DataFrame, where: Column | None = None) -> DataFrame:
    """Construction year and footprint from one scan; the lowest year wins among duplicates."""
    rows = pand.where(predicates.in_use_building() if where is None else where).select(
        F.col("identificatie").alias("bag_id"),
        construction_year(F.col("bouwjaar")).alias("bag_construction_year"),
        F.col("geom").alias("footprint_geom"), F.col("bouwjaar").alias("_y"))
    return one_per_key(rows, "bag_id", ["bag_construction_year", "footprint_geom"], ["_y"])


def _uses(c: Column) -> Column:
    return F.split(c, ", ")


def unit_attributes(units: DataFrame, where: Column | None = None) -> DataFrame:
    """Floor area, unit count, distinct uses and residential uses of a building in one aggregate.

    ``uses`` is NULL for a building without active units and empty when all uses are missing.
    Its state is the set of use texts, which a fixed code list bounds.
    """
    use = F.col("verblijfsobjectgebruiksdoel")
    residential = F.size(F.filter(_uses(use), lambda u: u == DWELLING))
    return (units.where(predicates.active_unit() if where is None else where)
            .groupBy(F.col("pandid").alias("bag_id"))
            .agg(F.sum("oppervlakteverblijfsobject").alias("bag_net_internal_area"),
                 F.count("adresseerbaarobject").cast("int").alias("bag_no_units"),
                 F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(use), _uses)))).alias("uses"),
                 F.sum(F.when(use.isNotNull(), residential)).cast("int").alias("residential_uses")))


def use_class(uses: Column) -> Column:
    """Use class of a building from its distinct uses; an empty array has no class."""
    has_dwelling = F.array_contains(uses, DWELLING)
    only_other = (F.size(uses) == 1) & F.array_contains(uses, OTHER_USE)
    return (F.when(uses.isNull(), "Unknown")
            .when(F.size(uses) == 0, None)
            .when(has_dwelling & (F.size(uses) == 1), "Residential")
            .when(has_dwelling, "Mixed-residential")
            .when(only_other, "Others")
            .when(F.size(uses) == 1, "Non-residential (single-function)")
            .otherwise("Non-residential (multi-function)"))


def residential_units(function: Column, residential_uses: Column, no_units: Column,
                      include_mixed: bool = False) -> Column:
    """Residential unit count, filled for residential buildings only unless asked otherwise."""
    wanted = function == "Residential"
    if include_mixed:
        wanted = wanted | ((function == "Mixed-residential") & (no_units != residential_uses))
    return F.when(wanted, residential_uses)


def with_use(base: DataFrame, units: DataFrame, include_mixed: bool = False, attributes: DataFrame | None = None) -> DataFrame:
    """Units, area, use class and residential units for every building of ``base``; ``attributes`` are those of the units,
    where they are written."""
    joined = attach(base, unit_attributes(units) if attributes is None else attributes)
    return (joined.withColumn("bag_function", use_class(F.col("uses")))
            .withColumn("bag_no_res_units", residential_units(
                F.col("bag_function"), F.col("residential_uses"), F.col("bag_no_units"), include_mixed))
            .drop("uses", "residential_uses"))


def register_3d(bag3d: DataFrame, where: Column | None = None) -> DataFrame:
    """Roof type, 3D id and ground height; ids are compared without their prefix."""
    rows = bag3d.where(predicates.in_use_3d() if where is None else where).select(
        F.expr("substring(identificatie, 15)").alias("bag_id"), F.col("dak_type").alias("bag3d_roof_type"),
        F.col("fid").alias("bag3d_id"), F.col("h_maaiveld").alias("bag3d_h_ground"))
    return one_per_key(rows, "bag_id", ["bag3d_roof_type", "bag3d_id", "bag3d_h_ground"], ["bag3d_id"])


def heights_above_ground(base: DataFrame, lod12_2d: DataFrame) -> DataFrame:
    """Height percentiles relative to the ground, joined on the 3D id."""
    names = {"h_min": "h_dak_min", "h_50p": "h_dak_50p", "h_70p": "h_dak_70p", "h_max": "h_dak_max"}
    source = one_per_key(lod12_2d.withColumnRenamed("fid", "bag3d_id"), "bag3d_id",
                         list(names.values()), ["h_dak_70p"])
    joined = lookup(base, source, ["bag3d_id"])
    return joined.withColumns({
        new: F.col(old) - F.col("bag3d_h_ground") for new, old in names.items()}).drop(*names.values())


def building_type(c: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in BUILDING_TYPES.items() for x in pair])
    return F.try_element_at(mapping, c)


def dwelling_types(esri: DataFrame) -> DataFrame:
    rows = esri.select(F.col("identificatie").alias("bag_id"),
                       building_type(F.col("woningtypering")).alias("esri_building_type"),
                       F.col("woningtypering").alias("_w"))
    return one_per_key(rows, "bag_id", ["esri_building_type"], ["_w"])


def case_study_ids(pand: DataFrame, municipality: str | None = None) -> DataFrame:
    """Distinct ids of buildings with the exact in-use status."""
    where = predicates.in_use_building(predicates.IN_USE_EXACT, municipality)
    return pand.where(where).select(F.col("identificatie").alias("bag_id")).distinct()

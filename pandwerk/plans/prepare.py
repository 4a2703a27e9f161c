"""The preparation job: labels to a feature table, as one chain of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed, settled
from pandwerk.operators import clean, enrich, footprints, labels, meshes, predicates, refmodel, spatial
from pandwerk.params import DEFAULTS, Params

# Census column -> feature name.
AREA_COLUMNS = {
    "bevolkingsdichtheid": "cbs_pop_per_km2",
    "percentage_meergezinswoning": "cbs_percent_multihousehold",
    "afstand_winkels": "cbs_shops_avg_dist",
    "afstand_supermarkt": "cbs_supermarket_avg_dist",
    "afstand_cafe": "cbs_cafe_avg_dist",
    "aantal_winkels_1km": "cbs_shops_avg_1km",
    "aantal_supermarkt_1km": "cbs_supermarket_avg_1km",
    "aantal_cafe_1km": "cbs_cafe_avg_1km",
}


@dataclass
class Registers:
    """Source tables of the preparation job."""

    pand: DataFrame
    units: DataFrame
    bag3d: DataFrame
    lod12_2d: DataFrame
    lod12_3d: DataFrame
    lod22_3d: DataFrame
    areas: DataFrame
    dwelling_types: DataFrame
    #: `enrich.unit_attributes` of the units, where they are written.
    unit_attributes: DataFrame | None = None


def enrich_ids(ids: DataFrame, reg: Registers, status_where: Column | None = None) -> DataFrame:
    """Residential buildings of ``ids`` with register, 3D and census attributes.

    The next two steps read their buildings more than once, so these are written.
    """
    used = enrich.with_use(ids, reg.units, attributes=reg.unit_attributes).where(predicates.residential())
    based = settled(lambda: enrich.attach(used, enrich.cadastre_attributes(reg.pand, status_where),
                                          enrich.register_3d(reg.bag3d), enrich.dwelling_types(reg.dwelling_types)))
    tall = settled(lambda: enrich.heights_above_ground(based, reg.lod12_2d))
    return spatial.attach_area_statistics(tall, reg.areas, AREA_COLUMNS, "buurtcode")


def add_footprint_features(df: DataFrame, reg: Registers, params: Params = DEFAULTS) -> DataFrame:
    # read by both spatial joins; neighbours are counted for the buildings that are asked for, among all
    asked = df.select("bag_id", F.lit(True).alias("_asked")).distinct()
    around = checkpointed(footprints.candidate_buildings(reg.pand, reg.units, attributes=reg.unit_attributes).join(asked, "bag_id", "left"))
    counted, target = footprints.countable(F.col("bag_function")), predicates.residential() & F.col("_asked")
    # each is written by itself, so that the shuffle files of one are gone before the next
    adjacent = settled(lambda: spatial.adjacent_counts(around, params.distance_adjacent, target, counted))
    near = settled(lambda: spatial.neighbour_counts(around, params.neighbour_radii, target, counted))
    measured = footprints.with_measures(df)
    return enrich.attach(measured, footprints.simplified_vertices(df), adjacent, near)


def add_mesh_features(df: DataFrame, reg: Registers, params: Params = DEFAULTS) -> DataFrame:
    return enrich.attach(df, meshes.lod12_features(df, reg.lod12_3d, params.voxel_scales["lod12"]),
                         meshes.lod22_features(df, reg.lod22_3d, params.voxel_scales["lod22"]))


def feature_table(ids: DataFrame, reg: Registers, params: Params = DEFAULTS, materialise: bool = True) -> DataFrame:
    """All features of the buildings in ``ids``; enriched rows are written once and reused.

    So are the rows with footprint features: both mesh tables look their buildings up in them, and would else repeat the
    spatial joins. A step's tables are deleted when the next one is written.
    """
    write = settled if materialise else (lambda build: build())

    def measured():
        known = reg
        if materialise and reg is not None:  # read by the enrichment and by the spatial joins
            known = replace(reg, unit_attributes=checkpointed(enrich.unit_attributes(reg.units)))
        enriched = write(lambda: enrich_ids(ids, known))
        return add_footprint_features(enriched, known, params)

    return write(lambda: add_mesh_features(write(measured), reg, params))


def clean_table(features: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Feature table with ``is_clean`` and ``clean_floors`` after all cleaning rules."""
    result = clean.automatic_labels(features)
    merged = labels.merge_manual(result, manual) if manual is not None else result.select("bag_id", "no_floors", "is_clean")
    imported = merged.select("bag_id", "is_clean", F.col("no_floors").alias("clean_floors"))
    return clean.apply_plausibility(features.join(imported, "bag_id", "left"))


def training_table(sources: dict[str, DataFrame], reg: Registers, manual: DataFrame | None = None,
                   params: Params = DEFAULTS, materialise: bool = True) -> DataFrame:
    """Standardised labels to cleaned features with the rule-of-thumb counts."""
    labelled = labels.plausible(labels.standardised(sources))
    features = feature_table(labelled, reg, params, materialise)
    return refmodel.with_reference_model(clean_table(features, manual), params.ceiling_height)


def case_study_table(ids: DataFrame, reg: Registers, params: Params = DEFAULTS, materialise: bool = True) -> DataFrame:
    return refmodel.with_reference_model(feature_table(ids, reg, params, materialise), params.ceiling_height)

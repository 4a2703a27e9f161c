"""Register and label tables of the registered queries, from the bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pandwerk.functions.lineage import checkpointed
from pandwerk.operators import labels
from pandwerk.plans.prepare import Registers
from pandwerk.sources import bindings as b


def written(spark, sf) -> dict[str, DataFrame]:
    """The building register written once, for jobs that read many registers derived from it."""
    return {"pand": checkpointed(b.flat(spark, sf, "pand"))}


def registers(spark, sf, given: dict[str, DataFrame] | None = None) -> Registers:
    return Registers(
        pand=b.pand(spark, sf, given), units=b.flat(spark, sf, "adres", given), bag3d=b.flat(spark, sf, "bag3d", given),
        lod12_2d=b.flat(spark, sf, "lod12_2d", given), lod12_3d=b.lod12_3d(spark, sf, given), lod22_3d=b.lod22_3d(spark, sf, given),
        areas=b.buurten(spark, sf, given), dwelling_types=b.flat(spark, sf, "esri", given))


def label_sources(spark, sf, given: dict[str, DataFrame] | None = None) -> dict:
    return {
        "c1_ams": labels.from_storey_range(b.flat(spark, sf, "label_c1", given)),
        "c2_rot": labels.from_plain_counts(b.flat(spark, sf, "label_c2", given)),
        "c3_dhg": labels.from_flats_and_houses(
            b.flat(spark, sf, "label_c3_flats", given), b.flat(spark, sf, "label_c3_houses", given)),
        "c4_rho": labels.from_unit_levels(b.flat(spark, sf, "label_c4", given)),
    }

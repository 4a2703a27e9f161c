"""2D footprint features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandwerk.functions import geom2d
from pandwerk.operators import predicates
from pandwerk.operators.enrich import one_per_key, unit_attributes, use_class

SIMPLIFY_TOLERANCE = 0.1


def with_measures(df: DataFrame, geom: str = "footprint_geom") -> DataFrame:
    g = F.col(geom)
    return df.withColumns({"footprint_area": geom2d.area(g), "footprint_perim": geom2d.perimeter(g)})


def with_centroid(df: DataFrame, geom: str = "footprint_geom") -> DataFrame:
    c = geom2d.centroid(F.col(geom))
    return df.withColumn("_c", c).withColumns({"x": F.col("_c")["x"], "y": F.col("_c")["y"]}).drop("_c")


def _simplified_size(points: np.ndarray, tolerance: float) -> int:
    """Points kept by Douglas-Peucker on a closed ring, at least four."""
    last = len(points) - 1
    keep = {0, last}
    stack = [(0, last)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1:b] - points[a]
        length2 = float(base @ base)
        t = np.clip(inner @ base / length2, 0.0, 1.0)[:, None] if length2 > 0 else 0.0
        gap = np.linalg.norm(inner - t * base, axis=1)
        far = int(gap.argmax())
        # a closed ring needs four points, so the first splits happen whatever the distance
        if gap[far] > tolerance or len(keep) < 4:
            mid = a + 1 + far
            keep.add(mid)
            stack += [(a, mid), (mid, b)]
    return len(keep)


def simplified_vertices(df: DataFrame, key: str = "bag_id", geom: str = "footprint_geom",
                        tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """Vertex count after simplification, closing points counted; runs on Arrow batches.

    Only the coordinates travel to Python, as flat arrays.
    """
    rows = df.where(F.col(geom).isNotNull()).select(
        key,
        F.flatten(F.transform(geom, lambda r: F.transform(r, lambda p: p["x"]))).alias("xs"),
        F.flatten(F.transform(geom, lambda r: F.transform(r, lambda p: p["y"]))).alias("ys"),
        F.transform(geom, lambda r: F.size(r)).alias("sizes"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            totals = []
            for xs, ys, sizes in zip(batch["xs"], batch["ys"], batch["sizes"]):
                rings = np.split(np.column_stack([xs, ys]), np.cumsum(sizes)[:-1])
                totals.append(float(sum(_simplified_size(r, tolerance) for r in rings)))
            yield pd.DataFrame({key: batch[key], "footprint_no_vertices": totals})

    schema = T.StructType([df.schema[key], T.StructField("footprint_no_vertices", T.DoubleType())])
    return rows.mapInPandas(count, schema)


def municipality_extent(areas: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Parts of a municipality taken together: number, area and buffered bounding box."""
    b = areas.withColumn("_b", geom2d.bbox(F.col("geom")))
    return b.groupBy("gemeentecode").agg(
        F.count("*").alias("parts"), F.sum(geom2d.area(F.col("geom"))).alias("area"),
        (F.min("_b.xmin") - buffer).alias("xmin"), (F.min("_b.ymin") - buffer).alias("ymin"),
        (F.max("_b.xmax") + buffer).alias("xmax"), (F.max("_b.ymax") + buffer).alias("ymax"))


def within_municipality(df: DataFrame, areas: DataFrame, buffer: float, size: float = 500.0,
                        key: str = "bag_id", geom: str = "footprint_geom") -> DataFrame:
    """Buildings that meet any part of a municipality grown by ``buffer`` (mitred)."""
    from pandwerk.operators.pieces import area_join

    grow = geom2d.part_buffer if geom2d.is_multi_part(areas, "geom") else geom2d.mitre_buffer
    grown = areas.select(F.col("gemeentecode").alias("_code"), grow(F.col("geom"), buffer).alias("_area"))
    met = area_join(df.select(key, F.col(geom).alias("_geom")), grown, "_geom", "_area", size)
    return met.groupBy(key).agg(F.min("_code").alias("near_gemeente"))


def candidate_buildings(pand: DataFrame, units: DataFrame, region: list | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """All in-use buildings of a region with use class and centroid, one row per id; ``attributes`` are those of the units,
    where they are written."""
    rows = pand.where(predicates.in_use_building(predicates.IN_USE_ANYWHERE, region=region)).select(
        F.col("identificatie").alias("bag_id"), F.col("geom").alias("footprint_geom"), F.col("bouwjaar").alias("_y"))
    unique = one_per_key(rows, "bag_id", ["footprint_geom"], ["_y"])
    classes = (unit_attributes(units) if attributes is None else attributes).select("bag_id", "uses")
    joined = unique.join(classes, "bag_id", "left").withColumn("bag_function", use_class(F.col("uses"))).drop("uses")
    return with_centroid(joined)


def countable(function: Column) -> Column:
    """Classes that count as a neighbour; an undecided class does not."""
    return (function != "Others") & (function != "Unknown")


def vertex_total(geom: Column) -> Column:
    return geom2d.n_points(geom)

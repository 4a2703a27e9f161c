"""Register predicates as columns, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pandwerk.functions import geom2d

ACTIVE_UNIT_STATUSES = (
    "Verblijfsobject in gebruik", "Verblijfsobject in gebruik (niet ingemeten)", "Verblijfsobject gevormd")
# '%' spellings in use: label enrichment, region candidates, case study.
IN_USE_PREFIX = "Pand in gebruik%"
IN_USE_ANYWHERE = "%Pand in gebruik%"
IN_USE_EXACT = "Pand in gebruik"


def in_use_building(status_pattern: str = IN_USE_PREFIX, municipality: str | None = None, region: list | None = None,
                    status="pandstatus", end="einddatumtijdvakgeldigheid", key="identificatie", geom="geom") -> Column:
    """Building currently registered as in use, optionally within a municipality or a polygon."""
    test = F.col(status).like(status_pattern) & F.col(end).isNull()
    if municipality is not None:
        test = test & (F.substring(key, 1, 4) == municipality)
    if region is not None:
        test = test & region_clip(F.col(geom), region)
    return test


def active_unit(municipality: str | None = None, statuses=ACTIVE_UNIT_STATUSES,
                status="verblijfsobjectstatus", key="pandid") -> Column:
    test = F.col(status).isin(*statuses)
    return test if municipality is None else test & (F.substring(key, 1, 4) == municipality)


def in_use_3d(municipality: str | None = None, status="status", end="eindgeldigheid", key="identificatie") -> Column:
    """3D register rows; ids carry a 14-character prefix, so the municipality code starts at 15."""
    test = F.col(status).cast("string").like(IN_USE_PREFIX) & F.col(end).isNull()
    return test if municipality is None else test & (F.substring(key, 15, 4) == municipality)


def census_of(municipality: str, code="gemeentecode") -> Column:
    return F.substring(code, 3, 4) == municipality


def residential(function="bag_function") -> Column:
    """Residential and mixed-residential; an undecided (NULL) class survives."""
    f = F.col(function)
    return ~F.coalesce((f != "Residential") & (f != "Mixed-residential"), F.lit(False))


def region_clip(geom: Column, rings: list, box: Column | None = None) -> Column:
    """Geometry meets a caller-supplied polygon; the box test runs before the exact one."""
    region = geom2d.polygon_literal(rings)
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    b = geom2d.bbox(geom) if box is None else box
    near = ((b["xmin"] <= max(xs)) & (b["xmax"] >= min(xs)) & (b["ymin"] <= max(ys)) & (b["ymax"] >= min(ys)))
    return F.when(near, geom2d.intersects(geom, region)).otherwise(F.lit(False))

"""Measures and predicates on footprints: ``array<ring>``, ring 0 outer, the rest holes.

A ring is a closed ``array<struct<x,y>>``. Coordinates are metres in a national grid, so sums
are taken relative to a local origin to keep precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ring_edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                              b["x"].alias("bx"), b["y"].alias("by")))


def edges(geom: Column) -> Column:
    """All boundary segments of all rings in one array."""
    return F.flatten(F.transform(geom, _ring_edges))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + term(v))


def _ring_moments(ring: Column, origin: Column) -> Column:
    """(twice signed area, 6·area·cx, 6·area·cy) of a ring about ``origin`` in one pass."""
    ox, oy = origin["x"], origin["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, e):
        cross = (e["ax"] - ox) * (e["by"] - oy) - (e["bx"] - ox) * (e["ay"] - oy)
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (e["ax"] + e["bx"] - ox * 2) * cross).alias("mx"),
            (acc["my"] + (e["ay"] + e["by"] - oy * 2) * cross).alias("my"))

    return F.aggregate(_ring_edges(ring), zero, step)


def ring_signed_area2(ring: Column) -> Column:
    o = ring[0]
    return _sum(_ring_edges(ring), lambda e: (e["ax"] - o["x"]) * (e["by"] - o["y"])
                - (e["bx"] - o["x"]) * (e["ay"] - o["y"]))


def area(geom: Column) -> Column:
    """Outer area minus the holes."""
    parts = F.transform(geom, lambda r, i: F.abs(ring_signed_area2(r)) / 2 * F.when(i == 0, 1.0).otherwise(-1.0))
    return F.when(geom.isNotNull(), _sum(parts, lambda v: v))


def perimeter(geom: Column) -> Column:
    """Length of all rings, holes included."""
    return F.when(geom.isNotNull(), _sum(edges(geom), lambda e: F.sqrt(
        (e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"]))))


def is_multi_part(df: DataFrame, geom: str) -> bool:
    """Whether a column holds arrays of polygons rather than one polygon (an array of rings)."""
    return df.schema[geom].dataType.simpleString().startswith("array<array<array<")


def part_areas(parts: Column) -> Column:
    """Area of a multi-part geometry: the sum over its polygons, each less its holes."""
    return F.when(parts.isNotNull(), _sum(F.transform(parts, area), lambda v: v))


def part_perimeters(parts: Column) -> Column:
    return F.when(parts.isNotNull(), _sum(F.transform(parts, perimeter), lambda v: v))


def part_centroid(parts: Column) -> Column:
    """Area-weighted mean of the polygons' centroids."""
    weighed = F.transform(parts, lambda g: F.struct(area(g).alias("a"), centroid(g).alias("c")))
    total = _sum(weighed, lambda w: w["a"])
    mean = lambda k: F.try_divide(_sum(weighed, lambda w: w["a"] * w["c"][k]), total)
    return F.when(parts.isNotNull(), F.struct(mean("x").alias("x"), mean("y").alias("y")))


def part_buffer(parts: Column, distance: float, mitre_limit: float = 5.0) -> Column:
    """Every polygon grown on its own; grown parts may overlap."""
    return F.transform(parts, lambda g: mitre_buffer(g, distance, mitre_limit))


def n_points(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda acc, r: acc + F.size(r))


def centroid(geom: Column) -> Column:
    """Area-weighted centroid as ``struct<x,y>``."""
    origin = geom[0][0]
    moments = F.transform(geom, lambda r, i: F.transform(
        F.array(_ring_moments(r, origin)),
        lambda m: F.struct(*[
            (m[k] * F.when((m["a"] < 0) == (i == 0), -1.0).otherwise(1.0)).alias(k)
            for k in ("a", "mx", "my")]))[0])
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    total = F.aggregate(moments, zero, lambda acc, m: F.struct(
        *[(acc[k] + m[k]).alias(k) for k in ("a", "mx", "my")]),
        lambda s: F.struct(F.try_divide(s["mx"], s["a"] * 3).alias("x"),
                           F.try_divide(s["my"], s["a"] * 3).alias("y")))
    return F.transform(F.array(total), lambda t: F.struct(
        (t["x"] + origin["x"]).alias("x"), (t["y"] + origin["y"]).alias("y")))[0]


def bbox(geom: Column) -> Column:
    """``struct<xmin,ymin,xmax,ymax>`` of the outer ring."""
    outer = geom[0]
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bbox_overlaps(a: Column, b: Column) -> Column:
    return ((a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"])
            & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"]))


def mitre_buffer(geom: Column, distance: float, mitre_limit: float = 5.0) -> Column:
    """Outline moved outwards by ``distance`` with mitred corners.

    Corners reach further than the distance itself; spikes are held at ``mitre_limit`` times it.
    """
    d = float(distance)

    def offset_ring(ring: Column, is_outer: Column) -> Column:
        orientation = F.when((ring_signed_area2(ring) > 0) == is_outer, d).otherwise(-d)
        distinct = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
        sized = F.array(F.struct(distinct.alias("p"), orientation.alias("d")))

        def normals(s):
            return F.transform(_ring_edges(s["p"]), lambda e: F.transform(
                F.array(F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"])
                               + (e["by"] - e["ay"]) * (e["by"] - e["ay"]))),
                lambda length: F.struct(((e["by"] - e["ay"]) / length).alias("x"),
                                        ((e["ax"] - e["bx"]) / length).alias("y"),
                                        e["ax"].alias("px"), e["ay"].alias("py")))[0])

        def corners(ns, d_col):
            n = F.size(ns)
            before = F.concat(F.slice(ns, n, F.lit(1)), F.slice(ns, F.lit(1), n - 1))

            def corner(m, k):
                dot = m["x"] * k["x"] + m["y"] * k["y"]
                sx, sy = m["x"] + k["x"], m["y"] + k["y"]
                # |sum| / (1 + dot) is the mitre length per metre of offset
                length = F.sqrt(F.lit(2.0) / F.greatest(F.lit(1.0) + dot, F.lit(1e-12)))
                held = F.least(F.lit(1.0), F.lit(mitre_limit) / length)
                scale = d_col * held / F.greatest(F.lit(1.0) + dot, F.lit(1e-12))
                return F.struct((k["px"] + scale * sx).alias("x"), (k["py"] + scale * sy).alias("y"))

            return F.zip_with(before, ns, corner)

        with_normals = F.transform(sized, lambda s: F.struct(normals(s).alias("ns"), s["d"].alias("d")))
        open_ring = F.transform(with_normals, lambda s: corners(s["ns"], s["d"]))[0]
        return F.transform(F.array(open_ring), lambda r: F.concat(r, F.slice(r, 1, 1)))[0]

    return F.transform(geom, lambda r, i: offset_ring(r, i == 0))


def _cross(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _segments_meet(s: Column, t: Column) -> Column:
    """Closed segments share a point: boxes overlap and each straddles the other's line."""
    boxes = ((F.greatest(s["ax"], s["bx"]) >= F.least(t["ax"], t["bx"]))
             & (F.greatest(t["ax"], t["bx"]) >= F.least(s["ax"], s["bx"]))
             & (F.greatest(s["ay"], s["by"]) >= F.least(t["ay"], t["by"]))
             & (F.greatest(t["ay"], t["by"]) >= F.least(s["ay"], s["by"])))

    def side(seg, x, y):
        return F.signum(_cross(seg["ax"], seg["ay"], seg["bx"], seg["by"], x, y))

    return (boxes & (side(t, s["ax"], s["ay"]) * side(t, s["bx"], s["by"]) <= 0)
            & (side(s, t["ax"], t["ay"]) * side(s, t["bx"], t["by"]) <= 0))


def contains_point(geom_edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings, so a point in a hole is outside."""
    crossings = F.filter(geom_edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (
        x < e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])))
    return F.size(crossings) % 2 == 1


def intersects(a: Column, b: Column) -> Column:
    """Polygons share at least a boundary point. Call after a bounding-box test."""
    ea, eb = edges(a), edges(b)
    touch = F.exists(ea, lambda s: F.exists(eb, lambda t: _segments_meet(s, t)))
    # the cheap tests first: most polygons that meet hold a corner of each other
    return (contains_point(eb, a[0][0]["x"], a[0][0]["y"])
            | contains_point(ea, b[0][0]["x"], b[0][0]["y"]) | touch)


def polygon_literal(rings: list[list[tuple[float, float]]]) -> Column:
    """A caller-supplied region as a constant column; rings are closed here when open."""
    def ring(points):
        closed = list(points) if points[0] == points[-1] else [*points, points[0]]
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in closed])
    return F.array(*[ring(r) for r in rings])

"""Expressions on building meshes: ``array<struct<sem, ring array<struct<x,y,z>>>>``.

A mesh lives in one row, so every measure is row-local and needs no shuffle. Checks, areas and volumes run on whole
Arrow batches of meshes.
Surface codes: 1 roof, 2 wall.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pandwerk.functions import mesh_arrays
from pandwerk.functions.scalar import linear_percentile, round_half_even

ROOF, WALL = 1, 2


def open_ring(ring: Column) -> Column:
    """Ring without its closing point."""
    return F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))


def fan(ring: Column) -> Column:
    """Triangles (a, b, c) that fan out from the first vertex."""
    n = F.size(ring)
    count = F.greatest(n - 3, F.lit(0))
    a = ring[0]
    return F.zip_with(F.slice(ring, F.lit(2), count), F.slice(ring, F.lit(3), count),
                      lambda b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))


def polygon_area(ring: Column) -> Column:
    """Planar polygon area by the length of its vector area; under three points gives 0."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])

    def step(acc, t):
        ux, uy, uz = (t["b"][k] - t["a"][k] for k in "xyz")
        vx, vy, vz = (t["c"][k] - t["a"][k] for k in "xyz")
        return F.struct((acc["x"] + uy * vz - uz * vy).alias("x"),
                        (acc["y"] + uz * vx - ux * vz).alias("y"),
                        (acc["z"] + ux * vy - uy * vx).alias("z"))

    return F.aggregate(fan(ring), zero, step, lambda s: F.sqrt(
        s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"]) / 2)


def surface_area(faces: Column, sem: int) -> Column:
    return mesh_arrays.surface_area(faces, sem)


def _vertex_key(p: Column) -> Column:
    """64-bit key of a vertex; zero has one sign."""
    return F.xxhash64(*[p[k] + F.lit(0.0) for k in "xyz"])


def _count_sorted(values: Column, start: Column) -> Column:
    """Number of different values, from sorted neighbours. ``start`` is a value of the same type."""
    state = F.struct(start.alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(values), state, lambda s, v: F.struct(
        v.alias("last"), (s["n"] + F.when((s["n"] > 0) & (v == s["last"]), 0).otherwise(1)).alias("n")), lambda s: s["n"])


def vertex_count(faces: Column) -> Column:
    """Number of different vertices."""
    return mesh_arrays.vertex_count(faces)


def _sorted_vertex_count(faces: Column) -> Column:
    """The same as an expression."""
    corners = F.flatten(F.transform(faces, lambda f: open_ring(f["ring"])))
    points = F.transform(corners, lambda p: F.struct(*[(p[k] + F.lit(0.0)).alias(k) for k in "xyz"]))
    return F.when(faces.isNotNull(), _count_sorted(points, F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])))


def closed_volume(faces: Column) -> Column:
    """Volume enclosed by outward faces, with coordinates taken from the first vertex."""
    return mesh_arrays.closed_volume(faces)


def bounds(faces: Column) -> Column:
    points = F.flatten(F.transform(faces, lambda f: f["ring"]))
    return F.struct(*[
        agg(F.transform(points, lambda p: p[k])).alias(k + suffix)
        for k in "xyz" for suffix, agg in (("min", F.array_min), ("max", F.array_max))])


def _edge_codes(faces: Column) -> Column:
    """``struct<e,r,n>``: directed edges and their reverses as 64-bit keys, and the number of vertices, as an expression.

    Vertices and edges are known by hashes, so that large meshes cost sorts and hash sets only. The keys are checked:
    there must be as many as different vertices and edges. Else vertices are numbered one by one.
    """
    rings = F.transform(faces, lambda f: F.transform(f["ring"], _vertex_key))
    corners = F.flatten(F.transform(faces, lambda f: open_ring(f["ring"])))

    def steps(ring):
        n = F.size(ring)
        return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
                          lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def keyed(p):
        e = F.transform(p, lambda s: F.xxhash64(s["a"], s["b"]))
        r = F.transform(p, lambda s: F.xxhash64(s["b"], s["a"]))
        both = F.concat(p, F.transform(p, lambda s: F.struct(s["b"].alias("a"), s["a"].alias("b"))))
        return F.struct(e.alias("e"), r.alias("r"), F.size(F.array_distinct(F.transform(corners, _vertex_key))).alias("n"),
                        _count_sorted(both, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).alias("edges"))

    hashed = F.transform(F.array(F.flatten(F.transform(rings, steps))), keyed)
    def checked(h):
        sound = (_sorted_vertex_count(faces) == h["n"]) & (F.size(F.array_distinct(F.concat(h["e"], h["r"]))) == h["edges"])
        return F.when(sound, F.struct(h["e"].alias("e"), h["r"].alias("r"), h["n"].alias("n"))).otherwise(_numbered_edges(faces))

    return F.transform(hashed, checked)[0]


def _numbered_edges(faces: Column) -> Column:
    """The same over positions of vertices; every corner is looked up among all of them."""
    held = F.array(F.struct(F.array_distinct(F.flatten(F.transform(faces, lambda f: open_ring(f["ring"])))).alias("v")))

    def numbered(s):
        rings = F.transform(faces, lambda f: F.transform(f["ring"], lambda p: F.array_position(s["v"], p)))

        def of_ring(ring, forward):
            n = F.size(ring)
            step = lambda a, b: (a * 2**31 + b) if forward else (b * 2**31 + a)
            return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), step)

        return F.transform(F.array(rings), lambda rs: F.struct(
            F.flatten(F.transform(rs, lambda r: of_ring(r, True))).alias("e"),
            F.flatten(F.transform(rs, lambda r: of_ring(r, False))).alias("r"),
            F.size(s["v"]).alias("n")))[0]

    return F.transform(held, numbered)[0]


def quality(faces: Column) -> Column:
    """``struct<n_vertices, open_edges, codes>``; no codes means a closed two-manifold.

    Each directed edge must be paired with its reverse exactly once.
    """
    return mesh_arrays.quality(faces)


def roof_and_wall_heights(faces: Column) -> Column:
    """``struct<roof,wall>``, 3 decimals: the sorted maxima of the roof faces, and the different heights of wall corners."""
    roof = F.transform(F.filter(faces, lambda f: f["sem"] == ROOF), lambda f: round_half_even(
        F.array_max(F.transform(open_ring(f["ring"]), lambda p: p["z"])), 3))
    wall = F.transform(F.flatten(F.transform(F.filter(faces, lambda f: f["sem"] == WALL),
                                             lambda f: open_ring(f["ring"]))),
                       lambda p: round_half_even(p["z"], 3))
    return F.struct(F.array_sort(roof).alias("roof"), F.array_distinct(wall).alias("wall"))


def ridge_and_eaves(faces: Column, roof_type: Column, h_ground: Column) -> Column:
    """`ridge_and_eaves_of` a mesh."""
    return ridge_and_eaves_of(roof_and_wall_heights(faces), roof_type, h_ground)


def ridge_and_eaves_of(heights: Column, roof_type: Column, h_ground: Column) -> Column:
    """``struct<ridge,eaves>`` above ground, 3 decimals, from `roof_and_wall_heights`; NULLs when the mesh has no roof face.

    The roof list keeps one maximum per roof face; wall heights are a set. Slanted roofs take the
    median of wall heights that are not roof heights and lie above ground, roofs with several
    levels the 75th percentile of the roof list, all others the ridge.
    """
    def above_ground(s):
        free = F.array_sort(F.filter(F.array_except(s["wall"], s["roof"]), lambda z: z > h_ground))
        ridge = round_half_even(linear_percentile(s["roof"], 0.9) - h_ground, 3)
        slanted = round_half_even(linear_percentile(free, 0.5) - h_ground, 3)
        stepped = round_half_even(linear_percentile(s["roof"], 0.75) - h_ground, 3)
        eaves = (F.when(F.size(s["roof"]) == 0, None)
                 .when(roof_type == "slanted", F.coalesce(slanted, ridge))
                 .when(roof_type == "multiple horizontal", stepped).otherwise(ridge))
        return F.struct(ridge.alias("ridge"), eaves.alias("eaves"))

    return F.transform(F.array(heights), above_ground)[0]

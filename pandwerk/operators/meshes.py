"""Features of 3D building meshes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandwerk.functions import mesh3d
from pandwerk.functions.joins import possibly_among
from pandwerk.functions.lineage import checkpointed
from pandwerk.functions.scalar import nan_to_null, round_half_even

# Fallback volumes above this multiple of the bounding prism are held at the prism.
MAX_OVER_BOUND = 1.1
#: Tasks of the scale study per core.
TASKS_PER_CORE = 4
STUDY_SCALES = (50, 75, 100, 125, 150, 175, 200, 225, 250)


def _checked(lod_3d: DataFrame) -> DataFrame:
    return lod_3d.where(F.col("val3dity_codes").isNotNull()).select(F.col("fid").alias("bag3d_id"), "faces")


def _wanted(buildings: DataFrame) -> DataFrame:
    return buildings.select("bag_id", "bag3d_id", "bag3d_roof_type", "bag3d_h_ground")


def _one_per_id(checked: DataFrame) -> DataFrame:
    """Of several meshes of an id the one with the smallest array of faces. Ids are counted from their column alone, and a mesh
    whose id occurs once is not shuffled."""
    repeated = checkpointed(checked.groupBy("bag3d_id").agg(F.count("*").alias("_n")).where("_n > 1").select("bag3d_id"))
    if repeated.limit(1).count() == 0:
        return checked
    once = checked.join(repeated, "bag3d_id", "left_anti")
    several = checked.join(repeated, "bag3d_id", "left_semi").groupBy("bag3d_id").agg(F.min("faces").alias("faces"))
    return once.unionByName(several)


def fetch(buildings: DataFrame, lod_3d: DataFrame) -> DataFrame:
    """Meshes of buildings through the 3D id, one per building; unchecked meshes are left out."""
    return _wanted(buildings).join(_one_per_id(_checked(lod_3d)), "bag3d_id").drop("bag3d_id")


def _measured(buildings: DataFrame, lod_3d: DataFrame, prefix: str, scale: int, keep: dict[str, Column]) -> DataFrame:
    """`volumes` and ``keep`` of the meshes that `fetch` gives. Meshes are measured where they lie and only the measures are
    shuffled to the buildings; a bitmap of the buildings' ids leaves out most of the others."""
    near = possibly_among(_checked(lod_3d), "bag3d_id", buildings.select("bag3d_id"))
    return _wanted(buildings).join(volumes(_one_per_id(near), prefix, scale, keep, "bag3d_id"), "bag3d_id").drop("bag3d_id")


def height_columns(prefix: str = "lod22") -> dict[str, Column]:
    """Ridge, eaves and their difference from a ``ridge_and_eaves`` struct named ``_h``."""
    return {f"{prefix}_h_ridge": F.col("_h.ridge"), f"{prefix}_h_eaves": F.col("_h.eaves"),
            f"{prefix}_href_diff": F.col("_h.ridge") - F.col("_h.eaves")}


def height_references(meshes: DataFrame, prefix: str = "lod22") -> DataFrame:
    heights = mesh3d.ridge_and_eaves(F.col("faces"), F.col("bag3d_roof_type"), F.col("bag3d_h_ground"))
    return meshes.select("bag_id", heights.alias("_h")).select(
        "bag_id", *[c.alias(n) for n, c in height_columns(prefix).items()])


def area_columns(prefix: str) -> dict[str, Column]:
    return {f"{prefix}_area_{name}": round_half_even(mesh3d.surface_area(F.col("faces"), sem), 3)
            for name, sem in (("walls", mesh3d.WALL), ("roof", mesh3d.ROOF))}


def surface_areas(meshes: DataFrame, prefix: str) -> DataFrame:
    return meshes.select("bag_id", *[c.alias(n) for n, c in area_columns(prefix).items()])


def quality(meshes: DataFrame) -> DataFrame:
    """Per mesh: distinct vertices, open edges, error codes and validity."""
    return (meshes.withColumn("_q", mesh3d.quality(F.col("faces"))).select(
        *meshes.columns, "_q.n_vertices", "_q.open_edges", "_q.codes", (F.size("_q.codes") == 0).alias("is_valid")))


def quality_report(checked: DataFrame) -> DataFrame:
    """Invalid count and rate, and how often each code occurs, over the whole table."""
    codes = F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("valid"))))
    per_code = checked.select(codes.alias("code"), "is_valid").groupBy("code").agg(F.count("*").alias("meshes"))
    totals = checked.agg(F.count("*").alias("total"), F.count_if(~F.col("is_valid")).alias("invalid"))
    # the totals are one row
    return per_code.crossJoin(F.broadcast(totals)).withColumn(
        "percent_invalid", round_half_even(F.col("invalid") / F.col("total") * 100, 1))


def _level_faces(t: np.ndarray) -> list[tuple]:
    """Triangles that are not upright: twice their area seen from above, the first corner, the other two from there and their box."""
    out = []
    for (ax, ay, az), (bx, by, bz), (cx, cy, cz) in t.tolist():
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        if d != 0:
            out.append((d, ax, ay, az, bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az,
                        min(ax, bx, cx), max(ax, bx, cx), min(ay, by, cy), max(ay, by, cy)))
    return out


def _crossings(faces: list[tuple], pitch: float, room: np.ndarray):
    """(columns, rows, hit, heights in micrometres, free room) of every triangle over the part of the grid its box covers."""
    for d, ax, ay, az, bx, by, bz, cx, cy, cz, x0, x1, y0, y1 in faces:
        x0, x1 = math.ceil(x0 / pitch - 0.5), math.floor(x1 / pitch - 0.5) + 1
        y0, y1 = math.ceil(y0 / pitch - 0.5), math.floor(y1 / pitch - 0.5) + 1
        if x1 <= x0 or y1 <= y0:
            continue
        shape = x1 - x0, y1 - y0
        wb, wc, free = (r[:shape[0] * shape[1]].reshape(shape) for r in room)
        x, y = ((np.arange(x0, x1) + 0.5) * pitch - ax)[:, None], ((np.arange(y0, y1) + 0.5) * pitch - ay)[None, :]
        np.subtract(x * cy, y * cx, out=wb)
        wb /= d
        np.subtract(bx * y, by * x, out=wc)
        wc /= d
        hit = wb >= -1e-12
        hit &= wc >= -1e-12
        hit &= np.add(wb, wc, out=free) <= 1 + 1e-12
        if bz == 0 and cz == 0:
            height = np.rint(az * 1e6)
        else:
            wb *= bz
            wb += az
            wc *= cz
            wb += wc
            wb *= 1e6
            height = np.rint(wb, out=wb)
        yield slice(x0, x1), slice(y0, y1), hit, height, free


def _column_volumes(t: np.ndarray, scales) -> list[float]:
    """Volume of one mesh at each scale, ``t`` holding triangles as (n, 3 corners, 3 coordinates).

    Vertical columns stand at the centres of a grid spaced at the box diagonal over the scale.
    The gaps between successive crossings of a column are alternately inside and outside; one
    with an odd number of crossings is taken as open towards the lowest point of the mesh.
    A column that is crossed once, or twice at different heights, is settled on the grid; the crossings of the others are sorted.
    """
    t = t - t.reshape(-1, 3).min(axis=0)
    far = t.reshape(-1, 3).max(axis=0)
    diagonal, faces = float(np.linalg.norm(far)), _level_faces(t)
    out = []
    for scale in scales:
        pitch = diagonal / scale
        if pitch <= 0:
            out.append(0.0)
            continue
        shape = int(far[0] / pitch) + 2, int(far[1] / pitch) + 2
        room = np.empty((3, shape[0] * shape[1]))
        apart, count = np.zeros(shape), np.zeros(shape, np.uint8)
        for xs, ys, hit, height, free in _crossings(faces, pitch, room):
            held, met = apart[xs, ys], count[xs, ys]
            np.abs(np.subtract(held, height, out=free), out=free)
            np.copyto(held, free, where=hit)
            np.minimum(met, 3, out=met)
            met += hit
        several = (count > 2) | (count == 2) & (apart == 0)
        apart[several] = 0
        total = float(apart.sum()) + (_sorted_columns(faces, pitch, room, several, far[2]) if several.any() else 0.0)
        out.append(total / 1e6 * pitch * pitch)
    return out


def _sorted_columns(faces: list[tuple], pitch: float, room: np.ndarray, wanted: np.ndarray, top: float) -> float:
    """Summed inner gaps, in micrometres, of the wanted columns."""
    columns, heights = [], []
    for xs, ys, hit, height, _ in _crossings(faces, pitch, room):
        at = np.nonzero(hit & wanted[xs, ys])
        columns.append((at[0] + xs.start) * wanted.shape[1] + at[1] + ys.start)
        heights.append(np.broadcast_to(height, hit.shape)[at])
    # a column through a shared edge meets both triangles at one height, which counts once;
    # column and height (in micrometres) share one integer so that a plain sort orders both
    span = int(top * 1e6) + 2
    codes = np.sort(np.concatenate(columns) * span + np.concatenate(heights).astype(np.int64))
    codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
    column, height = codes // span, codes % span
    start = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    n = np.diff(np.r_[start, len(codes)])
    place = np.arange(len(codes)) - np.repeat(start, n) + np.repeat(n % 2, n)
    return float(np.where(place % 2 == 1, height, -height).sum())


def _flat_triangles(faces: Column) -> Column:
    triangles = F.flatten(F.transform(faces, lambda f: mesh3d.fan(f["ring"])))
    return F.flatten(F.transform(triangles, lambda t: F.array(*[t[c][k] for c in "abc" for k in "xyz"])))


def _with_sampled(rows: DataFrame) -> DataFrame:
    """Replace ``_t`` (flat triangle coordinates, or NULL) and ``_scale`` by ``sampled_volume``, an array for an array of scales.

    Row-local on Arrow batches; the other columns pass through.
    """
    kept = [c for c in rows.columns if c not in ("_t", "_scale")]
    kind = T.ArrayType(T.DoubleType()) if isinstance(rows.schema["_scale"].dataType, T.ArrayType) else T.DoubleType()
    several = kind != T.DoubleType()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[kept].copy()
            found = [None if t is None else _column_volumes(np.asarray(t, dtype=float).reshape(-1, 3, 3), s if several else (s,))
                     for t, s in zip(batch["_t"], batch["_scale"])]
            out["sampled_volume"] = found if several else pd.Series([None if v is None else v[0] for v in found], out.index, float)
            yield out

    schema = T.StructType([*[rows.schema[k] for k in kept], T.StructField("sampled_volume", kind)])
    return rows.mapInPandas(measure, schema)


def sampled_volume(meshes: DataFrame, scale: Column | int, extra_keys: tuple = ()) -> DataFrame:
    """Volume from vertical columns through each mesh."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return _with_sampled(meshes.select(
        "bag_id", *extra_keys, _flat_triangles(F.col("faces")).alias("_t"), scale.cast("double").alias("_scale")))


def prism_bound(faces: Column) -> Column:
    return F.transform(F.array(mesh3d.bounds(faces)), lambda b: (
        (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]) * (b["zmax"] - b["zmin"])))[0]


def held_at_bound(volume: Column, bound: Column) -> Column:
    return F.when(volume > F.lit(MAX_OVER_BOUND) * bound, bound).otherwise(volume)


def volumes(meshes: DataFrame, prefix: str, scale: int, keep: dict[str, Column] | None = None, key: str = "bag_id") -> DataFrame:
    """Exact volume of valid meshes, sampled volume of the others, NaN where neither exists.

    A missing volume is NaN rather than NULL: later rules tell "no usable mesh" from "no mesh".
    A mesh is checked once, without Python; only the broken ones then hand their triangles to it.
    Both parts come from one written table and nothing is shuffled. ``keep`` adds further columns
    computed from the same mesh.
    """
    faces = F.col("faces")
    keep = keep or {}
    solid = (F.size("_q.codes") == 0) & (F.col("_q.n_vertices") > 3)
    broken = (F.size("_q.codes") > 0) & (F.col("_q.n_vertices") > 3)
    checked = checkpointed(meshes.withColumn("_q", mesh3d.quality(faces)).select(
        key, *[c.alias(n) for n, c in keep.items()],
        F.when(solid, mesh3d.closed_volume(faces)).alias("_exact"),
        F.when(broken, prism_bound(faces)).alias("_bound"),
        F.when(broken, _flat_triangles(faces)).alias("_t"), F.lit(float(scale)).alias("_scale")))
    sampled = _with_sampled(checked.where(F.col("_t").isNotNull())).unionByName(
        checked.where(F.col("_t").isNull()).drop("_t", "_scale").withColumn("sampled_volume", F.lit(None).cast("double")))
    fallback = held_at_bound(nan_to_null(F.col("sampled_volume")), F.col("_bound"))
    volume = round_half_even(F.coalesce(F.col("_exact"), fallback), 3)
    return sampled.select(key, *keep, F.coalesce(volume, F.lit(float("nan"))).alias(f"{prefix}_volume"))


def lod12_features(buildings: DataFrame, lod_3d: DataFrame, scale: int) -> DataFrame:
    """Surface areas and volume of the buildings' meshes in one pass over these."""
    found = _measured(buildings, lod_3d, "lod12", scale, area_columns("lod12"))
    return found.select("bag_id", *area_columns("lod12"), "lod12_volume")


def lod22_features(buildings: DataFrame, lod_3d: DataFrame, scale: int) -> DataFrame:
    """Height references, surface areas and volume of the buildings' meshes in one pass over these."""
    found = _measured(buildings, lod_3d, "lod22", scale, {"_z": mesh3d.roof_and_wall_heights(F.col("faces")), **area_columns("lod22")})
    heights = mesh3d.ridge_and_eaves_of(F.col("_z"), F.col("bag3d_roof_type"), F.col("bag3d_h_ground"))
    return found.withColumn("_h", heights).select("bag_id", *[c.alias(n) for n, c in height_columns("lod22").items()],
                                                  *area_columns("lod22"), "lod22_volume")


def scale_study(meshes: DataFrame, scales=STUDY_SCALES) -> DataFrame:
    """Sampled against exact volume of valid meshes at each scale, in long form."""
    # measured once and dealt anew: sampling takes far longer than its rows are wide, so their size shall not set the tasks
    valid = quality(meshes).where("is_valid AND n_vertices > 3").select(
        "bag_id", round_half_even(mesh3d.closed_volume(F.col("faces")), 3).alias("mesh_volume"), _flat_triangles(F.col("faces")).alias("_t"))
    dealt = valid.repartition(TASKS_PER_CORE * meshes.sparkSession.sparkContext.defaultParallelism, "bag_id")
    # a mesh travels to Python once for all scales
    each = _with_sampled(dealt.withColumn("_scale", F.array(*[F.lit(float(s)) for s in scales])))
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in scales]).alias("scale"), F.col("sampled_volume").alias("volume")))
    return each.select("bag_id", "mesh_volume", pairs.alias("_p")).select(
        "bag_id", F.col("_p.scale").alias("scale"), "mesh_volume", round_half_even(F.col("_p.volume"), 3).alias("sampled_volume"))

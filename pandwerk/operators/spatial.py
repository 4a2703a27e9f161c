"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions import geom2d
from pandwerk.functions.joins import lookup
from pandwerk.functions.lineage import checkpointed
from pandwerk.operators.crowds import LISTED_CELLS, meeting_weights, near_weights
from pandwerk.operators.pieces import area_join

# Sub-cells per side at each refinement of a cell.
REFINE = 16
# Parts into which the seekers around a cell are dealt; a cell's sub-cells are repeated for each.
SALTS = 8
# Side of a block in which neighbours are counted, in largest radii; locations in a task; locations that make a block crowded.
BLOCK_SIDE = 8
PACK = 60_000
CROWD = 30_000


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def with_cells(df: DataFrame, box: str, size: float) -> DataFrame:
    """One row per grid cell that the bounding box touches."""
    b = F.col(box)
    xs = F.sequence(cell_of(b["xmin"], size), cell_of(b["xmax"], size))
    ys = F.sequence(cell_of(b["ymin"], size), cell_of(b["ymax"], size))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def single_parts(df: DataFrame, geom: str) -> DataFrame:
    """One row per polygon of a multi-part geometry (array of polygons); other rows as they are."""
    return df.withColumn(geom, F.explode(geom)) if geom2d.is_multi_part(df, geom) else df


def attach_area_statistics(buildings: DataFrame, areas: DataFrame, columns: dict[str, str], area_key: str,
                           key: str = "bag_id", geom: str = "footprint_geom", size: float = 500.0) -> DataFrame:
    """Statistics of the area a footprint meets; the lowest area key wins when there are several.

    ``columns`` maps area columns to output names; all of them come from the same single join.
    """
    wanted = areas.select(F.col(area_key).alias("_area"), F.col("geom").alias("_area_geom"),
                          *[F.col(src).alias(out) for src, out in columns.items()])
    placed = buildings.where(F.col(geom).isNotNull()).select(key, F.col(geom).alias("_geom"))
    pairs = area_join(placed, wanted, "_geom", "_area_geom", size)
    chosen = pairs.groupBy(key).agg(F.min_by(F.struct(*columns.values()), "_area").alias("_row"))
    flat = chosen.select(key, *[F.col("_row")[c].alias(c) for c in columns.values()])
    return buildings.join(flat, key, "left")


def adjacent_counts(buildings: DataFrame, distance: float, target: Column, candidate: Column,
                    key: str = "bag_id", geom: str = "footprint_geom", size: float = 32.0) -> DataFrame:
    """Per target building, other candidate buildings whose footprint meets its mitred buffer.

    ``buildings`` holds targets and candidates in one frame. A target outside the candidate
    classes counts zero, one without a footprint stays NULL. Identical footprints are joined
    once and weighted, so a group of copies does not pair with itself; a building always meets
    its own buffer and is taken off. Footprints are known by a digest, so that only the cells' tasks
    get geometry; a crowded cell is dealt to as many tasks as its counts ask for and swept.
    """
    rows = buildings.select(
        key, F.col(geom).alias("_g"), F.coalesce(target, F.lit(False)).alias("_target"),
        F.coalesce(candidate, F.lit(False)).alias("_candidate")).where("_target OR _candidate")
    rows = rows.withColumn("_d", F.when(F.col("_g").isNotNull(), F.md5(F.to_json("_g").cast("binary"))))
    shapes = checkpointed(rows.where(F.col("_d").isNotNull()).groupBy("_d").agg(
        F.first("_g").alias("_g"), F.max(F.col("_target") & F.col("_candidate")).alias("_wanted"),
        F.count_if("_candidate").alias("_weight")))
    grown = (shapes.where("_wanted").select(F.col("_d").alias("_ld"), geom2d.mitre_buffer(F.col("_g"), distance).alias("_buffer"))
             .withColumn("_lbox", geom2d.bbox(F.col("_buffer"))))
    others = (shapes.where("_weight > 0").select(F.col("_g").alias("_rg"), "_weight")
              .withColumn("_rbox", geom2d.bbox(F.col("_rg"))))
    met = meeting_weights(grown, others, "_ld", "_buffer", "_rg", "_weight", "_lbox", "_rbox", size).select(
        F.col("_ld").alias("_d"), F.col("met").alias("_met"))
    count = F.when(F.col("_d").isNotNull(), F.when(F.col("_candidate"), F.col("_met") - 1).otherwise(0))
    # written: both sides of the look-up read the digests
    return (lookup(checkpointed(rows.where("_target").select(key, "_candidate", "_d")), met, ["_d"])
            .select(key, count.cast("int").alias("footprint_no_adjacent")))


def neighbour_counts(points: DataFrame, radii: tuple, target: Column, candidate: Column, key: str = "bag_id",
                     x: str = "x", y: str = "y", crowd: int = CROWD) -> DataFrame:
    """Per target point, other candidate points within each radius (inclusive), all radii in one join.

    A target outside the candidate classes counts zero, one without a location stays NULL. Points are reduced to weighted
    distinct locations. A location travels to the square block it lies in and to blocks within reach of it, and is counted
    whole in its own block, block by block on sorted arrays. Blocks of more than ``crowd`` locations are opened into
    sub-cell totals instead, so that no block emits all its pairs, however many locations it holds.
    """
    r_max = float(max(radii))
    size = r_max * BLOCK_SIDE
    rows = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"),
                         F.coalesce(target, F.lit(False)).alias("_target"),
                         F.coalesce(candidate, F.lit(False)).alias("_candidate"))
    known = rows.where(F.col("_candidate") & F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # written once: the blocks are counted before they are dealt
    locations = checkpointed(known.groupBy("_x", "_y").agg(F.count("*").alias("_n"), F.max("_target").alias("_wanted")))
    blocks = _reached(locations, r_max, size, ("_bx", "_by")).withColumn(
        "_own", (cell_of(F.col("_x"), size) == F.col("_bx")) & (cell_of(F.col("_y"), size) == F.col("_by")))
    held = checkpointed(blocks.groupBy("_bx", "_by").agg(F.count("*").alias("_held"), F.max(F.col("_own") & F.col("_wanted")).alias("_asked")))
    asked = held.where("_asked")
    number = asked.count()
    if 2 * number < held.count():  # most blocks have nobody who asks, so their locations do not travel
        blocks = blocks.join(_few(asked.select("_bx", "_by"), number), ["_bx", "_by"], "left_semi")
    crowded = asked.where(F.col("_held") > crowd).select("_bx", "_by")
    packs = max(1, math.ceil(locations.count() / PACK))
    found = crowded.count()
    quiet = blocks.join(_few(crowded, found), ["_bx", "_by"], "left_anti") if found else blocks
    totals = near_weights(quiet, tuple(radii), size, packs)
    if found:
        packed = blocks.join(_few(crowded, found), ["_bx", "_by"])
        seekers = _reached(packed.where("_own AND _wanted").select("_x", "_y"), r_max, r_max, ("cx", "cy")).select(
            F.col("_x").alias("_px"), F.col("_y").alias("_py"), "cx", "cy")
        around = checkpointed(packed.select("_x", "_y", "_n").distinct().withColumn("cx", cell_of(F.col("_x"), r_max))
                              .withColumn("cy", cell_of(F.col("_y"), r_max)))
        totals = totals.unionByName(_counts_by_sub_cells(seekers, around, radii, r_max).groupBy("_px", "_py")
                                    .agg(*[F.sum(f"_r{r}").alias(f"_r{r}") for r in radii]))
    totals = totals.withColumnsRenamed({"_px": "_x", "_py": "_y"})
    placed = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return (lookup(rows.where("_target"), totals, ["_x", "_y"])
            .select(key, *[F.when(placed, F.when(F.col("_candidate"), F.col(f"_r{r}") - 1).otherwise(0)).cast("int")
                           .alias(f"footprint_no_neighbours_{r}m") for r in radii]))


def _reached(locations: DataFrame, reach: float, size: float, names: tuple[str, str]) -> DataFrame:
    """One row per location and square cell within ``reach`` (at most one cell's side) of it."""
    cx, cy = cell_of(F.col("_x"), size), cell_of(F.col("_y"), size)
    around = F.array(*[F.struct((cx + i).alias("i"), (cy + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = F.filter(around, lambda o: _box_distance2(
        F.col("_x"), F.col("_y"), o["i"] * size, o["j"] * size, (o["i"] + 1) * size, (o["j"] + 1) * size) <= reach * reach * (1 + 1e-9))
    return (locations.withColumn("_o", F.explode(near))
            .select(*locations.columns, F.col("_o.i").alias(names[0]), F.col("_o.j").alias(names[1])))


def _few(blocks: DataFrame, n: int) -> DataFrame:
    return F.broadcast(blocks) if n <= LISTED_CELLS else blocks


def _box_distance2(px, py, xmin, ymin, xmax, ymax) -> Column:
    gx = F.greatest(xmin - px, px - xmax, F.lit(0.0))
    gy = F.greatest(ymin - py, py - ymax, F.lit(0.0))
    return gx * gx + gy * gy


def _far_distance2(px, py, xmin, ymin, xmax, ymax) -> Column:
    gx, gy = F.greatest(px - xmin, xmax - px), F.greatest(py - ymin, ymax - py)
    return gx * gx + gy * gy


def _counts_by_sub_cells(seekers: DataFrame, locations: DataFrame, radii: tuple, r_max: float) -> DataFrame:
    """Counts of locations within each radius, from totals of ever smaller sub-cells.

    A sub-cell wholly within or beyond every radius is settled by its total and the extent of
    its contents; only sub-cells cut by a circle are opened further. Seekers are salted, and the
    few sub-cells of a parent are repeated per salt, so a hot cell spreads over several tasks, which adaptive execution splits further.
    """
    sizes = [r_max / REFINE, r_max / REFINE**2]
    parent_cols = ["cx", "cy"]
    open_pairs = seekers
    settled = []
    for level, size in enumerate(sizes):
        child_cols = [f"sx{level}", f"sy{level}"]
        located = locations.withColumn(child_cols[0], cell_of(F.col("_x"), size)).withColumn(
            child_cols[1], cell_of(F.col("_y"), size))
        children = located.groupBy(*parent_cols, *child_cols).agg(
            F.sum("_n").alias("_n"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
            F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
        salt = F.pmod(F.xxhash64("_px", "_py"), F.lit(SALTS)).cast("int")
        pairs = (open_pairs.withColumn("_salt", salt)
                 .join(children.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
                       [*parent_cols, "_salt"]))
        box = [F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")]
        pairs = (pairs.withColumn("_near", _box_distance2(F.col("_px"), F.col("_py"), *box))
                 .withColumn("_far", _far_distance2(F.col("_px"), F.col("_py"), *box)))
        cut = reduce(lambda a, b: a | b, [(F.col("_near") <= float(r) ** 2) & (F.col("_far") > float(r) ** 2) for r in radii])
        settled.append(pairs.where(~cut).groupBy("_px", "_py").agg(*[
            F.sum(F.when(F.col("_far") <= float(r) ** 2, F.col("_n")).otherwise(0)).alias(f"_r{r}") for r in radii]))
        open_pairs = pairs.where(cut).select("_px", "_py", *child_cols)
        locations, parent_cols = located, child_cols
    dx, dy = F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py")
    exact = (open_pairs.join(locations.select(*parent_cols, "_x", "_y", "_n"), parent_cols)
             .withColumn("_d2", dx * dx + dy * dy).groupBy("_px", "_py").agg(*[
                 F.sum(F.when(F.col("_d2") <= float(r) ** 2, F.col("_n")).otherwise(0)).alias(f"_r{r}") for r in radii]))
    return reduce(DataFrame.unionByName, [*settled, exact])

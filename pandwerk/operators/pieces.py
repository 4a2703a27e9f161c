"""Large areas cut into the pieces that grid cells need.

A cell gets only those edges of an area that pass through it, and whether the area covers one point of the cell. That is
enough to test any polygon within the cell, so what is shuffled follows the length of the outline and the number of cells
covered, not their product. Cells that the area covers whole carry no edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandwerk.functions import geom2d

#: Where in a cell the known point lies, as a share of the cell's side: off any round coordinate.
POINT = (0.41421356237309503, 0.7320508075688772)
#: Tasks per core in which areas are cut; pieces and edges written at a time.
TASKS, TOGETHER = 4, 50_000
EDGE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ax", "ay", "bx", "by")])


def _steps(low, high):
    """(row, value) for all whole values from low[row] to high[row]."""
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(low)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def cut(edges: np.ndarray, size: float):
    """Yield (cx, cy, places of edges, whether the cell's point is covered) of every cell an area meets.

    ``edges``: rows ax, ay, bx, by of all rings. A cell that an edge only touches gets it as well.
    """
    ax, ay, bx, by = edges
    cell = lambda v: np.floor(v / size).astype(np.int64)
    # columns of cells that an edge spans, then the rows it reaches within each column; both with neighbours it may touch
    edge, cx = _steps(cell(np.minimum(ax, bx)), cell(np.maximum(ax, bx)))
    x0, x1 = np.maximum(np.minimum(ax, bx)[edge], cx * size), np.minimum(np.maximum(ax, bx)[edge], (cx + 1) * size)
    run = (bx - ax)[edge]
    flat = run == 0
    slope = np.where(flat, 0.0, (by - ay)[edge] / np.where(flat, 1.0, run))
    y0, y1 = (np.where(flat, v, ay[edge] + (x - ax[edge]) * slope) for v, x in ((ay[edge], x0), (by[edge], x1)))
    slack = 1e-9 * (np.abs(y0) + np.abs(y1) + size)
    some, cy = _steps(cell(np.minimum(y0, y1) - slack), cell(np.maximum(y0, y1) + slack))
    edge, cx = edge[some], cx[some]
    order = np.lexsort((edge, cx, cy))
    edge, cx, cy = edge[order], cx[order], cy[order]
    held: dict = {}
    first = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]) if len(cx) else np.empty(0, np.int64)
    for low, high in zip(first, np.r_[first[1:], len(cx)]):
        held[int(cx[low]), int(cy[low])] = edge[low:high]
    xs = np.arange(cell(min(ax.min(), bx.min())), cell(max(ax.max(), bx.max())) + 1)
    for row in range(int(cell(min(ay.min(), by.min()))), int(cell(max(ay.max(), by.max()))) + 1):
        py = (row + POINT[1]) * size
        crossing = (ay > py) != (by > py)
        at = np.sort(ax[crossing] + (py - ay[crossing]) / (by[crossing] - ay[crossing]) * (bx[crossing] - ax[crossing]))
        covered = np.searchsorted(at, (xs + POINT[0]) * size) % 2 == 1
        for c, inside in zip(xs.tolist(), covered.tolist()):
            mine = held.get((c, row))
            if inside or mine is not None:
                yield c, row, mine if mine is not None else np.empty(0, np.int64), inside


def area_pieces(areas: DataFrame, geom: str, size: float) -> DataFrame:
    """One row per area and cell it meets: the other columns, cx, cy, `edges` and `covered`. Areas without geometry
    have none; a multi-part area is cut part by part. Areas are dealt evenly to a fixed number of tasks per core, as cutting
    takes far longer than reading them."""
    from pandwerk.operators.spatial import single_parts

    single = single_parts(areas.where(F.col(geom).isNotNull()), geom)
    others = [c for c in areas.columns if c != geom]
    tasks = TASKS * areas.sparkSession.sparkContext.defaultParallelism
    rows = single.repartition(tasks).select(*others, geom2d.edges(F.col(geom)).alias("_e"))
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()),
                           T.StructField("edges", T.ArrayType(EDGE)), T.StructField("covered", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int64)
            fields = np.stack([column.values.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")])
            owners, found, n = [], [], 0
            for i in range(batch.num_rows):
                edges = fields[:, ends[i]:ends[i + 1]]
                if edges.shape[1]:
                    for cx, cy, places, covered in cut(edges, size):
                        owners.append(i)
                        found.append((cx, cy, places + ends[i], covered))
                        n += len(places)
                if found and (n + len(found) > TOGETHER or i == batch.num_rows - 1):
                    places = np.concatenate([f[2] for f in found])
                    offsets = np.concatenate([[0], np.cumsum([len(f[2]) for f in found])]).astype(np.int32)
                    items = pa.StructArray.from_arrays([pa.array(v[places]) for v in fields], names=["ax", "ay", "bx", "by"])
                    repeated = batch.select(others).take(pa.array(owners, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*repeated.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets), items), pa.array([f[3] for f in found], pa.bool_())],
                        names=[*others, "cx", "cy", "edges", "covered"])
                    owners, found, n = [], [], 0

    return rows.mapInArrow(run, schema)


def _covers(edges: Column, covered: Column, cx: Column, cy: Column, x: Column, y: Column, size: float) -> Column:
    """Whether the area covers a point of the cell: the known point's answer turned by every edge on the way from it,
    up or down first and then across."""
    px, py = (cx + F.lit(POINT[0])) * F.lit(size), (cy + F.lit(POINT[1])) * F.lit(size)

    def between(v, a, b):
        return (v >= F.least(a, b)) & (v < F.greatest(a, b))

    upright = F.filter(edges, lambda e: ((e["ax"] > px) != (e["bx"] > px)) & between(
        e["ay"] + F.try_divide(px - e["ax"], e["bx"] - e["ax"]) * (e["by"] - e["ay"]), py, y))
    level = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & between(
        e["ax"] + F.try_divide(y - e["ay"], e["by"] - e["ay"]) * (e["bx"] - e["ax"]), px, x))
    return ((F.size(upright) + F.size(level)) % 2 == 1) != covered


def area_join(left: DataFrame, areas: DataFrame, left_geom: str, area_geom: str, size: float) -> DataFrame:
    """Rows of ``left`` with the other columns of each area they share at least a boundary point with.

    A pair comes once for every cell and part in which it is found. Column names must be disjoint.
    """
    from pandwerk.operators.spatial import cell_of, single_parts, with_cells

    size = float(size)
    parts = single_parts(left.where(F.col(left_geom).isNotNull()), left_geom)
    placed = with_cells(parts.withColumn("_lbox", geom2d.bbox(F.col(left_geom))), "_lbox", size)
    pieces = area_pieces(areas, area_geom, size)
    own, corner = geom2d.edges(F.col(left_geom)), F.col(left_geom)[0][0]
    here = (cell_of(corner["x"], size) == F.col("cx")) & (cell_of(corner["y"], size) == F.col("cy"))
    inside = here & _covers(F.col("edges"), F.col("covered"), F.col("cx"), F.col("cy"), corner["x"], corner["y"], size)
    near = F.filter("edges", lambda e: (F.greatest(e["ax"], e["bx"]) >= F.col("_lbox.xmin")) & (F.least(e["ax"], e["bx"]) <= F.col("_lbox.xmax"))
                    & (F.greatest(e["ay"], e["by"]) >= F.col("_lbox.ymin")) & (F.least(e["ay"], e["by"]) <= F.col("_lbox.ymax")))
    meets = F.exists(near, lambda e: F.exists(own, lambda o: geom2d._segments_meet(e, o)) | geom2d.contains_point(own, e["ax"], e["ay"]))
    return (placed.join(pieces, ["cx", "cy"]).where(F.coalesce(inside | meets, F.lit(False)))
            .drop("cx", "cy", "edges", "covered", "_lbox"))

"""Which polygons meet, for cells of any crowding: count-driven dealing and a sweep in each task.

Cells are counted first. A cell with few boxes shares a task with others; a crowded one is dealt to as many tasks as its
counts ask for, each getting one block of its left and one of its right polygons. Within a task polygons are swept in
the order of their boxes' left sides, so only boxes that overlap are tested, and tests run on flat arrays of edges.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed

#: Polygons of one side in a block of a crowded cell; a task tests one block against another.
BLOCK = 1_000
#: Polygons in a task that holds many quiet cells.
PACK = 40_000
#: Crowded cells are looked up by broadcast up to this number of them (a few numbers each), else by a join.
LISTED_CELLS = 100_000
#: Pairs of boxes and of edges tested at a time.
PAIRS, EDGES = 200_000, 2_000_000
#: Slack of the sweep; the boxes are compared exactly afterwards.
SLACK = 1e-6


def _flat(geom: Column) -> list[Column]:
    """Coordinates of all rings one after the other, and the rings' sizes."""
    return [F.flatten(F.transform(geom, lambda r: F.transform(r, lambda p: p["x"]))).alias("xs"),
            F.flatten(F.transform(geom, lambda r: F.transform(r, lambda p: p["y"]))).alias("ys"),
            F.transform(geom, lambda r: F.size(r)).alias("rings")]


def meeting_weights(left: DataFrame, right: DataFrame, key: str, left_geom: str, right_geom: str, weight: str, left_box: str,
                    right_box: str, size: float) -> DataFrame:
    """(key, met): per left polygon the summed weight of right polygons that share at least a boundary point with it.

    A pair whose boxes overlap in several cells is tested in the cell that holds the lower-left corner of the overlap.
    Left polygons that meet none are left out.
    """
    def cells(df, box, geom, side, name, weigh):
        b = F.col(box)
        at = lambda v: F.floor(v / F.lit(float(size))).cast("bigint")
        return df.select(F.lit(side).alias("side"), name.cast("string").alias("name"), weigh.cast("double").alias("weight"),
                         *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], *_flat(F.col(geom))).withColumn(
            "cx", F.explode(F.sequence(at(F.col("xmin")), at(F.col("xmax"))))).withColumn(
            "cy", F.explode(F.sequence(at(F.col("ymin")), at(F.col("ymax")))))

    rows = checkpointed(cells(left, left_box, left_geom, 0, F.col(key), F.lit(0)).unionByName(
        cells(right, right_box, right_geom, 1, F.lit(None), F.col(weight))))
    counts = rows.groupBy("cx", "cy").agg(F.count_if(F.col("side") == 0).alias("nl"), F.count_if(F.col("side") == 1).alias("nr"))
    crowded = checkpointed(counts.where(F.greatest("nl", "nr") > BLOCK).select(
        "cx", "cy", F.ceil(F.col("nl") / BLOCK).cast("int").alias("bl"), F.ceil(F.col("nr") / BLOCK).cast("int").alias("br")))
    listed = F.broadcast(crowded) if crowded.count() <= LISTED_CELLS else crowded
    packs = max(1, math.ceil(rows.count() / PACK))
    dealt = rows.join(listed, ["cx", "cy"], "left")
    own, other = (F.when(F.col("side") == s, F.col("bl")).otherwise(F.col("br")) for s in (0, 1))
    # every block meets every block of the other side in one task
    mine = F.pmod(F.xxhash64("xs", "ys"), own).cast("int")
    quiet = dealt.where("bl is null").withColumn("task", F.pmod(F.xxhash64("cx", "cy"), F.lit(packs)).cast("string"))
    # a crowded cell without the other side has nothing to test
    busy = dealt.where("bl > 0 and br > 0").withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1))).withColumn("_mine", mine)
    busy = busy.withColumn("task", F.concat_ws(
        ":", "cx", "cy", F.when(F.col("side") == 0, F.col("_mine")).otherwise(F.col("_other")),
        F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_mine"))))
    columns = ["task", "side", "name", "weight", "xmin", "ymin", "xmax", "ymax", "xs", "ys", "rings", "cx", "cy"]

    def run(table):
        import pyarrow as pa

        names, met = swept(table, float(size))
        return pa.table({"name": pa.array(names, pa.string()), "met": pa.array(met, pa.float64())})

    found = quiet.select(*columns).unionByName(busy.select(*columns)).groupBy("task").applyInArrow(run, "name string, met double")
    return found.groupBy(F.col("name").alias(key)).agg(F.sum("met").cast("bigint").alias("met"))


class _Side:
    """Boxes, cells and edges of the polygons of one side of a task."""

    def __init__(self, table):
        self.n = table.num_rows
        get = lambda c: table.column(c).to_numpy()
        self.box = {c: get(c) for c in ("xmin", "ymin", "xmax", "ymax")}
        self.cx, self.cy, self.weight = get("cx"), get("cy"), get("weight")
        self.names = table.column("name")
        xs, ys, rings = (table.column(c).combine_chunks() for c in ("xs", "ys", "rings"))
        x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys))
        points = np.diff(xs.offsets.to_numpy())
        sizes = rings.flatten().to_numpy(zero_copy_only=False)
        last = np.zeros(len(x), bool)  # a ring's last point starts no edge
        last[np.cumsum(sizes) - 1] = True
        start = np.flatnonzero(~last)
        owner = np.repeat(np.arange(self.n), points)[start]
        self.edges = np.stack([x[start], y[start], x[start + 1], y[start + 1]]) if len(start) else np.empty((4, 0))
        self.count = np.bincount(owner, minlength=self.n)
        self.first = np.cumsum(self.count) - self.count
        self.corner = np.cumsum(points) - points
        self.x, self.y = x, y


def near_weights(blocks: DataFrame, radii: tuple, size: float, packs: int) -> DataFrame:
    """(_px, _py, _r<radius>, ...): the summed weight of locations within each radius of every wanted location.

    ``blocks``: distinct locations _x, _y with a weight _n, repeated for every block _bx, _by within the largest radius; in
    one of them a location is `_own`. Blocks share ``packs`` tasks.
    """
    def run(table):
        import pyarrow as pa

        at, sums = near_sums(table, radii, size)
        return pa.table([pa.array(c) for c in (*at, *sums.astype(np.int64))], names=["_px", "_py", *[f"_r{r}" for r in radii]])

    task = F.pmod(F.xxhash64("_bx", "_by"), F.lit(packs)).cast("int")
    schema = ", ".join(["_px double", "_py double", *[f"_r{r} long" for r in radii]])
    return blocks.select(task.alias("task"), "_bx", "_by", "_x", "_y", "_n", (F.col("_own") & F.col("_wanted")).alias("_seeks")).groupBy(
        "task").applyInArrow(run, schema)


def near_sums(table, radii: tuple, size: float):
    """Places of the seekers of a task and the weights within each radius (inclusive), block by block.

    Locations are sorted by block, strip and place along the strip; a seeker meets a range of three strips, and every
    location of the ranges is tested.
    """
    get = lambda c: table.column(c).to_numpy()
    bx, by, x, y, weight = (get(c) for c in ("_bx", "_by", "_x", "_y", "_n"))
    seeks = np.flatnonzero(table.column("_seeks").to_numpy())
    reach = float(max(radii))
    block = np.unique(np.stack([bx, by]), axis=1, return_inverse=True)[1].ravel()
    # strips a little wider than the largest radius; the first and last of a block lie outside it
    strips = math.ceil(size / reach) + 5
    strip = block * strips + np.clip(np.floor((y - by * size) / (reach * (1 + SLACK))).astype(np.int64) + 2, 1, strips - 2)
    along, width = x - bx * size, 2 * size + 8 * reach
    place = strip * width + along
    order = np.argsort(place, kind="stable")
    place, xs, ys, weight = place[order], x[order], y[order], weight[order].astype(np.float64)
    sums = np.zeros((len(radii), len(seeks)))
    slack = SLACK * reach + 4e-15 * (place[-1] if len(place) else 0.0)
    for shift in (-1, 0, 1):
        middle = (strip[seeks] + shift) * width + along[seeks]
        low = np.searchsorted(place, middle - reach - slack)
        high = np.searchsorted(place, middle + reach + slack, side="right")
        for i, j in _spans(low, high):
            if not len(i):
                continue
            dx, dy = xs[j] - x[seeks[i]], ys[j] - y[seeks[i]]
            d2 = dx * dx + dy * dy
            first, last = i[0], i[-1] + 1
            for k, r in enumerate(radii):
                sums[k, first:last] += np.bincount(i - first, weights=weight[j] * (d2 <= float(r) ** 2), minlength=last - first)
    return (x[seeks], y[seeks]), sums


def _spans(low, high):
    """Pairs (row, place) for all places low[row] <= place < high[row], in portions."""
    number = np.maximum(high - low, 0)
    ends = np.cumsum(number)
    at = 0
    while at < len(low):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        n = number[at:to]
        row = np.repeat(np.arange(at, to), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        yield row, place
        at = to


def swept(table, size: float):
    """Names of the left polygons of a task that meet right ones, and the weight they meet."""
    import pyarrow.compute as pc

    left, right = (_Side(table.filter(pc.equal(table.column("side"), s))) for s in (0, 1))
    met = np.zeros(left.n)
    if left.n and right.n:
        cells = np.unique(np.stack([np.concatenate([left.cx, right.cx]), np.concatenate([left.cy, right.cy])]), axis=1, return_inverse=True)[1]
        cells = cells.ravel()
        width = 4 * (size + 1)

        def start(side, number):  # boxes enter the sweep at their left side or at the cell's
            return number * width + np.maximum(side.box["xmin"] - side.cx * size, 0.0)

        def end(side, number):
            return number * width + np.minimum(side.box["xmax"] - side.cx * size, size)

        sl, sr = start(left, cells[:left.n]), start(right, cells[left.n:])
        el, er = end(left, cells[:left.n]), end(right, cells[left.n:])
        by_right, by_left = np.argsort(sr, kind="stable"), np.argsort(sl, kind="stable")
        # a right box that starts within a left one, then a left box that starts within a right one
        starts = np.searchsorted(sr[by_right], sl - SLACK), np.searchsorted(sr[by_right], el + SLACK, side="right")
        for i, place in _spans(*starts):
            _count(left, right, i, by_right[place], met, size)
        starts = np.searchsorted(sl[by_left], sr - SLACK), np.searchsorted(sl[by_left], er + SLACK, side="right")
        for j, place in _spans(*starts):
            i = by_left[place]
            later = sr[j] < sl[i] - SLACK  # the others were met from the left
            _count(left, right, i[later], j[later], met, size)
    hit = np.flatnonzero(met)
    return left.names.take(hit), met[hit]


def _count(left: _Side, right: _Side, i, j, met, size: float) -> None:
    """Add the weights of those pairs that meet and whose overlap starts in their cell."""
    a, b = left.box, right.box
    x, y = np.maximum(a["xmin"][i], b["xmin"][j]), np.maximum(a["ymin"][i], b["ymin"][j])
    keep = ((x <= np.minimum(a["xmax"][i], b["xmax"][j])) & (y <= np.minimum(a["ymax"][i], b["ymax"][j]))
            & (left.cx[i] == right.cx[j]) & (left.cy[i] == right.cy[j])
            & (np.floor(x / size) == left.cx[i]) & (np.floor(y / size) == left.cy[i]))
    i, j = i[keep], j[keep]
    number = left.count[i] * right.count[j]
    ends, at = np.cumsum(number), 0
    while at < len(i):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + EDGES, side="right")))
        some_i, some_j = i[at:to], j[at:to]
        hit = _meet(left, right, some_i, some_j)
        np.add.at(met, some_i[hit], right.weight[some_j[hit]])
        at = to


def _meet(left: _Side, right: _Side, i, j):
    """Whether the polygons of each pair share a point: a corner inside the other, or edges that meet."""
    hit = _inside(right, j, left.x[left.corner[i]], left.y[left.corner[i]]) | _inside(left, i, right.x[right.corner[j]], right.y[right.corner[j]])
    rest = np.flatnonzero(~hit)
    i, j = i[rest], j[rest]
    number = left.count[i] * right.count[j]
    pair = np.repeat(np.arange(len(i)), number)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
    per = right.count[j][pair]
    s = left.edges[:, left.first[i][pair] + place // per]
    t = right.edges[:, right.first[j][pair] + place % per]
    near = ((np.maximum(s[0], s[2]) >= np.minimum(t[0], t[2])) & (np.maximum(t[0], t[2]) >= np.minimum(s[0], s[2]))
            & (np.maximum(s[1], s[3]) >= np.minimum(t[1], t[3])) & (np.maximum(t[1], t[3]) >= np.minimum(s[1], s[3])))
    s, t, pair = s[:, near], t[:, near], pair[near]

    def sides(e, px, py):
        return np.sign((e[2] - e[0]) * (py - e[1]) - (e[3] - e[1]) * (px - e[0]))

    across = (sides(t, s[0], s[1]) * sides(t, s[2], s[3]) <= 0) & (sides(s, t[0], t[1]) * sides(s, t[2], t[3]) <= 0)
    hit[rest[np.unique(pair[across])]] = True
    return hit


def _inside(side: _Side, which, x, y):
    """Even-odd rule over all rings of polygon `which` for one point each."""
    number = side.count[which]
    pair = np.repeat(np.arange(len(which)), number)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
    e = side.edges[:, side.first[which][pair] + place]
    px, py = x[pair], y[pair]
    straddles = (e[1] > py) != (e[3] > py)
    e, px, py, pair = e[:, straddles], px[straddles], py[straddles], pair[straddles]
    left_of = px < e[0] + (py - e[1]) / (e[3] - e[1]) * (e[2] - e[0])
    return np.bincount(pair[left_of], minlength=len(which)) % 2 == 1

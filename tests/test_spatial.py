"""Grid joins and footprint measures against brute force and closed forms."""

import random

from pyspark.sql import functions as F

from pandwerk.functions import geom2d
from pandwerk.operators import footprints, spatial
from pandwerk.sources import tables

RADII = (25, 50, 75, 100)


def _points(n, seed=1):
    rng = random.Random(seed)
    pts = [(rng.uniform(0, 260), rng.uniform(0, 260)) for _ in range(n)]
    # a third of the rows are copies of one location
    pts += [(130.5, 77.25)] * (n // 2)
    return [(f"b{i}", x, y, i % 5 != 0, i % 7 != 0) for i, (x, y) in enumerate(pts)]


def _brute(rows):
    out = {}
    for key, x, y, target, candidate in rows:
        if target:
            out[key] = tuple(0 if not candidate else sum(
                1 for k, px, py, _, c in rows if c and k != key and (x - px) ** 2 + (y - py) ** 2 <= r * r) for r in RADII)
    return out


def _counts(spark, rows):
    df = spark.createDataFrame(rows, "bag_id string, x double, y double, t boolean, c boolean")
    out = spatial.neighbour_counts(df, RADII, F.col("t"), F.col("c"))
    return {r.bag_id: tuple(r[f"footprint_no_neighbours_{d}m"] for d in RADII) for r in out.collect()}


def test_neighbour_counts_match_brute_force(spark):
    rows = _points(160)
    assert _counts(spark, rows) == _brute(rows)


def test_quiet_blocks_emit_no_sub_cells_and_crowded_ones_agree(spark, monkeypatch):
    """Far, negative and border locations; below the crowd limit no pair of location and sub-cell is laid out."""
    rng = random.Random(4)
    rows = [(f"n{i}", rng.choice([-900.0, -800.0, 0.0, 799.0, 1e7]) + rng.uniform(-130, 130), rng.choice([-800.0, 1600.0, 3e6]) + rng.uniform(-110, 110),
             i % 4 != 0, i % 9 != 0) for i in range(400)]
    rows += [("edge1", 800.0, 800.0, True, True), ("edge2", 900.0, 800.0, True, True), ("edge3", 800.0, 700.0, True, True), ("edge4", 775.0, 800.0, True, True)]
    df = spark.createDataFrame([*rows, ("nan", float("nan"), 5.0, True, True), ("none", None, 5.0, True, True)],
                               "bag_id string, x double, y double, t boolean, c boolean")

    def counts(**how):
        out = spatial.neighbour_counts(df, RADII, F.col("t"), F.col("c"), **how)
        return {r.bag_id: tuple(r[f"footprint_no_neighbours_{d}m"] for d in RADII) for r in out.collect()}

    want = _brute(rows) | {"nan": (None,) * 4, "none": (None,) * 4}
    assert counts(crowd=40) == want
    monkeypatch.setattr(spatial, "_counts_by_sub_cells", None)
    assert counts() == want


def test_only_blocks_with_a_seeker_are_dealt(spark, monkeypatch):
    """Few targets among many locations: other towns' locations do not travel, and the counts stay."""
    rng = random.Random(6)
    rows = [(f"t{i}", rng.uniform(0, 700) + 5000 * (i % 12), rng.uniform(0, 700), i % 12 == 3 and i % 4 != 0, i % 7 != 0) for i in range(600)]
    seen, dealt = [], spatial.near_weights
    monkeypatch.setattr(spatial, "near_weights", lambda blocks, *how: seen.append(blocks.count()) or dealt(blocks, *how))
    assert _counts(spark, rows) == _brute(rows)
    assert 0 < seen[0] < 200


def _square(x, y, s):
    x, y, s = float(x), float(y), float(s)
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


GEOM = "bag_id string, footprint_geom array<array<struct<x double, y double>>>, bag_function string"


def test_adjacent_counts_with_copies_and_classes(spark):
    rows = [("a", _square(0, 0, 10), "Residential"), ("copy1", _square(0, 0, 10), "Residential"),
            ("copy2", _square(0, 0, 10), "Others"), ("near", _square(10.05, 0, 10), "Residential"),
            ("far", _square(10.3, 20, 10), "Residential"), ("null", _square(0, 0, 10), None),
            ("nowhere", None, "Residential")]
    df = spark.createDataFrame(rows, GEOM)
    out = spatial.adjacent_counts(df, 0.1, F.lit(True), footprints.countable(F.col("bag_function")))
    got = {r.bag_id: r.footprint_no_adjacent for r in out.collect()}
    assert got == {"a": 2, "copy1": 2, "copy2": 0, "near": 2, "far": 0, "null": 0, "nowhere": None}


def test_measures_honour_holes(spark):
    ring = [_square(0, 0, 10)[0], _square(4, 4, 2)[0]]
    df = spark.createDataFrame([("h", ring, None)], GEOM)
    row = footprints.with_centroid(footprints.with_measures(df)).first()
    assert (row.footprint_area, row.footprint_perim, row.x, row.y) == (96.0, 48.0, 5.0, 5.0)


def test_intersects_touch_hole_and_containment(spark):
    outer = [_square(0, 0, 10)[0], _square(2, 2, 6)[0]]
    cases = {"touching": (_square(10, 10, 5), True), "in_hole": (_square(4, 4, 1), False),
             "inside_solid": (_square(0.5, 0.5, 1), True), "apart": (_square(20, 20, 1), False)}
    df = spark.createDataFrame([(k, outer, g) for k, (g, _) in cases.items()],
                               "k string, a array<array<struct<x double, y double>>>, b array<array<struct<x double, y double>>>")
    got = {r.k: r.i for r in df.select("k", geom2d.intersects(F.col("a"), F.col("b")).alias("i")).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_mitre_buffer_either_orientation(spark):
    ring = _square(0, 0, 10)
    for geom in (ring, [ring[0][::-1]]):
        df = spark.createDataFrame([("b", geom, None)], GEOM)
        box = df.select(geom2d.bbox(geom2d.mitre_buffer(F.col("footprint_geom"), 0.5)).alias("b")).first().b
        assert tuple(round(v, 9) for v in box) == (-0.5, -0.5, 10.5, 10.5)


def test_simplified_vertices_drop_near_collinear_points(spark):
    ring = [[(0.0, 0.0), (5.0, 0.05), (10.0, 0.0), (10.0, 10.0), (5.0, 10.5), (0.0, 10.0), (0.0, 0.0)]]
    df = spark.createDataFrame([("v", ring, None)], GEOM)
    assert footprints.simplified_vertices(df).first().footprint_no_vertices == 6.0


def test_area_statistics_take_the_lowest_key(spark):
    buildings = spark.createDataFrame([("p", _square(9, 0, 2), None)], GEOM)
    areas = spark.createDataFrame(
        [("B2", 7, _square(10, 0, 10)), ("B1", 5, _square(0, 0, 10))],
        "code string, v int, geom array<array<struct<x double, y double>>>")
    assert spatial.attach_area_statistics(buildings, areas, {"v": "out"}, "code").first().out == 5


def _polygon(points, *holes):
    return [[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in (points, *holes)]


PARTS = "array<array<array<struct<x:double,y:double>>>>"


def test_multi_part_areas_meet_by_any_part(spark):
    """A concave part and a far part with a hole: the house in the hole and the one in the notch meet nothing."""
    notch = _polygon([(0, 0), (100, 0), (100, 100), (60, 100), (60, 20), (40, 20), (40, 100), (0, 100)])
    holed = _polygon([(500, 500), (600, 500), (600, 600), (500, 600)], [(520, 520), (520, 580), (580, 580), (580, 520)])
    areas = spark.createDataFrame([("A", 7, [notch, holed]), ("B", 9, [_polygon([(5, 5), (8, 5), (8, 8), (5, 8)])])],
                                  f"code string, people int, geom {PARTS}")
    houses = spark.createDataFrame([("in_first", _square(10, 50, 5)), ("notch", _square(47, 60, 5)), ("in_second", _square(505, 505, 5)),
                                    ("hole", _square(548, 548, 5)), ("both", _square(4, 4, 2)), ("none", None)],
                                   "bag_id string, footprint_geom array<array<struct<x:double,y:double>>>")
    got = {r.bag_id: r.people for r in spatial.attach_area_statistics(houses, areas, {"people": "people"}, "code").collect()}
    assert got == {"in_first": 7, "notch": None, "in_second": 7, "hole": None, "both": 7, "none": None}
    near = footprints.within_municipality(houses.where("footprint_geom is not null"),
                                          areas.withColumnRenamed("code", "gemeentecode"), 2.0)
    assert {r.bag_id: r.near_gemeente for r in near.collect()} == {"in_first": "A", "in_second": "A", "both": "A"}
    kept = tables.clip(areas, _polygon([(515, 490), (517, 490), (517, 700), (515, 700)]))
    assert [r.code for r in kept.collect()] == ["A"]
    measured = areas.where("code = 'A'").select(geom2d.part_areas(F.col("geom")).alias("a"), geom2d.part_perimeters(F.col("geom")).alias("p"),
                                                geom2d.part_centroid(F.col("geom")).alias("c")).first()
    assert abs(measured.a - (10_000 - 1_600 + 10_000 - 3_600)) < 1e-9 and abs(measured.p - (400 + 160 + 400 + 240)) < 1e-9
    first = (10_000 * 50 - 1_600 * 50) / 8_400
    assert abs(measured.c.x - (8_400 * first + 6_400 * 550) / 14_800) < 1e-6


def test_crowded_cell_of_different_footprints(spark):
    rng = random.Random(9)
    rows = [(f"b{i}", _square(rng.uniform(0, 6), rng.uniform(0, 6), 10), "Residential") for i in range(400)]
    df = spark.createDataFrame(rows, GEOM)
    got = spatial.adjacent_counts(df, 0.1, F.lit(True), F.lit(True)).collect()
    assert len(got) == 400 and all(r.footprint_no_adjacent == 399 for r in got)

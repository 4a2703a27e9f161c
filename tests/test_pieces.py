"""Areas met through pieces per cell, against the test of whole polygons."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pandwerk.functions import geom2d
from pandwerk.operators import pieces
from tests.test_crowds import square, star

POLYGON = "array<array<struct<x:double,y:double>>>"


def ragged(x, y, reach, points, seed=1):
    """A long outline that winds about a circle."""
    draw = random.Random(seed)
    ring = [(x + r * math.cos(2 * math.pi * i / points), y + r * math.sin(2 * math.pi * i / points))
            for i in range(points) for r in (reach * draw.uniform(0.9, 1.1),)]
    return ring + ring[:1]


def areas():
    draw = random.Random(3)
    out = [("ring", square(-100.0, -100.0, 200.0, 60.0)), ("lake", [ragged(300.0, 0.0, 90.0, 200), ragged(300.0, 0.0, 40.0, 60, 2)[::-1]]),
           ("grid", square(0.0, 200.0, 50.0)), ("tiny", square(-20.0, 211.0, 1.0)), ("sliver", [[(0.0, 300.0), (400.0, 301.0), (400.0, 303.0), (0.0, 300.0)]])]
    return out + [(f"star{i}", [star(draw, draw.uniform(-200, 400), draw.uniform(-200, 400), draw.uniform(5, 80), draw.randint(3, 12))]) for i in range(12)]


def buildings():
    draw = random.Random(4)
    out = [(i, square(float(draw.randint(-200, 400)), float(draw.randint(-200, 400)), float(draw.choice([3, 10, 40])))) for i in range(250)]
    out += [(1000 + i, [star(draw, draw.uniform(-200, 400), draw.uniform(-200, 400), 15, 7)]) for i in range(100)]
    return out + [(2000, square(-21.0, 210.0, 3.0)), (2001, square(50.0, 250.0, 5.0)), (2002, square(-200.0, -200.0, 700.0)), (2003, None),
                  (2004, square(-5.0, -5.0, 10.0)), (2005, square(50.0, 200.0, 50.0))]


@pytest.mark.parametrize("size", [50.0, 37.3, 1000.0])
def test_pairs_match_whole_polygons(spark, size):
    l = spark.createDataFrame(buildings(), f"id int, g {POLYGON}")
    r = spark.createDataFrame(areas(), f"name string, a {POLYGON}")
    got = {(x["id"], x["name"]) for x in pieces.area_join(l, r, "g", "a", size).collect()}
    whole = l.where("g is not null").crossJoin(r).where(geom2d.bbox_overlaps(geom2d.bbox(F.col("g")), geom2d.bbox(F.col("a")))).where(
        geom2d.intersects(F.col("g"), F.col("a")))
    want = {(x["id"], x["name"]) for x in whole.select("id", "name").collect()}
    assert got == want and len(want) > 100


def test_pieces_of_a_long_outline_follow_its_length(spark):
    n = 10_000
    r = spark.createDataFrame([("long", [ragged(0.0, 0.0, 20_000.0, n)])], f"name string, a {POLYGON}")
    row = pieces.area_pieces(r, "a", 500.0).agg(F.count("*").alias("cells"), F.sum(F.size("edges")).alias("edges"),
                                                F.count_if(F.size("edges") == 0).alias("full")).first()
    assert row.full > 3_000 and row.cells < 9_000
    # an edge is about 2 km long here and passes about six cells
    assert row.edges < 12 * n
    spots = np.random.default_rng(1).uniform(-23_000, 23_000, (300, 2))
    l = spark.createDataFrame([(i, square(float(x), float(y), 8.0)) for i, (x, y) in enumerate(spots)], f"id int, g {POLYGON}")
    got = {x["id"] for x in pieces.area_join(l, r, "g", "a", 500.0).collect()}
    want = {x["id"] for x in l.crossJoin(r).where(geom2d.intersects(F.col("g"), F.col("a"))).collect()}
    assert got == want and 100 < len(want) < 300


def test_areas_are_cut_in_many_tasks(spark, monkeypatch):
    """Areas that come in one task are dealt anew, and pieces are the same however many are written at a time."""
    r = spark.createDataFrame([*areas(), ("none", None)], f"name string, a {POLYGON}").coalesce(1)
    whole = {str(row) for row in pieces.area_pieces(r, "a", 50.0).collect()}
    tasks = pieces.area_pieces(r, "a", 50.0).select(F.spark_partition_id()).distinct().count()
    monkeypatch.setattr(pieces, "TOGETHER", 1)
    assert tasks > 2 and len(whole) > 50 and {str(row) for row in pieces.area_pieces(r, "a", 50.0).collect()} == whole

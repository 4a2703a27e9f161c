"""Polygons that meet, against every pair tested by the row expressions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pandwerk.functions import geom2d
from pandwerk.operators import crowds, spatial

SHAPE = "id int, g array<array<struct<x:double,y:double>>>, w int"


def star(draw, x, y, reach, corners):
    angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(x + reach * draw.uniform(0.3, 1) * math.cos(a), y + reach * draw.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return ring + ring[:1]


def square(x, y, w, hole=0.0):
    rings = [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]
    if hole:
        rings.append([(x + hole, y + hole), (x + hole, y + w - hole), (x + w - hole, y + w - hole), (x + w - hole, y + hole), (x + hole, y + hole)])
    return rings


def shapes(seed, n, spread):
    """Concave stars, squares with holes, small squares (some in the holes), shapes that only touch."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x, y = draw.uniform(-spread, spread), draw.uniform(-spread, spread)
        kind = i % 4
        out.append((i, [star(draw, x, y, draw.uniform(1, 9), draw.randint(3, 9))] if kind == 0 else square(float(round(x)), float(round(y)), 8.0, 1.0) if kind == 1
                    else square(float(round(x)), float(round(y)), 1.0) if kind == 2 else square(round(x) + 0.5, float(round(y)), 2.5), draw.randint(1, 5)))
    return out


def met(spark, left, right, size=10.0):
    l = spark.createDataFrame(left, SHAPE).select("id", F.col("g").alias("lg"), geom2d.bbox(F.col("g")).alias("lb"))
    r = spark.createDataFrame(right, SHAPE).select(F.col("g").alias("rg"), "w", geom2d.bbox(F.col("g")).alias("rb"))
    got = crowds.meeting_weights(l, r, "id", "lg", "rg", "w", "lb", "rb", size)
    pairs = l.crossJoin(r).where(geom2d.bbox_overlaps(F.col("lb"), F.col("rb"))).where(geom2d.intersects(F.col("lg"), F.col("rg")))
    want = pairs.groupBy("id").agg(F.sum("w").alias("w"))
    return {int(x["id"]): x["met"] for x in got.collect()}, {x["id"]: x["w"] for x in want.collect()}


@pytest.mark.parametrize("block", [1_000, 7])
def test_weights_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(crowds, "BLOCK", block)
    monkeypatch.setattr(crowds, "PACK", 50)
    monkeypatch.setattr(crowds, "PAIRS", 60)
    monkeypatch.setattr(crowds, "EDGES", 300)
    got, want = met(spark, shapes(1, 70, 18), shapes(2, 80, 18))
    assert got == want and len(want) > 40


def test_one_side_missing_or_far_away(spark):
    near, far = shapes(3, 5, 5), [(0, square(1e6, 1e6, 3.0), 1)]
    assert met(spark, near, far) == ({}, {})
    assert met(spark, [], near) == ({}, {}) and met(spark, near, []) == ({}, {})


def test_a_crowd_in_one_cell_is_dealt_and_counted(spark):
    """3,000 different overlapping footprints in one cell."""
    n = 3000
    rows = [(f"{i:05d}", square(i * 0.001, (i * 37 % n) * 0.001, 12.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "bag_id string, footprint_geom array<array<struct<x:double,y:double>>>")
    started = time.monotonic()
    out = spatial.adjacent_counts(df, 0.1, F.lit(True), F.lit(True)).agg(F.min("footprint_no_adjacent"), F.max("footprint_no_adjacent")).first()
    assert tuple(out) == (n - 1, n - 1) and time.monotonic() - started < 60

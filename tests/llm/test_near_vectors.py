import math

import numpy as np
from pyspark.sql import functions as F

from pandwerk.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.sqrt((x * x).sum())

    units = [None if label is None else unit(v) for _, v, label in rows]
    links, at = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(
                    units[j]) and float(units[i] @ units[j]) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = at[i], at[j]
                at = [min(a, b) if x in (a, b) else x for x in at]
    group = {}
    for i, (key, _, _) in enumerate(rows):
        group.setdefault(at[i], []).append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in group.items()}
    return sorted(((key, links[i], least[at[i]], key is not None and key == least[at[i]])
                   for i, (key, _, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("gid", F.lit("x")).withColumn("component", F.lit(1))
    return sorted((tuple(r) for r in near_vectors.near_duplicates(table).collect()), key=repr)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "WINDOW", 64)
    monkeypatch.setattr(near_vectors, "OVERLAP", 16)
    monkeypatch.setattr(near_vectors, "BLOCK", 40)
    draw = np.random.default_rng(2)
    rows, n = [], 0
    for spread, copies in ((0.05, 150), (0.1, 30), (0.13, 30), (0.02, 3), *[(0.12, 2)] * 40, *[(0, 1)] * 300):
        origin = draw.standard_normal(24)
        for _ in range(copies):
            v = origin + spread * np.linalg.norm(origin) / math.sqrt(24) * draw.standard_normal(24)
            rows.append((n, [float(x) for x in v.astype(np.float32)], int(draw.integers(0, 2)) if copies < 100 else 1))
            n += 1
    assert found(spark, rows) == expected(rows)


def test_unusable_vectors_and_repeats(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (None, one, 1), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 2.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1),
            (11, [1.0, 2.0], 1), (12, [2.0, 4.0, 6.0], 1), (13, [1e30, 2e30, 3e30], 1), (14, [-1.0, -2.0, -3.0], 1), (None, None, None)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []

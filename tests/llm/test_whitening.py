import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pandwerk.llm import whitening
from pandwerk.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(e is not None and math.isfinite(e) for e in v)


def expected(rows, weights="one", components=16):
    """(steps, n, sums, eigenvalues, unit components in columns, trace) by numpy over the rows themselves."""
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v, _ in rows if usable(v)]).astype(np.int64) + 1_000_000
    fitted = np.unique(x, axis=0) if weights == "one" else x
    v = np.cov(fitted.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    return x, len(fitted), fitted.sum(axis=0), values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(v)


def vectors(seed=5, n=300, width=24):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, width)) * np.linspace(1.5, 0.2, width)
    rows = [(i, [float(e) for e in v], i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)]  # one vector in a third of all rows
    rows += [(2000, None, 1), (2001, [float("nan")] + [0.0] * (width - 1), 1), (2002, [None] + [1.0] * (width - 1), 1),
             (2003, [float("inf")] + [0.0] * (width - 1), 0), (None, rows[3][1], None), (3, rows[3][1], 2)]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_matches_numpy(spark, weights):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA)
    found, model, error = whitening.whitened(table, weights=weights, carry=("vec_id",))
    x, n, sums, values, axes, trace = expected(rows, weights)
    assert model.n == n and error <= 1e-9
    assert np.allclose(model.eigenvalues, values, rtol=1e-10) and np.allclose(model.explained, values / trace, rtol=1e-10)
    sign = np.sign((np.array(model.components) * axes.T).sum(axis=1))
    z = (x - sums / n) @ axes / np.sqrt(values) * sign
    want = sorted(((str(k), int(((n * r.astype(object) - sums) ** 2).sum())), tuple(w))
                  for (k, _, _), r, w in zip([r for r in rows if usable(r[1])], x, z))
    got = sorted(((str(r["_c0"]), int(r["deviation"])), tuple(r["whitened"])) for r in found.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) == len(rows) - 4
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-8)


def test_query_returns_one_row_per_vector_and_component(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("mine")).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["op11_whitened_vectors"](spark, str(tmp_path))
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["n"] == "bigint"
    found = out.collect()
    assert len(found) == 16 * (len(rows) - 4) and {r["component"] for r in found} == set(range(1, 17))
    assert all(0 <= r["identity_error"] <= 1e-4 for r in found)


def test_few_distinct_vectors_have_few_components(spark):
    """Three points span two directions; a single one none."""
    rows = [(i, [float(i % 3 == j) for j in range(4)], 0) for i in range(9)]
    found, model, error = whitening.whitened(spark.createDataFrame(rows, SCHEMA), carry=("vec_id",))
    assert len(model.components) == 2 and error < 1e-12 and {len(r["whitened"]) for r in found.collect()} == {2}
    same, model, error = whitening.whitened(spark.createDataFrame([(1, [2.0], 0), (2, [2.0], 1)], SCHEMA))
    assert model.components == [] and model.n == 1 and [r["whitened"] for r in same.collect()] == [[], []]


def test_empty_table_other_lengths_and_clashing_columns(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA))[0].count() == 0
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [], 0), (4, [1.0], 0), (5, [1e30, 0.0], 0), (6, [-2.0, 0.5], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("whitened", F.lit("w")).withColumn("key.part", F.lit(1))
    found, model, _ = whitening.whitened(table)
    assert sorted(r["_c0"] for r in found.collect()) == [1, 2, 6] and model.n == 3
    with pytest.raises(ValueError):
        whitening.whitened(table, weights="two")

"""Rules whose edge cases results depend on, meshes, sinks and learning."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pandwerk.functions import mesh3d
from pandwerk.functions.lineage import scratch_path
from pandwerk.learning import prep, train, tune
from pandwerk.operators import clean, enrich, evaluate, labels, meshes, predicates, refmodel
from pandwerk.params import DEFAULTS, Params
from pandwerk.sources import sinks

MESH = "bag_id string, faces array<struct<sem int, ring array<struct<x double, y double, z double>>>>"


def _box(w, d, h, z=2.0):
    lo = [(0, 0, z), (w, 0, z), (w, d, z), (0, d, z)]
    hi = [(x, y, z + h) for x, y, _ in lo]
    quads = [(0, [lo[0], lo[3], lo[2], lo[1]]), (1, hi)] + [(2, [lo[i], lo[(i + 1) % 4], hi[(i + 1) % 4], hi[i]]) for i in range(4)]
    return [(s, [tuple(map(float, p)) for p in [*q, q[0]]]) for s, q in quads]


def test_meshes_exact_sampled_and_broken(spark):
    box = _box(4, 5, 6)
    rows = [("ok", box), ("open", box[:1] + box[2:]), ("flat", _box(4, 5, 0)), ("point", [])]
    df = spark.createDataFrame(rows, MESH)
    checked = {r.bag_id: r for r in meshes.quality(df).collect()}
    assert checked["ok"].is_valid and checked["ok"].n_vertices == 8
    assert checked["open"].codes == ["open_edge"] and checked["open"].open_edges == 4
    assert "degenerate_face" in checked["flat"].codes
    got = {r.bag_id: r for r in meshes.volumes(df, "lod12", 75).collect()}
    assert got["ok"].lod12_volume == 120.0
    assert math.isnan(got["point"].lod12_volume)
    sampled = {r.bag_id: r.sampled_volume for r in meshes.sampled_volume(df.where("bag_id = 'ok'"), 75).collect()}
    assert abs(sampled["ok"] - 120) < 6
    areas = meshes.surface_areas(df.where("bag_id = 'ok'"), "l").first()
    assert (areas.l_area_walls, areas.l_area_roof) == (108.0, 20.0)


def test_ridge_without_roof_is_null(spark):
    df = spark.createDataFrame([("a", _box(1, 1, 3)[2:])], MESH)
    row = df.select(mesh3d.ridge_and_eaves(F.col("faces"), F.lit("slanted"), F.lit(2.0)).alias("h")).first().h
    assert row.ridge is None and row.eaves is None


def test_use_class_and_residential_filter(spark):
    rows = [("none", None), ("empty", []), ("res", ["woonfunctie"]), ("mixed", ["kantoorfunctie", "woonfunctie"]),
            ("one", ["kantoorfunctie"]), ("many", ["kantoorfunctie", "overige gebruiksfunctie"]), ("other", ["overige gebruiksfunctie"])]
    df = spark.createDataFrame(rows, "k string, uses array<string>").withColumn("bag_function", enrich.use_class(F.col("uses")))
    got = {r.k: r.bag_function for r in df.collect()}
    assert got == {"none": "Unknown", "empty": None, "res": "Residential", "mixed": "Mixed-residential",
                   "one": "Non-residential (single-function)", "many": "Non-residential (multi-function)", "other": "Others"}
    assert {r.k for r in df.where(predicates.residential()).collect()} == {"empty", "res", "mixed"}


def test_storey_range_branches(spark):
    rows = [(1, 4, 3, 0), (2, 5, 3, -1), (3, 4, None, None), (4, 4, None, 0), (5, 4, None, -1), (6, 1, 0, 0), (7, 9, 3, 0)]
    df = spark.createDataFrame([(*r, None, "t") for r in rows], "identificatie bigint, aantalbouwlagen int, "
                               "hoogstebouwlaag int, laagstebouwlaag int, ligging string, typewoonobject string")
    got = [r.no_floors for r in labels.from_storey_range(df).orderBy("bag_id").collect()]
    assert got == [4, 4, 4, 4, 3, None, None]


def test_reference_model_rounds_half_even_and_falls_back(spark):
    df = spark.createDataFrame([(6.625, 100.0, 10.0), (None, 21.0, 10.0), (None, 21.0, 0.0)],
                               "h_70p double, bag_net_internal_area double, footprint_area double")
    got = refmodel.with_reference_model(df).collect()
    assert [r.ref_model for r in got] == [2, 2, None]


def test_volume_rule_rejects_nan_keeps_null(spark):
    df = spark.createDataFrame([("nan", float("nan")), ("null", None), ("fine", 100.0)], "k string, lod12_volume double").withColumns({
        "is_clean": F.lit("y"), "clean_floors": F.lit(3), "no_floors": F.lit(3), "footprint_area": F.lit(10.0),
        "h_70p": F.lit(10.0), "bag_net_internal_area": F.lit(60.0)})
    got = {r.k: r.is_clean for r in clean.apply_plausibility(df).collect()}
    assert got == {"nan": None, "null": "y", "fine": "y"}


def test_metrics_of_empty_class_are_null(spark):
    df = spark.createDataFrame([(2, 2.5), (3, 3.4)], "clean_floors int, pred_value double")
    row = evaluate.per_class(df).first()
    assert row.accuracy_above is None and row.accuracy_below == 1.0


def test_replace_table_refuses_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",)], "bag_id string")
    name = "dup_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    with pytest.raises(ValueError):
        sinks.replace_table(df, name, "bag_id", scratch_path(spark, "table"))


def _frame(spark, n=400):
    rng = np.random.default_rng(2)
    h = rng.uniform(3, 30, n)
    pdf = pd.DataFrame({"bag_id": [str(i) for i in range(n)], "clean_floors": np.rint(h / 3).astype(int), "h": h,
                        "noise": rng.normal(size=n), "kind": np.where(h > 10, "tall", "low")})
    pdf.loc[::9, "h"] = np.nan
    return spark.createDataFrame(pdf)


def test_preparation_encodes_and_rejects_unseen(spark):
    df = _frame(spark)
    stages = prep.fit(df, ["h", "noise", "kind"], ["bag_id", "clean_floors"])
    assert prep.input_names(stages) == ["h", "noise", "kind_x0_tall"]
    row = stages.transform(df).agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s")).first()
    assert abs(row.m) < 1e-9 and abs(row.s - 1) < 1e-9
    with pytest.raises(Exception, match="unseen value"):
        stages.transform(df.withColumn("kind", F.lit("new"))).collect()


def test_models_beat_the_mean_and_reload(spark):
    df = _frame(spark)
    spread = df.agg(F.stddev_pop("clean_floors")).first()[0]
    for algorithm, params in (("svr", {}), ("rfr", {"numTrees": 10, "maxDepth": 6})):
        model, seconds = train.fit(df, ["h", "noise", "kind"], algorithm, params)
        scored = train.predict(model, df)
        assert evaluate.overall(scored).first().rmse < spread and seconds > 0
    path = scratch_path(spark, "model")
    svr = train.fit(df, ["h", "noise", "kind"], "svr")[0]
    sinks.save_model(svr, path)
    a, b = train.predict(svr, df), train.predict(PipelineModel.load(path), df)
    assert a.exceptAll(b).isEmpty()


def test_search_draws_are_seeded_and_within_the_grid():
    space = tune.grid("rfr")
    a, b = tune.draws(space, 75), tune.draws(space, 75)
    assert a == b and len(a) == 75
    assert all(v in space[k] for d in a for k, v in d.items())


def test_params_and_entry(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"class_threshold": 7}')
    assert Params.from_json(str(path)).class_threshold == 7
    assert len(DEFAULTS.feature_columns("model_1")) == 25
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

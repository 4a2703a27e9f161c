"""The preparation job as a whole."""

import os

from pyspark.sql import functions as F

from pandwerk.functions import lineage
from pandwerk.functions.joins import possibly_among
from pandwerk.operators import meshes
from pandwerk.plans import prepare
from tests.test_meshes import FACES, torus


def test_mesh_tables_look_buildings_up_in_written_rows(spark, monkeypatch):
    """Both mesh tables read the buildings; the spatial joins before them must not run again for each."""
    ids = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "bag_id string, v double")
    seen = []

    def meshes(df, reg, params):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(prepare, "enrich_ids", lambda df, reg: df)
    monkeypatch.setattr(prepare, "add_footprint_features",
                        lambda df, reg, params: df.join(df.groupBy("bag_id").agg(F.count("*").alias("n")), "bag_id", "left"))
    monkeypatch.setattr(prepare, "add_mesh_features", meshes)
    out = prepare.feature_table(ids, None)
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]
    assert sorted((r.bag_id, r.n) for r in out.collect()) == [("a", 1), ("b", 2), ("b", 2)]
    prepare.feature_table(ids, None, materialise=False)
    assert "Join" in seen[1]


def test_settled_tables_leave_no_steps_and_no_shuffle_files(spark):
    seen = []

    def build():
        step = lineage.checkpointed(spark.range(3000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
        seen.append(step.inputFiles()[0])
        return step.groupBy("n").agg(F.count("*").alias("m")).join(step, "n")

    kept = lineage.checkpointed(spark.range(5).toDF("v"))
    out = lineage.settled(build)
    assert {(r.k, r.n) for r in out.collect()} == {(k, 429 - (k > 3)) for k in range(7)}
    place = lambda f: f.removeprefix("file://")
    assert not os.path.exists(place(seen[0])) and os.path.exists(place(kept.inputFiles()[0])) and kept.count() == 5
    assert lineage.settled(lambda: out.where("k = 1")).count() == 1 and out.count() == 7

    def shuffle_files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {str(f) for f in manager.getAllFiles().mkString("|").split("|") if "shuffle_" in str(f)}

    before = shuffle_files()
    lineage.checkpointed(spark.range(9000).repartition(3, "id").groupBy((F.col("id") % 11).alias("k")).count())
    assert shuffle_files() <= before


def test_mesh_features_shuffle_measures_and_not_meshes(spark):
    small, large = torus(3, 4), torus(4, 5)
    lod = spark.createDataFrame([(1, small, []), (2, small[:-1], []), (3, large, None), (4, large, []), (4, small, []), (5, large, []), (None, small, []), (6, None, [])],
                                f"fid int, {FACES}, val3dity_codes array<int>")
    buildings = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 4), ("e", None), ("f", 6), ("g", 1)], "bag_id string, bag3d_id int").withColumns(
        {"bag3d_roof_type": F.lit("slanted"), "bag3d_h_ground": F.lit(-2.0)})
    found = meshes.lod22_features(buildings, lod, 40)
    assert "faces" not in found._jdf.queryExecution().optimizedPlan().toString()
    fetched = meshes.fetch(buildings, lod)
    want = meshes.volumes(fetched, "lod22", 40, meshes.area_columns("lod22")).join(meshes.height_references(fetched).distinct(), "bag_id")
    rows = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
    assert rows(found) == rows(want) and found.where("bag_id = 'd'").count() == 2


def test_a_bitmap_keeps_all_wanted_keys_and_few_others(spark):
    wanted = spark.createDataFrame([(i * 50,) for i in range(400)] + [(None,)], "k long")
    rows = spark.range(20000).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    kept = {r.k for r in possibly_among(rows, "k", wanted).collect()}
    assert {i * 50 for i in range(400)} <= kept and len(kept) < 2000 and None not in kept
    assert possibly_among(rows, "k", wanted.where("k < 0")).count() == 0

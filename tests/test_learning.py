"""Ties, predictions and table replacement."""

from pyspark.sql import functions as F

from pandwerk.learning import train
from pandwerk.operators import enrich, meshes
from pandwerk.sources import sinks


def test_equal_keys_give_one_row_under_any_partitioning(spark):
    rows = [("k", 1990, float(i * 7 % 5), [i * 7 % 5, i]) for i in range(8)] + [("m", None, 2.0, None), ("m", None, 2.0, [1, 1])]
    df = spark.createDataFrame(rows, "key string, year int, area double, shape array<int>")
    results = set()
    for n in (1, 3, 7):
        got = enrich.one_per_key(df.repartition(n, F.rand(n)), "key", ["area", "shape"], ["year"])
        results.add(str(sorted(map(tuple, got.collect()), key=str)))
    assert results == {"[('k', 0.0, [0, 0]), ('m', 2.0, None)]"}


def test_repeated_meshes_give_the_same_mesh(spark):
    faces = "array<struct<sem:int,ring:array<struct<x:double,y:double,z:double>>>>"
    lod = spark.createDataFrame([(1, "[]", [(2, [(float(i % 3), 0.0, 0.0)])]) for i in range(9)] + [(2, None, [(1, [])])],
                                f"fid int, val3dity_codes string, faces {faces}")
    buildings = spark.createDataFrame([("a", 1, "slanted", 0.0), ("b", 2, "slanted", 0.0)],
                                      "bag_id string, bag3d_id int, bag3d_roof_type string, bag3d_h_ground double")
    got = {str(meshes.fetch(buildings, lod.repartition(n, F.rand(n))).collect()) for n in (1, 2, 5)}
    assert len(got) == 1 and "x=0.0" in got.pop()


def test_predictions_keep_repeated_ids_and_columns(spark):
    rows = [(str(i // 2), i % 5 + 1, float(i), "t" if i % 3 else "u", i) for i in range(20)]
    df = spark.createDataFrame(rows, "bag_id string, clean_floors int, height double, kind string, extra int")
    model, _ = train.fit(df, ["height", "kind"], "svr", {"maxIter": 20})
    got = train.predict(model, df, ["extra", "height"])
    assert got.count() == 20 and sorted(r.extra for r in got.collect()) == list(range(20))
    assert all(r.height == float(r.extra) for r in got.collect())
    table = train.evaluate_models({("m", "svr", "a"): model, ("n", "svr", "b"): model}, df, df.limit(5))
    assert table.count() == 2 and table.first()["mae_test"] is not None


def test_table_is_replaced_by_content_derived_from_it(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("swap_me")
    sinks.replace_table(spark.table("swap_me").withColumn("id", F.col("id") + 10), "swap_me", key="id")
    assert sorted(r.id for r in spark.table("swap_me").collect()) == [10, 11, 12]
    assert not spark.catalog.tableExists("swap_me_replaced")
    spark.sql("DROP TABLE swap_me")


def test_linear_permutations_score_as_rows_laid_out_would(spark, monkeypatch):
    rows = [(str(i), None if i % 17 == 0 else i % 5 + 1, float(i * 13 % 7), "t" if i % 3 else "u", float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "bag_id string, clean_floors int, height double, kind string, level double")
    model, _ = train.fit(df.where("clean_floors IS NOT NULL"), ["height", "kind", "level"], "svr", {"maxIter": 20})

    def found():
        return train.permutation_importance(model, df, repeats=2).collect()

    laid = []
    kept = train.F.explode
    monkeypatch.setattr(train.F, "explode", lambda c: laid.append(1) or kept(c))
    together = found()
    assert not laid
    monkeypatch.setattr(train, "LinearSVRModel", ())
    assert found() == together and laid

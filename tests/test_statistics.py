"""Exact percentiles, ranks, splits and feature statistics."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pandwerk.functions import quantiles
from pandwerk.functions.scalar import linear_percentile, round_half_even
from pandwerk.operators import clean, split, stats


def _values(n=3000):
    rng = random.Random(3)
    # a third of the rows share one group, and many of those one value
    return [(0 if i % 3 == 0 else i % 7, 4.0 if i % 4 == 0 else rng.gauss(10, 5)) for i in range(n)]


def test_bracketed_percentiles_are_exact(spark):
    rows = _values()
    df = spark.createDataFrame(rows, "no_floors int, _v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for accuracy in (50, 10_000):
        got = {r.no_floors: (r.n, r.q) for r in quantiles.bracketed_percentiles(df, ["no_floors"], probs, accuracy).collect()}
        for g, part in pdf.groupby("g"):
            assert got[g][0] == len(part)
            np.testing.assert_allclose(got[g][1], np.percentile(part.v, [p * 100 for p in probs]), rtol=1e-12)


def test_outliers_match_one_state_percentiles(spark):
    df = spark.createDataFrame(_values(), "no_floors int, h_70p double").withColumn("id", F.monotonically_increasing_id())
    got = clean.flag_iqr_outliers(df, "h_70p").groupBy("no_floors").agg(F.count_if("is_outlier").alias("n"))
    q = df.groupBy("no_floors").agg(F.percentile("h_70p", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    want = df.join(q, "no_floors").groupBy("no_floors").agg(F.count_if((F.col("h_70p") < low) | (F.col("h_70p") > high)).alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_moments_do_not_depend_on_row_order(spark):
    """A missing first block and a far-off centre: the same Pearson, inflation and F-scores in any order."""
    def table(descending):
        rows = spark.range(0, 20_000, 1, 4).select(
            F.when(F.col("id") >= 1000, 1e9 + F.col("id")).alias("a"), (F.col("id") * 3.0 + F.col("id") % 7).alias("b"),
            F.when(F.col("id") % 2 == 0, F.when(F.col("id") < 500, -1e12).otherwise(F.col("id") % 11)).cast("double").alias("c"),
            F.lit(0.1).alias("constant"))
        return rows.orderBy(F.col("b").desc() if descending else "b")

    results = []
    for descending in (False, True):
        df = table(descending)
        corr = {(r.feature_a, r.feature_b): r["corr"] for r in stats.pearson(df, ["a", "b", "c", "constant"]).collect()}
        assert corr["a", "constant"] is None and corr["constant", "constant"] is None
        vif = {r["variables"]: r["VIF"] for r in stats.variance_inflation(df, ["a", "c"]).collect()}
        scores = {r.feature: r.score for r in stats.f_scores(df, ["a", "c"], "b").collect()}
        assert corr["a", "b"] == pytest.approx(1.0, abs=1e-6)
        both = df.where("a is not null and c is not null")
        assert corr["a", "c"] == pytest.approx(both.select(F.corr(F.col("a") - 1e9, "c")).first()[0], abs=1e-9)
        results.append((corr, vif, scores))
    for first, second in zip(*results):
        for k in first:
            assert (first[k] is None) == (second[k] is None)
            assert first[k] is None or first[k] == pytest.approx(second[k], rel=1e-9, abs=1e-12)


def test_average_ranks_match_pandas(spark):
    rows = _values(500)
    df = spark.createDataFrame(rows, "g int, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank()
    want = {(g, v): r for g, v, r in pdf.itertuples(index=False)}
    got = {(r.g, r.v): r["rank"] for r in quantiles.average_ranks(df, ["g"], "v", ranges=8).collect()}
    assert got == want


def test_spearman_and_pearson_match_pandas_with_gaps(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 5, 300).astype(float)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=300)
    pdf.loc[::7, "c"] = np.nan
    pdf.loc[::5, "b"] = np.nan
    pdf["bag_id"] = [str(i) for i in range(300)]
    df = spark.createDataFrame(pdf)
    cols = ["a", "b", "c"]
    ranks = {(x, y): pdf[[x, y]].dropna().rank().corr().iloc[0, 1] if x != y else 1.0 for x in cols for y in cols}
    for fn, want in ((stats.pearson, {(x, y): pdf[cols].corr().loc[x, y] for x in cols for y in cols}), (stats.spearman, ranks)):
        got = {(r.feature_a, r.feature_b): r["corr"] for r in fn(df, cols).collect()}
        assert set(got) == set(want)
        for k in want:
            assert abs(got[k] - want[k]) < 1e-9, (fn, k)


def test_variance_inflation_matches_regressions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(5, 2, size=(400, 3))
    x[:, 2] = x[:, 0] * 0.8 + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = {r.variables: r.VIF for r in stats.variance_inflation(df, list("abc")).collect()}
    full = np.column_stack([x, np.ones(400)])
    for i, name in enumerate(["a", "b", "c", "intercept"]):
        y, others = full[:, i], np.delete(full, i, axis=1)
        fit = others @ np.linalg.lstsq(others, y, rcond=None)[0]
        total = ((y - y.mean()) ** 2).sum() if name != "intercept" else (y**2).sum()
        assert abs(got[name] - total / ((y - fit) ** 2).sum()) < 1e-6 * got[name]


def test_ward_groups_correlated_features():
    corr = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1]])
    clusters = stats.ward_clusters(corr, ["a", "b", "c"], 0.4)
    assert clusters["a"] == clusters["b"] != clusters["c"]


def test_stratified_split_sizes_and_stability(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 16, "0").alias("bag_id"),
                                  F.when(F.col("id") % 50 != 0, (F.col("id") % 13).cast("double")).alias("h_70p"))
    out = split.stratified(df).withColumn("c", F.coalesce(split.height_class(F.col("h_70p")), F.lit(0)))
    for r in out.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r.t == round(r.n * 0.2)
    again = split.stratified(df.repartition(7))
    assert out.select("bag_id", "split").exceptAll(again.select("bag_id", "split")).isEmpty()
    assert out.where("h_70p IS NULL").isEmpty()


def test_id_hash_equals_zlib(spark):
    ids = ["0000000000000042", "0518100000277308", "0363100012345678"]
    df = spark.createDataFrame([(i,) for i in ids], "bag_id string")
    got = {r.bag_id: r.h for r in df.select("bag_id", split.id_hash(F.col("bag_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(np.int64(int(i)).tobytes()) for i in ids}


def test_scalar_rounding_and_percentile(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0], 2.5), ([], 3.5)], "a array<double>, v double")
    rows = df.select(linear_percentile(F.col("a"), 0.9).alias("p"), round_half_even(F.col("v")).alias("r")).collect()
    assert abs(rows[0].p - np.percentile([1, 2, 4, 9], 90)) < 1e-12 and rows[1].p is None
    assert [r.r for r in rows] == [2.0, 4.0]


def test_dependent_columns_have_infinite_inflation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) + [0.0, 5.0, 100.0, 1e4]
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["e"] = pdf.a + rng.normal(size=400) * 0.3
    pdf["f"] = 2 * pdf.b - 3 * pdf.c + 1  # f, b and c determine each other
    got = {r["variables"]: r["VIF"] for r in stats.variance_inflation(spark.createDataFrame(pdf), list("abcdef")).collect()}
    assert [k for k, v in got.items() if v == float("inf")] == ["b", "c", "f"]
    for c in "ade":
        rest = np.column_stack([pdf[[k for k in "abcde" if k != c]], np.ones(400)])
        error = pdf[c] - rest @ np.linalg.lstsq(rest, pdf[c], rcond=None)[0]
        assert got[c] == pytest.approx(pdf[c].var(ddof=0) / (error**2).mean(), rel=1e-6)
    design = np.column_stack([pdf[list("abcde")], np.ones(400)])
    error = 1 - design[:, :5] @ np.linalg.lstsq(design[:, :5], np.ones(400), rcond=None)[0]
    assert got["intercept"] == pytest.approx(1 / (error**2).mean(), rel=1e-4)
    pdf["k"] = 3.0
    flat = {r["variables"]: r["VIF"] for r in stats.variance_inflation(spark.createDataFrame(pdf), ["a", "e", "k"]).collect()}
    assert flat["k"] == flat["intercept"] == float("inf") and flat["a"] == pytest.approx(flat["e"])


@pytest.mark.parametrize("heavy", [1, 20, 1_000])
def test_ranks_reach_every_row(spark, monkeypatch, heavy):
    monkeypatch.setattr(quantiles, "HEAVY", heavy)
    rows = _values(600)
    got = quantiles.with_average_ranks(spark.createDataFrame(rows, "g int, v double").withColumn("n", F.lit(7)), ["g"], "v").collect()
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank()
    assert sorted((r.g, r.v, r["rank"], r.n) for r in got) == sorted((g, v, r, 7) for g, v, r in pdf.itertuples(index=False))


def test_ranks_beside_each_set_come_from_one_row_per_value(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 3 else "b", float(rng.randrange(12)), [True, i % 4 != 0, i % 5 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, v double, present array<boolean>")
    got = {r.id: r.ranks for r in quantiles.with_shared_ranks(df, ["g"], "v", "present", 3).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v", "present"])
    assert len(got) == len(rows)
    for k in range(3):
        part = pdf[[p[k] for p in pdf.present]]
        want = dict(zip(part.id, part.groupby("g").v.rank()))
        assert all(got[i][k] == want.get(i) for i in pdf.id)


def test_binned_counts_match_pandas(spark):
    rng = random.Random(9)
    rows = [(None if i % 29 == 0 else i % 3, None if i % 7 == 0 else rng.gauss(0, 1), float(rng.randrange(4)), None) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, a double, b double, gone double").repartition(3)
    cuts = {"a": [-0.5, 0.0, 0.5], "b": [1.0, 1.0, 2.0]}
    got = {(r.feature, r.bin, r.y): r.c for r in stats._binned_counts(df, ["a", "b", "gone"], "y", cuts).collect()}
    want: dict = {}
    for y, a, b, _ in rows:
        for f, v in (("a", a), ("b", b)):
            k = (f, 0 if v is None else sum(c < v for c in cuts[f]), y)
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_percentiles_of_columns_side_by_side_equal_those_of_their_long_form(spark):
    """Ties, nulls, NaN, a constant and an empty column; a coarse sketch misses ranks first."""
    draw = random.Random(3)
    rows = [(draw.gauss(0, 1), float(draw.randrange(4)), None if i % 3 else draw.random(), float("nan") if i % 50 == 0 else -draw.random(), 7, None)
            for i in range(4000)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int, f double").repartition(5)
    probs = [i / 7 for i in range(1, 7)] + [0.0, 1.0]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in names])).alias("_")).select("_.*")
    want = {r.k: r.q for r in quantiles.group_percentiles(long, ["k"], "v", probs).collect()}
    for accuracy in (10_000, 20):
        got = quantiles.column_percentiles(df, names, probs, accuracy)
        assert set(got) == set(want) == set("abcde")
        assert all(str(got[c]) == str(list(want[c])) for c in want)
    assert quantiles.column_percentiles(df, [], probs) == {}


def test_mutual_information_does_not_lay_rows_out_by_feature(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, float(i % 7), float(i * i % 11)) for i in range(300)], "y int, a double, b double")
    seen, explode = [], F.explode
    monkeypatch.setattr(F, "explode", lambda c: seen.append(c) or explode(c))
    got = {r.feature: r.score for r in stats.mutual_information(df, ["a", "b"], "y", 4).collect()}
    assert set(got) == {"a", "b"} and not seen

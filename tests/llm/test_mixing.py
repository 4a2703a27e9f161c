import pytest
from pyspark.sql import functions as F

from pandwerk.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight; cap; share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: most * sizes[s] for s in over})


def rows_of(spread):
    rows, n = [], 0
    for source, counts in spread.items():
        for c in counts:
            rows.append((n, " ".join(["w"] * c) if c else None, None, source))
            n += 1
    return rows


def result(docs, **how):
    rows, units = mixing.copies(docs, carry=("doc_id", "source"), **how)
    return units.join(rows.select("rid", "_c0", "_c1"), "rid").collect()


def test_targets_and_taken_words(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    spread = {"a": [7, 9, 3] * 100, "B": [5] * 400, "é": [2, 40] * 30, "b": [1] * 3, None: [11, 0] * 80, "zero": [0, 0]}
    docs = documents(rows_of(spread))
    got = result(docs)
    assert len(got) == docs.count()
    want = targets({s: sum(c) for s, c in spread.items()})
    for source, counts in spread.items():
        mine = [r for r in got if r["_c1"] == source]
        assert all(r["source_size"] == sum(counts) and 0 <= r["copies"] <= 3 for r in mine)
        assert mine[0]["target"] == pytest.approx(want[source])
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want[source]) <= max(counts) + 1e-6
    again = {(r["_c0"], r["copies"]) for r in result(docs.repartition(7, F.rand(3)))}
    assert again == {(r["_c0"], r["copies"]) for r in got}
    assert {(r["_c0"], r["copies"]) for r in result(docs, seed=1)} != again


def test_rounding_keeps_expectations():
    sizes, share = [3, 5, 8, 13, 21, 2], 0.3
    runs = [mixing.pivot([k * 977 + i for i in range(6)], sizes, [share] * 6, k) for k in range(4000)]
    for i in range(6):
        kept = [r[0][i] if r[0][i] is not None else r[2] for r in runs]
        assert abs(sum(kept) / len(kept) - share) < 0.03
    assert all(abs(sum(s * (r if r is not None else rest) for s, r in zip(sizes, up)) - share * sum(sizes)) < 1e-6
               for up, _, rest in runs)


def test_repeated_rows_nulls_and_the_mix_itself(documents):
    docs = documents([(None, "a b", None, None)] * 50 + [(1, "x y z", None, "s")] * 30 + [(2, "", None, "s")]).withColumn(
        "rid", F.lit("r")).withColumn("copies", F.lit(9))
    got = result(docs)
    assert len(got) == 81 and sum(r["copies"] * r["size"] for r in got) == pytest.approx(190, abs=5)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    words = {s: n for s, n in mix.groupBy("source").agg(F.sum(mixing.size_in_words(F.col("text")))).collect()}
    want = targets({"s": 90, None: 100})
    assert all(abs(words[s] - want[s]) <= 3 for s in want)
    assert mix.select("rid").distinct().collect()[0][0] == "r"
    assert mixing.mixed(documents([])).count() == 0

import random

import pytest
from pyspark.sql import functions as F

from pandwerk.llm import ngram_join


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, percent=85):
    """doc -> smallest doc reachable, by brute force."""
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {rows[i][0]: (len(sets[i]), rows[root(i)][0]) for i in range(len(rows))}


def corpus(seed=1):
    """Copies with few and many edits, shared passages, short and empty texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "One", "one", "one two three", "ONE two\tthree", "a b c d", "a b c d e", "é É", "É é"]
    passage = prose(60)
    for size in (5, 8, 12, 20, 40, 90, 250):
        for _ in range(3):
            origin = prose(size)
            texts.append(" ".join(origin))
            for edits in (0, 1, 1, 2, size // 50, size // 30, size // 15):
                copy = list(origin)
                for _ in range(edits):
                    copy[draw.randrange(size)] = draw.choice(vocabulary)
                texts.append(" ".join(copy) if draw.random() < 0.7 else " ".join(copy[:-1]))
            texts.append(" ".join(origin + passage))
    draw.shuffle(texts)
    return list(enumerate(texts))


def found(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.component_ids(docs, "doc_id").collect()}


def test_components_match_brute_force(documents):
    rows = corpus()
    assert found(documents([(i, t, None, None) for i, t in rows])) == expected(rows)


def test_blocks_of_one_cluster_match_brute_force(documents, monkeypatch):
    draw = random.Random(4)
    origin = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(origin)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(120)] = f"x{draw.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 2_000)
    monkeypatch.setattr(ngram_join, "DELEGATES", 2)
    assert found(documents([(i, t, None, None) for i, t in rows])) == expected(rows)


def test_rounds_change_nothing(documents):
    rows = corpus(7)
    docs = documents([(i, t, None, None) for i, t in rows])
    out = ngram_join.component_ids(docs, "doc_id", rounds=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(seed):
    import numpy as np

    bands, draw = ngram_join.Bands(), np.random.default_rng(seed)
    for size in (7, 9, 14, 33, 80, 200, 700, 3000):
        for _ in range(30):
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            changed = draw.integers(0, size // 8 + 2)
            b = np.unique(np.concatenate([a[draw.permutation(len(a))[changed:]],
                                          draw.integers(0, 1 << 63, draw.integers(0, changed + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if a.tobytes() != b.tobytes() and 100 * common >= 85 * (len(a) + len(b) - common):
                assert len(np.intersect1d(ngram_join.signatures(a, bands), ngram_join.signatures(b, bands)))


def test_one_row_of_each_group_stays(documents):
    text = "a b c d e f g h i j"
    docs = documents([(5, text, "x", None), (3, text, "y", None), (3, text, "z", None), (None, text, None, None),
                      (9, None, None, None), (None, "", None, None), (8, "other words here", None, None)]).withColumn(
        "rid", F.lit("mine")).withColumn("sid", F.lit(1))
    kept = ngram_join.deduplicated(docs, "doc_id").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["rid"]) for r in kept) == sorted(
        [(3, text, "mine"), (9, "", "mine"), (0, "", "mine"), (8, "other words here", "mine")])
    assert found(documents([])) == {}


def test_shuffles_of_finished_steps_are_deleted(spark, documents, monkeypatch):
    """Without a wait and without a collection of garbage: what a step shuffled is gone before the next one starts."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in str(manager.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in f}
    before, left = held(), []
    write = ngram_join.checkpointed

    def written(df):
        out = write(df)
        left.append(held() - before)
        return out

    monkeypatch.setattr(ngram_join, "checkpointed", written)
    rows = corpus()
    docs = documents([(i, t, None, None) for i, t in rows])
    kept = {r["doc_id"] for r in ngram_join.deduplicated(docs, "doc_id", percent=85, rounds=3).collect()}
    assert len(left) > 5 and not any(left[:3])
    assert kept == {i for i, (n, c) in expected(rows).items() if c == i or not n}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_chains_through_other_sizes_do_not_make_large_clusters(documents):
    """A ladder of texts, each close to the next larger one: sets meet those of their own and neighbouring sizes, not every
    set of the ladder."""
    prose = [f"w{i}" for i in range(700)]
    rows, size = [], 24.0
    while size < 650:
        rows.append((len(rows), " ".join(prose[:int(size)])))
        size *= 1.1
    docs = documents([(i, t, None, None) for i, t in rows])
    met = ngram_join.components(ngram_join._candidate_links(docs, "text", 4, 85, 1)).groupBy("component").count()
    assert 4 <= met.agg(F.max("count")).first()[0] <= len(rows) // 3


def test_blocks_compared_in_turns_match_brute_force(documents, monkeypatch):
    draw = random.Random(8)
    origin = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{draw.randrange(5000)}" if draw.random() < 0.03 else w for w in origin)) for i in range(60)]
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", 1_500)
    monkeypatch.setattr(ngram_join, "DELEGATES", 2)
    out = ngram_join.component_ids(documents([(i, t, None, None) for i, t in rows]), "doc_id", rounds=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected(rows)


def unrelated_with_a_passage(sizes, each, seed=11):
    """Texts of words of their own around one common passage, and two near copies of some."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for size in sizes:
        for _ in range(each):
            own = [f"w{draw.randrange(10**6)}" for _ in range(size)]
            at = draw.randrange(size)
            texts.append(" ".join(own[:at] + passage + own[at:]))
            if draw.random() < 0.1:
                texts += [" ".join([*own[:at], *passage, *own[at:], "z"]), " ".join(["y", *own[:at], *passage, *own[at:]])]
    return list(enumerate(texts))


def test_sets_that_share_a_signature_by_chance_are_not_compared(documents, monkeypatch):
    """A common passage gives unrelated sets common signatures: their sketches keep them out of the clusters."""
    rows = unrelated_with_a_passage((30, 40, 55), 60)
    sent, compare = [], ngram_join._compared_in_rounds

    def counted(some, *how):
        sent.append(some.select("sid").distinct().count())
        return compare(some, *how)

    monkeypatch.setattr(ngram_join, "_compared_in_rounds", counted)
    want = expected(rows)
    assert found(documents([(i, t, None, None) for i, t in rows])) == want
    linked = len({c for _, c in want.values()})
    assert 0 < sum(sent) < 2 * (len(rows) - linked) + 20 < len(rows) / 2


def test_bundles_of_signatures_and_rounds_by_size_match_brute_force(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "BUNDLE", 6)
    rows = unrelated_with_a_passage((14, 30), 30) + [(1000 + i, t) for i, t in corpus(3)]
    docs, want = documents([(i, t, None, None) for i, t in rows]), expected(rows)
    assert found(docs) == want
    for rounds in (2, 6):
        out = ngram_join.component_ids(docs, "doc_id", rounds=rounds).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_rounds_share_the_signatures_and_leave_none_out(documents):
    rows = ngram_join._sized(documents([(i, t, None, None) for i, t in corpus()]), "text", ["doc_id"], 4)
    all_ = {tuple(r) for r in ngram_join._signed(rows, "_t", 4, 85, 1, 0).collect()}
    for rounds in (2, 5):
        parts = [{tuple(r) for r in ngram_join._signed(rows, "_t", 4, 85, n, i, only).collect()} for only, n, i in ngram_join._rounds_of(rows, 85, rounds)]
        assert set().union(*parts) == all_ and sum(map(len, parts)) == len(all_) and max(map(len, parts)) < 2.2 * len(all_) / rounds

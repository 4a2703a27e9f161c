import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pandwerk.llm import mixing
from pandwerk.llm.common import checkpointed
from tests.llm.test_ngram_join import expected
from tests.llm.test_quality import counts


def corpus():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows = []
    for i in range(90):
        w = prose(draw.randint(60, 160))
        if i % 9 == 0:
            w[20] = f"password=live{i}secret"
        if i % 10 in (1, 2):
            w[10] = "token=copiedexample1"
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        if i % 6 == 0:
            copy = list(w)
            copy[5] = "changed"
            rows.append((1000 + i, " ".join(copy), "en", f"s{i % 3}"))
    return rows + [(2000, "short text", "en", "s0"), (2001, None, "en", "s1"), (2002, "a b c " * 60, "en", "s2"), (2003, "", None, None),
                   (2004, " ".join(x + "$$$" for x in prose(80)), "en", "s0")]


def test_stages_match_brute_force(spark, documents):
    rows = corpus()
    docs, kept = documents(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = checkpointed(stage(spark, docs, ""))
        kept[name] = docs.collect()
        if name != "encode":
            assert docs.columns == before.columns
    quality = {r["doc_id"] for r in kept["quality_rules"]}
    for i, t, _, _ in rows:
        n, _, symbols, _, repeated = counts(t)
        assert (i in quality) == (n >= 50 and 2 * repeated <= n and symbols < n)
    components = expected([(i, t) for i, t, _, _ in rows if i in quality])
    stay = {i for i, (_, least) in components.items() if i == least}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == stay and len(kept["near_duplicates"]) == len(stay) < len(quality)
    text = {i: t for i, t, _, _ in rows}
    for r in kept["secret_scan"]:
        clean = " ".join("[secret]" if w.startswith("password=") else w for w in text[r["doc_id"]].split(" "))
        assert r["text"] == clean and r["n_chars"] == len(clean)
    scanned = {r["doc_id"]: r["text"] for r in kept["secret_scan"]}
    assert set(scanned) == stay and any("token=copiedexample1" in t for t in scanned.values())
    taken = Counter(r["doc_id"] for r in kept["source_mix"])
    assert set(taken) <= stay and max(taken.values()) <= 3
    assert all(r["text"] == scanned[r["doc_id"]] for r in kept["source_mix"])
    want = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(kept["secret_scan"]).groupBy("source").agg(
        F.sum(mixing.size_in_words(F.col("text"))).alias("source_size"), F.count("*").alias("units"))).collect()}
    got = Counter()
    for r in kept["source_mix"]:
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - t) <= 160 for s, t in want.items())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter(r["doc_id"] for r in kept["encode"]) == taken
    for r in kept["encode"]:
        assert r["ids"] == library.encode(scanned[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, ""))
    assert docs.count() == 0


def test_stages_delete_earlier_scratch_but_nothing_they_read(spark, documents):
    from pandwerk.llm import common

    docs = documents(corpus())
    chained = corpus_pipeline.quality_rules(spark, docs, "")
    first = list(common._RECORDED)
    assert corpus_pipeline.source_mix(spark, chained, "").count() > 0  # its input still reads the first stage's table
    assert any(p in common._RECORDED for p in first)
    corpus_pipeline.source_mix(spark, docs, "").count()
    assert not any(p in common._RECORDED for p in first)


def test_near_duplicates_take_five_words_and_eighty_percent(spark, documents):
    """A passage appended to a copy: 5-word Jaccard 0.8 or more, 4-word Jaccard under 0.85."""
    from tests.llm.test_ngram_join import shingles

    w = [f"w{i}" for i in range(260)]
    long, copy, far = " ".join(w[:200]), " ".join(w[:240]), " ".join(f"v{i}" for i in range(200))
    jaccard = lambda n: len(shingles(long, n) & shingles(copy, n)) / len(shingles(long, n) | shingles(copy, n))
    assert jaccard(5) >= 0.8 and jaccard(4) < 0.85
    docs = documents([(1, long, "en", "a"), (2, copy, "en", "b"), (3, " ".join(w[:251]), "en", "a"), (4, far, "en", "a")])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 4}

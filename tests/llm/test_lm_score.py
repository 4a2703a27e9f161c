import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from pandwerk.llm import lm_score

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(lattice, word):
    if not word:
        return 1.0
    return sum(math.exp(p) * all_segmentations_from(lattice, word, j) for j, p, _ in lattice._edges(word, 0))


def all_segmentations_from(lattice, word, at):
    if at == len(word):
        return 1.0
    return sum(math.exp(p) * all_segmentations_from(lattice, word, j) for j, p, _ in lattice._edges(word, at))


def test_forward_recursion_sums_all_segmentations():
    lattice = lm_score.Lattice({" ": -1.0, " a": -1.5, "a": -2.0, "ab": -2.5, "b": -3.0, "abc": -4.0, "c": -3.5}, [-6.0] * 256)
    for word in ("a", "ab", "abc", "cab", "abcabc", "zab", "é"):
        assert lattice.total(word) == pytest.approx(math.log(all_segmentations(lattice, " " + word)))
    assert lattice.best("abc") == [" ", "abc"] and lattice.best("ab") == [" ", "ab"] and lattice.best("a") == [" a"]
    assert lattice.best("zb") == [" ", "<0x7A>", "b"] and lattice.best("é") == [" ", "<0xC3>", "<0xA9>"]


def test_long_words_stay_in_range():
    lattice = lm_score.Lattice(*lm_score.vocabulary(PATH))
    assert -math.inf < lattice.total("the" * 20_000) < 0


def test_probabilities_sum_to_one():
    pieces, byte_p, end = lm_score.trained({" the": 5, "a": 2, "<0x41>": 1}, 3, PATH)
    assert sum(map(math.exp, [*pieces.values(), *byte_p, end])) == pytest.approx(1.0)


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_DOCS", 16)
    texts = [None, "", "The the THE\tcat", "a b c d e f", "ünknown Wörter", "the cat sat " * 40, "x" * 3000] * 12
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "again 3"), (3, "again 3")]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, chunk int, word binary")
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    start, pieces = lm_score.Lattice(*lm_score.vocabulary(PATH)), Counter()
    for w, c in counts.items():
        for p in start.best(w):
            pieces[p] += c
    log_p, byte_p, end = lm_score.trained(pieces, ends, PATH)
    lattice = lm_score.Lattice(log_p, byte_p)

    def want(i, t):
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        return (i, held(i), len(w) + 1, sum(x in counts for x in w) + 1, n, round(base, 6),
                round((sum(lattice.total(x) for x in w) + end) / math.log(10), 6))

    got = [(*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6))
           for r in lm_score.scored(docs, "doc_id", path=PATH).collect()]
    assert sorted(got, key=repr) == sorted((want(i, t) for i, t in rows), key=repr)


def test_empty_and_all_held_out(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.scored(empty, "doc_id", path=PATH).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.scored(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), "doc_id", path=PATH).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0)
    assert row["score"] < 0


def test_plain_numbers_give_the_sum_of_logs():
    """Both ways to add up a word's segmentations agree; where plain numbers would run out, logs take over."""
    lattice = lm_score.Lattice(*lm_score.vocabulary(PATH))
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeinrstüß日🙂́") for _ in range(draw.randint(1, 90))) for _ in range(300)] + ["the", "🙂" * 60]
    for word in words:
        assert lattice.total(word) == pytest.approx(lattice._total_of_logs(" " + word), rel=1e-13)
    assert lattice.total("🙂" * 60) < math.log(lm_score.PLAIN_LEAST)
    asked = []
    lattice._total_of_logs = asked.append
    for word in ("the", "internationalization"):
        lattice.total(word)
    assert not asked

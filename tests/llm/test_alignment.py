import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pandwerk.llm import alignment
from pandwerk.llm.queries import QUERIES

PATHS = {"byte_path": public_tokenizers.path("byte_bpe_50k.json"), "piece_path": public_tokenizers.path("piece_bpe_32k.model")}


def brute(texts):
    """Per text (n_a, n_b, groups text, n_groups, n_links, n_best, count_sum), every pair of tokens compared."""
    first = Tokenizer.from_file(PATHS["byte_path"])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS["piece_path"])
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    out, total = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids
        b = second.encode(t or "")
        pa = [bytes(table[c] for c in first.id_to_token(i)) for i in a]
        pb = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
              for i in b]
        if not t or b"".join(pa) != raw or b"".join(pb) != raw:
            out.append(None)
            continue
        ra, rb = ranges(pa), ranges(pb)
        links = [(a[i], b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
        total.update(links)
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
            i2, j2 = i, j
            while i2 < len(a) and ra[i2][1] <= cut:
                i2 += 1
            while j2 < len(b) and rb[j2][1] <= cut:
                j2 += 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        out.append((len(a), len(b), ";".join(groups), len(groups), links))
    most = Counter()
    for (x, y), n in total.items():
        most[y] = max(most[y], n)
    return [(0, 0, "", 0, 0, 0, 0) if o is None else (
        *o[:4], len(o[4]), sum(total[p] == most[p[1]] for p in o[4]), sum(total[p] for p in o[4])) for o in out]


TEXTS = [None, "", " ", "a", "The quick brown fox", "  two  spaces\tand\n\nlines ", "naïve café — für Öl, 日本語 🙂🙂 ́x", "<s>hello</s> <|endoftext|> <0x41> ▁low",
         "ﬁne ligature and   hard space", "internationalization antidisestablishmentarianism 1234567890 ==>>",
         "� \x00 \x07 zero", "same same same", "same same same"]


def found(docs, **how):
    out = alignment.aligned_corpus(docs, carry=("doc_id",), **PATHS, **how)
    return {r["_c0"]: (r["n_a"], r["n_b"], r["groups"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in out.collect()}


def corpus(seed=3):
    draw = random.Random(seed)
    words = [w for t in TEXTS if t for w in t.split(" ")] + ["".join(draw.choice("abcdeéß ") for _ in range(9)) for _ in range(40)]
    return TEXTS + [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(30)]


@pytest.mark.parametrize("known", [alignment.KNOWN_PAIRS, 40])
def test_matches_brute_force_with_and_without_pairs_beyond_the_known(documents, known):
    texts = corpus()
    docs = documents([(i, t, None, None) for i, t in enumerate(texts)])
    assert found(docs, known_pairs=known) == dict(enumerate(brute(texts)))


def test_query_digests(spark, documents, tmp_path):
    texts = corpus(9)
    documents([(i, t, "x", None) for i, t in enumerate(texts)]).withColumn("pairs", F.lit("mine")).write.parquet(
        str(tmp_path / "documents.parquet"))
    want = brute(texts)
    out = QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    for r in out:
        n_a, n_b, groups, n_groups, n_links, n_best, count_sum = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (
            n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


@pytest.mark.parametrize("seed", range(6))
def test_groups_end_at_common_ends(seed):
    """Runs of every length around the doubling steps, against the set of common ends."""
    draw = np.random.default_rng(seed)
    for _ in range(200):
        end = int(draw.integers(1, 200))
        cuts = [np.union1d(np.flatnonzero(draw.random(end) < p), [end]) for p in draw.choice([0.02, 0.3, 0.9, 1.0], 2)]
        a, b = (c[c > 0].astype(np.int64) for c in cuts)
        shared = np.flatnonzero(draw.random(end) < draw.choice([0.0, 0.9]))
        a, b = (np.union1d(x, shared[shared > 0]).astype(np.int64) for x in (a, b))
        cuts = alignment.stretches(a, b)
        count, at_a, at_b = alignment.linked(cuts)
        common = np.intersect1d(a, b)
        bounds = np.union1d(a, b)
        assert count == len(common)
        assert at_a.tolist() == np.searchsorted(a, bounds).tolist() and at_b.tolist() == np.searchsorted(b, bounds).tolist()
        ends = [x for i, n in zip(cuts[0], cuts[2]) for x in (a[i:i + n] if n > 0 else a[i:i + 1] if n else ())]
        assert ends == common.tolist()


def test_both_libraries_give_the_same_ids():
    """Spaces of every sort beside letters, digits, marks, emoji and quotes; then every character of the settled ranges."""
    assert alignment.ranks_decide(PATHS["byte_path"])
    draw = random.Random(8)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "a", "the", "é", "e\u0301", "\u0301", "'s", "'", "12", "½", "ﬁ", "日本",
             "🙂", "...", "▁", "<s>", "<|endoftext|>", "İ", "x" * 70, "\u00ad", " " * 600]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(4000)]
    ranges = ((0, 0x530), (0x2010, 0x205F), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}b" for low, high in ranges for c in range(low, high)]
    tokens = alignment.ByteTokens(PATHS["byte_path"], True)
    assert tokens.fast is not None and tokens.encode(texts) == tokens._whole(texts)
    assert sum(alignment.UNSETTLED.search(t) is None for t in texts) > 30_000


def test_long_text_null_columns_repeats_and_empty_table(documents):
    long = "word " * 60_000 + "x" * 50_000
    docs = documents([(1, long, None, None), (1, long, None, None), (None, "short", None, None)]).withColumn("groups", F.lit(1))
    out = alignment.aligned_corpus(docs, **PATHS, digest=True).collect()
    assert sorted((r["_c0"] or 0, r["n_a"] > 60_000) for r in out) == [(0, False), (1, True), (1, True)]
    assert found(documents([])) == {}


@pytest.mark.parametrize("seed", range(3))
def test_text_of_an_alignment_is_put_together_from_arrays(seed):
    """Groups of every shape, against groups joined one by one; ids of every length."""
    draw = np.random.default_rng(seed)
    names = alignment.Names(60_000, 40_000)
    for _ in range(100):
        end = int(draw.integers(1, 120))
        a, b = (np.union1d(np.flatnonzero(draw.random(end) < p), [end]).astype(np.int64) for p in draw.choice([0.05, 0.4, 0.9], 2))
        a, b = a[a > 0], b[b > 0]
        row_a, row_b = (draw.integers(0, 10 ** draw.integers(1, 5, len(x))) for x in (a, b))
        at_a, at_b, last = alignment.expanded(alignment.stretches(a, b))
        groups, low = [], 0
        for cut in np.intersect1d(a, b):
            groups.append("|".join(",".join(map(str, row[(x > low) & (x <= cut)])) for row, x in ((row_a, a), (row_b, b))))
            low = cut
        assert alignment.written(row_a, row_b, at_a[last], at_b[last], names).decode() == ";".join(groups)


def test_bytes_of_many_tokens_at_once():
    spelt = alignment.Spelling({0: b"ab", 2: b"", 3: b"\x00", 5: "é".encode()})
    for ids, raw in (([0, 3, 2, 5], b"ab\x00\xc3\xa9"), ([], b""), ([2], b"")):
        assert spelt.gives(np.array(ids, np.int64), raw)
    for ids, raw in (([0, 3], b"ab\x01"), ([0], b"a"), ([1, 0], b"ab"), ([], b"a")):
        assert not spelt.gives(np.array(ids, np.int64), raw)

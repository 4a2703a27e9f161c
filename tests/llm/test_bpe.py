import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pandwerk.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(PATH)
ENCODER, LIBRARY = bpe.Encoder(VOCABULARY), Tokenizer.from_file(PATH)
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "漢字", "😀", "<|endoftext|>", "'s", "'ll", "12", "!!", "\x00", "́", "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60))
def test_ids_are_the_librarys(parts):
    text = "".join(parts)
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.Decoder(VOCABULARY).decode(ids, portion=3) == text


def test_long_runs_pass_through_the_window():
    draw = random.Random(5)
    for letters in ("ab", "thein", "=-", " ", "*#", "éèàaou", "漢字", "aaaaaaab", "abcdefghijklmnopqrstuvwxyz"):
        for n in (ENCODER.window - 1, ENCODER.window + 1, 20_000):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert ENCODER.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tokens_before_the_lookahead_are_final():
    draw = random.Random(8)
    for letters in ("thein ", "=-_", "ab", " \n"):
        raw = "".join(draw.choice(letters) for _ in range(600)).encode()
        whole = ENCODER._merge_long([VOCABULARY.byte_id[b] for b in raw])
        for cut in range(200, 600, 23):
            part, size = ENCODER._merge_long([VOCABULARY.byte_id[b] for b in raw[:cut]]), 0
            for a, b in zip(part, whole):
                size += len(VOCABULARY.bytes_of[a])
                if size > cut - VOCABULARY.lookahead:
                    break
                assert a == b


def test_unfinished_characters_are_replaced():
    assert bpe.Decoder(VOCABULARY).decode([VOCABULARY.byte_id[0xE6], VOCABULARY.byte_id[0x61]]) == "�a"


def test_round_trip_of_a_table(documents):
    texts = [None, "", "a b", "é" * 30_000, "a b"]
    docs = documents([(i or None, t, None, None) for i, t in enumerate(texts)]).withColumn("ids", F.lit(3))
    got = bpe.encode_decode(docs, path=PATH, carry=("doc_id", "n_chars")).collect()
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for t in texts)
    assert all(r["ids"] == LIBRARY.encode(r["decoded"], add_special_tokens=False).ids for r in got)
    assert bpe.encode_decode(docs.limit(0), path=PATH).count() == 0

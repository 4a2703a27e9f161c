"""Alignment of two tokenizers over one text, and how often their tokens meet across a corpus.

Both tokenizations cut the same bytes. Where they end a token at the same byte, a group ends; most groups pair one token
with one token, and along such a stretch the places in the two end arrays differ by a constant shift. `stretches` runs along
that diagonal in doubling steps, resolves what lies between two stretches token by token and goes on at the new shift.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed

#: Texts handed to the tokenizers at a time, and characters of them at most (a longer text goes alone).
ROWS, CHARACTERS = 256, 1 << 20
#: Characters beyond those whose class has not changed for many Unicode versions, and runs of white space of 500.
UNSETTLED = re.compile(r"[^\u0000-\u052f\u2010-\u205e\u4e00-\u9fa5\uac00-\ud7a3]|\s{500}")
#: Pairs put together before a task counts them.
PENDING = 1 << 21
#: Token pairs known to every task when links are scored: all, or if there are more those with the largest counts.
KNOWN_PAIRS = 1_000_000


def ranks_decide(path: str) -> bool:
    """Whether merging by the rank of the merged token, as the faster library does, is merging by the file's list of pairs.

    It is if the list builds every token from the token's own bytes: tokens that lie side by side and make up a token have,
    up to that token's rank, been merged as if alone (a merge across either end would have left a token across it), so
    they are the pair of the list.
    """
    from pandwerk.llm.bpe import Encoder, Vocabulary

    vocabulary = Vocabulary(path)
    encoder = Encoder(vocabulary)
    in_order = all(i < k for i, k in zip(vocabulary.new_id, vocabulary.new_id[1:]))
    return in_order and all(encoder._merge_short([vocabulary.byte_id[b] for b in raw]) == [i] for i, raw in vocabulary.bytes_of.items()
                          if i not in vocabulary.special.values())


class ByteTokens:
    """Token ids of a byte-level BPE file for a space and each text; strings of special tokens in a text are plain text.

    Where `by_rank` allows, texts of long-settled characters go through the faster of two libraries; characters that the
    Unicode tables of the two may class differently, and very long white space, through the file's own.
    """

    def __init__(self, path: str, by_rank: bool = False):
        from tokenizers import Tokenizer

        from pandwerk.llm.bpe import PATTERN, _printable_bytes

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        printable = _printable_bytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(printable[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in printable for c in s)}
        self.fast = None
        if by_rank and not spec.get("normalizer") and spec["pre_tokenizer"] == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            import tiktoken

            ranks = {v: i for i, v in self.bytes_of.items() if i not in special}
            self.fast = tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._whole(texts)
        settled = [UNSETTLED.search(t) is None for t in texts]
        others = iter(self._whole([t for t, s in zip(texts, settled) if not s]))
        return [self.fast(" " + t) if s else next(others) for t, s in zip(texts, settled)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """Token ids of a piece model, which puts a space before each text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def stretches(ends_a, ends_b):
    """Lists (i, j, length) that cut both token rows: length > 0 for a stretch of that many one-to-one groups from tokens i
    and j on, 0 for a step of an irregular group (i and j overlap, the group goes on) and -1 for its last step.

    `ends_*`: int64 arrays of byte ends, of one last value. A stretch is found by comparing both arrays at the present shift
    over 1, 2, 4, ... tokens; the step that fails is bisected. An irregular group is walked token by token to its end.
    """
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    n, m = len(a), len(b)
    at_a, at_b, length = [], [], []
    add_a, add_b, add = at_a.append, at_b.append, length.append
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        add_a(i)
        add_b(j)
        if x != y:
            add(0)
            while True:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                add_a(i)
                add_b(j)
                if x == y:
                    break
                add(0)
            add(-1)
            i += 1
            j += 1
            continue
        good, step, most = 1, 2, min(n - i, m - j)
        while good < most:
            if step > most - good:
                step = most - good
            p, q, size = 8 * (i + good), 8 * (j + good), 8 * step
            if raw_a[p:p + size] != raw_b[q:q + size]:
                while step > 1:  # the `step` places after `good` differ somewhere
                    half = step // 2
                    p, q, size = 8 * (i + good), 8 * (j + good), 8 * half
                    if raw_a[p:p + size] == raw_b[q:q + size]:
                        good += half
                        step -= half
                    else:
                        step = half
                break
            good += step
            step *= 2
        add(good)
        i += good
        j += good
    return at_a, at_b, length


class Names:
    """Ids of both sides as text with what follows them in a written alignment: byte strings of one width, zeros behind."""

    def __init__(self, size_a: int, size_b: int):
        import numpy as np

        self.starts = np.cumsum([0, size_a, size_a, size_b]).tolist()
        texts = [f"{i}{mark}" for size, mark in ((size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")) for i in range(size)]
        self.texts = np.array(texts, "S")


def expanded(cuts):
    """Places of the A and B tokens of every link in order, and whether the link ends a group."""
    import numpy as np

    at_a, at_b, length = (np.array(c, np.int64) for c in cuts)
    each = np.maximum(length, 1)
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(at_a, each) + inside, np.repeat(at_b, each) + inside, np.repeat(length != 0, each)


def written(row_a, row_b, end_a, end_b, names: Names) -> bytes:
    """The alignment as text, `a1,a2|b1;a3|b2,b3`; `end_*` are the places of the last tokens of every group."""
    import numpy as np

    a, a_last, b, b_last = names.starts
    code_a, code_b = row_a + a, row_b + b
    code_a[end_a] += a_last - a
    code_b[end_b] += b_last - b
    out = np.empty(len(row_a) + len(row_b), np.int64)
    # a group's A tokens follow the B tokens of earlier groups, its B tokens all A tokens so far
    out[np.arange(len(row_a)) + np.repeat(np.append(0, end_b[:-1] + 1), np.diff(end_a, prepend=-1))] = code_a
    out[np.arange(len(row_b)) + np.repeat(end_a + 1, np.diff(end_b, prepend=-1))] = code_b
    return names.texts[out].tobytes().translate(None, b"\0")[:-1]


class Spelling:
    """Bytes of the tokens of one side, put together for many ids at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        import numpy as np
        import pyarrow as pa

        self.size = 1 + max(bytes_of)
        self.table = pa.array([bytes_of.get(i) for i in range(self.size)], pa.binary())
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(bytes_of)] = [len(v) for v in bytes_of.values()]

    def gives(self, row, raw: bytes) -> bool:
        """Whether the tokens' bytes, joined, are `raw`."""
        import pyarrow as pa

        if self.lengths[row].sum() != len(raw):
            return False
        found = self.table.take(pa.array(row))
        return found.null_count == 0 and (not raw or found.buffers()[2].to_pybytes()[:len(raw)] == raw)


def linked(cuts):
    """(number of groups, places of A tokens, places of B tokens): every pair of tokens whose byte ranges overlap."""
    at_a, at_b, last = expanded(cuts)
    return int(last.sum()), at_a, at_b


def _portions(texts: list[str]):
    """Places of texts that go to the tokenizers together."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and (len(some) == ROWS or size + len(t) > CHARACTERS):
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


def alignments(docs: DataFrame, text: str = "text", *, byte_path: str, piece_path: str, carry: tuple[str, ...] | None = None,
               digest: bool = False) -> DataFrame:
    """The `carry` columns (default: all but the text) as _c0, _c1, ..., then n_a, n_b, n_groups, n_links (long), `groups` and
    `pairs`: array<struct<a, b, links>>, every distinct pair of linked ids with how often this text links it.

    `groups` is the alignment as text, `a1,a2|b1;a3|b2,b3` in ids; with `digest` its SHA-256, which keeps stored tables
    small ('' for a text without tokens). Tokenizer A gets the text after a space, tokenizer B puts one there. Texts that
    are null or empty, and texts of which either tokenizer does not give back every byte, have no tokens. Texts are
    aligned whole, whatever their length. Repeated rows stay. Row-local: no shuffle.
    """
    from pyspark.sql import types as T

    carry = [c for c in docs.columns if c != text] if carry is None else list(carry)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("_text"))
    pairs = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType(), False) for c in ("a", "b", "links")]), False)
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType(), False) for c in (
        "n_a", "n_b", "n_groups", "n_links")], T.StructField("groups", T.StringType(), False), T.StructField("pairs", pairs, False)])

    by_rank = ranks_decide(byte_path)

    def run(batches):
        import hashlib
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        first, second = ByteTokens(byte_path, by_rank), PieceTokens(piece_path)
        spelt_a, spelt_b = Spelling(first.bytes_of), Spelling(second.bytes_of)
        names = Names(spelt_a.size, spelt_b.size)
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))

        def one(t, ids_a, ids_b):
            raw = (" " + t).encode()
            row_a, row_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            if not t or not spelt_a.gives(row_a, raw) or not spelt_b.gives(row_b, raw):
                return nothing
            cuts = stretches(np.cumsum(spelt_a.lengths[row_a]), np.cumsum(spelt_b.lengths[row_b]))
            at_a, at_b, last = expanded(cuts)
            groups = written(row_a, row_b, at_a[last], at_b[last], names)
            groups = hashlib.sha256(groups).hexdigest() if digest else groups.decode()
            key, links = np.unique(row_a[at_a] << 32 | row_b[at_b], return_counts=True)
            return len(ids_a), len(ids_b), int(last.sum()), len(at_a), groups, key, links

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for places in _portions(texts):
                some = [texts[i] for i in places]
                found = [one(*x) for x in zip(some, first.encode(some), second.encode(some))]
                key, links = (np.concatenate([f[c] for f in found]) for c in (5, 6))
                ends = np.concatenate([[0], np.cumsum([len(f[5]) for f in found])]).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(links.astype(np.int32))], names=["a", "b", "links"])
                part = batch.slice(places[0], len(places))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array([f[c] for f in found], pa.int64()) for c in range(4)],
                     pa.array([f[4] for f in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends), items)],
                    names=[*part.schema.names[:-1], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): links of every pair over all texts; `best` where no pair of the same b has more.

    Each task first adds up the pairs of many texts, so a pair that is in every text reaches the shuffle a few times.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, links, waiting = [], [], 0

        def counted():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(links)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)),
                                               pa.array(total)], names=["a", "b", "links"])

        for batch in batches:
            items = batch.column("pairs").flatten()
            a, b, n = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            keys.append(a << 32 | b)
            links.append(n)
            waiting += len(a)
            if waiting > PENDING:
                yield counted()
                keys, links, waiting = [], [], 0
        if waiting:
            yield counted()

    totals = aligned.select("pairs").mapInArrow(run, "a int, b int, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))
    totals = checkpointed(totals)
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    return totals.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _known(counts: DataFrame, limit: int):
    """(sorted pair keys, links, best) of at most `limit` pairs for every task, and whether that is all of them. Of more
    pairs those with at least total / limit links are taken, of which there cannot be more than `limit`."""
    import numpy as np

    row = counts.agg(F.count("*").alias("n"), F.sum("links").alias("total")).first()
    whole = row["n"] <= limit
    chosen = counts if whole else counts.where(F.col("links") >= math.ceil(row["total"] / limit))
    table = chosen.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("key"),
                          "links", "best").toArrow()
    key, links, best = (table.column(c).to_numpy() for c in ("key", "links", "best"))
    order = np.argsort(key)
    return key[order], links[order], best[order].astype(np.int64), whole


def with_link_scores(aligned: DataFrame, counts: DataFrame, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """Replace `pairs` by n_best (links whose pair is the best of its b) and count_sum (the pairs' corpus-wide links, added
    up over this text's links). `aligned` and `counts` are written tables.

    Frequent pairs are known to every task; pairs beyond them are joined by pair and added up per text.
    """
    from pyspark.sql import types as T

    *arrays, whole = _known(counts, known_pairs)
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(arrays))
    slim = aligned.withColumn("_rid", F.monotonically_increasing_id())
    kept = [f for f in slim.schema.fields if f.name != "pairs"]
    rest = T.ArrayType(slim.schema["pairs"].dataType.elementType, False)
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("_rest", rest)])
    slim = slim.select(*[f.name for f in kept], "pairs")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, links, best = shared.value
        for batch in (some.slice(at, 4 * ROWS) for some in batches for at in range(0, some.num_rows, 4 * ROWS)):
            column = batch.column("pairs")
            items = column.flatten()
            a, b, n = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            mine = a << 32 | b
            at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
            hit = key[at] == mine if len(key) else np.zeros(len(mine), bool)
            sums = []
            for weight in (best, links):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, owner[hit], n[hit] * weight[at[hit]])
                sums.append(pa.array(total))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))]).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(ends), items.filter(pa.array(~hit)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums, left],
                                             names=[*batch.schema.names[:-1], "n_best", "count_sum", "_rest"])

    scored = slim.mapInArrow(run, schema)
    if whole:
        return scored.drop("_rid", "_rest")
    scored = checkpointed(scored)
    beyond = scored.where("size(_rest) > 0").select("_rid", F.explode("_rest").alias("p")).select(
        "_rid", "p.a", "p.b", F.col("p.links").alias("here"))
    added = beyond.join(counts, ["a", "b"]).groupBy("_rid").agg(
        F.sum(F.when(F.col("best"), F.col("here")).otherwise(0)).alias("_best"), F.sum(F.col("here") * F.col("links")).alias("_sum"))

    def plus(name: str, more: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(more), F.lit(0))).alias(name)

    names = [f.name for f in kept if f.name != "_rid"]
    loud = scored.where("size(_rest) > 0").join(added, "_rid", "left").select(*names, plus("n_best", "_best"), plus("count_sum", "_sum"))
    return scored.where("size(_rest) = 0").select(*names, "n_best", "count_sum").unionByName(loud)


def aligned_corpus(docs: DataFrame, text: str = "text", *, byte_path: str, piece_path: str, carry: tuple[str, ...] | None = None,
                   digest: bool = False, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """`alignments` of every row with n_best and count_sum in place of the pairs; an empty table gives an empty result."""
    aligned = checkpointed(alignments(docs, text, byte_path=byte_path, piece_path=piece_path, carry=carry, digest=digest))
    return with_link_scores(aligned, checkpointed(pair_counts(aligned)), known_pairs)

"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its incremental decoder.

A merge list decides how far to the left an appended byte can change tokens: only along chains of merges of
rising rank that compete for, or build on, one token. `sufficient_lookahead` bounds the longest such chain in
bytes. Tokens that end further than that from the end of what has been read are final, so the encoder needs a
window of fixed size, whatever the length of a run without a break.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Splits text before merging; fixed value of the tokenizer's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces up to this many bytes are merged in one go and remembered; longer ones pass through the window.
WHOLE_PIECE = 64
#: Pieces remembered per worker; when full, the memory starts afresh.
REMEMBERED = 250_000
#: Pieces of texts up to this many characters are listed at once, those of longer ones found one by one.
LISTED = 1 << 20
#: Texts handed over at a time.
ROWS = 256
NO_RANK = 1 << 62


def _printable_bytes() -> dict[str, int]:
    """The format writes each byte as one printable character: itself where printable, else 256 upwards in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, following = {}, 256
    for b in range(256):
        table[chr(b) if b in own else chr(following)] = b
        following += b not in own
    return table


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the left of an appended byte that its merges can change, at most.

    reach[t]: how far left of token t a change of t's fate can spread through merges ranked later. From last rank
    to first: a merge (u, v) lets a change of v spread over u and on from u or uv; a change of u lets uv appear
    or vanish at the same place.
    """
    reach: dict[bytes, int] = {}
    for u, v in reversed(merges):
        merged = reach.get(u + v, 0)
        right = len(u) + max(reach.get(u, 0), merged)
        if right > reach.get(v, 0):
            reach[v] = right
        if merged > reach.get(u, 0):
            reach[u] = merged
    return max(reach.values(), default=0)


class Vocabulary:
    """Tokens, ranks and special tokens of a byte-level BPE file, and the window its merges need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = _printable_bytes()
        raw = lambda s: bytes(printable[c] for c in s)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in ids.items() if s not in self.special}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.byte_id = [0] * 256
        for c, b in printable.items():
            self.byte_id[b] = ids[c]
        self.rank = {ids[u] << 32 | ids[v]: rank for rank, (u, v) in enumerate(pairs)}
        self.new_id = [ids[u + v] for u, v in pairs]
        self.lookahead = sufficient_lookahead([(raw(u), raw(v)) for u, v in pairs])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(
            vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.hold = max(1, vocabulary.lookahead)
        self.window = 8 * self.hold

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.specials is None:
            self._plain(text, out)
            return out
        for part in self.specials.split(text):
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                self._plain(part, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        known, extend = self.known, out.extend
        at_once = len(text) <= LISTED
        for piece in self.pieces.findall(text) if at_once else (m.group() for m in self.pieces.finditer(text)):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode()
                if len(raw) > WHOLE_PIECE:
                    for some in self.stream(raw):
                        extend(some)
                    continue
                ids = tuple(self._merge_short([self.v.byte_id[b] for b in raw]))
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = ids
            extend(ids)

    def stream(self, raw: bytes) -> Iterator[list[int]]:
        """Tokens of one piece in order, each list final when handed out; holds one window of bytes and no more."""
        at = 0
        while at < len(raw):
            chunk = raw[at:at + self.window]
            ids = self._merge_long([self.v.byte_id[b] for b in chunk])
            if at + len(chunk) == len(raw):
                yield ids
                return
            size, stable = 0, 0
            for i in ids:
                if size + len(self.v.bytes_of[i]) > len(chunk) - self.hold:
                    break
                size += len(self.v.bytes_of[i])
                stable += 1
            yield ids[:stable]
            at += size

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of least rank until none is left; only the ranks beside it change."""
        rank, new_id = self.v.rank.get, self.v.new_id
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            ids[i] = new = new_id[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place): n log n for windows without repeats."""
        rank, n = self.v.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank(ids[i] << 32 | ids[i + 1])
            if found is not None:
                heap.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = self.v.new_id[least], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    found = rank(ids[a] << 32 | ids[b])
                    if found is not None:
                        heapq.heappush(heap, (found, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]


class Decoder:
    """Ids to text, in any portions: bytes of an unfinished character wait for the next portion; bytes that
    cannot become one turn into U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.text.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        out = self.text.decode(b"", True)
        self.text.reset()
        return out

    def decode(self, ids, portion: int = 4096) -> str:
        parts = [self.feed(ids[i:i + portion]) for i in range(0, len(ids), portion)]
        return "".join(parts) + self.end()


def encode_decode(docs: DataFrame, text: str = "text", *, path: str, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The `carry` columns (default: all but the text), `ids` array<int> and `decoded`, the text of those ids.

    `path` is the tokenizer file, present on every worker. Special tokens in a text become their ids; nothing is
    added, cut or padded. Null and empty texts have no ids and decode to an empty text; a text of any length
    is encoded whole; repeated rows stay. Row-local: no shuffle; a worker holds the vocabulary, a bounded memory
    of pieces and a slice of rows.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    carry = [c for c in docs.columns if c not in (text, "ids", "decoded")] if carry is None else list(carry)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
                           T.StructField("decoded", T.StringType(), False)])

    def run(batches):
        import numpy as np

        vocabulary = Vocabulary(path)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [encoder.encode(t or "") for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                flat = np.concatenate([np.asarray(i, np.int32) for i in found]) if found else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                     pa.array([decoder.decode(i) for i in found], pa.string())],
                    names=[*part.schema.names[:-1], "ids", "decoded"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "ids", "decoded")

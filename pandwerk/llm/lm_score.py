"""Document likelihood under a subword unigram model, summed over all segmentations.

Words are reduced to one row per chunk of documents and distinct word before anything is shuffled; they are dealt by
hash once, into a bucketed table that both the word counts and the scoring read without another shuffle. The
lattice of a word is walked once per distinct word of the corpus. The model is the vocabulary's own pieces; its
scores start the segmentation of the training words, whose best segmentations give the pieces' probabilities.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandwerk.llm.common import checkpointed

#: Remainder of crc32(id as text) modulo FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2
#: A chunk ends with this many tokens or documents.
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 1 << 14
#: Keys set aside for a chunk: its number times this, plus a document's place.
CHUNK_ROOM = 1 << 14
#: Added to every piece's count.
SMOOTHING = 0.1
#: Pairs of document and word summed in a task before they are handed over.
PAIRS = 2_000_000
#: Added to a piece's rank when the vocabulary's scores are turned into first probabilities.
RANK_SHIFT = 10.0
#: Words of at most this many characters, the mark included, are first summed in plain numbers; sums above this least are
#: kept, as what was too small to be held is then nothing beside them.
PLAIN_CHARACTERS, PLAIN_LEAST = 64, 1e-250
#: What is neither a piece nor the start of one.
NOWHERE = (None, False)


class Lattice:
    """Pieces with log probabilities; segmentations of one word at a time. A word starts with a mark (a space, which no
    word holds), so that pieces never reach across words."""

    def __init__(self, log_p: dict[str, float], byte_p: list[float]):
        self.log_p, self.byte_p = log_p, byte_p
        self.starts = {p[:i] for p in log_p for i in range(1, len(p))}
        # one look-up a step: (log probability, probability) or None for what is only a start, and whether longer pieces follow
        self.steps = {p: ((log_p[p], math.exp(log_p[p])) if p in log_p else None, p in self.starts) for p in {*log_p, *self.starts}}

    def _edges(self, word: str, i: int):
        """(end, log probability, piece or None for bytes) of all pieces that start at i."""
        log_p, starts, n = self.log_p, self.starts, len(word)
        j = i + 1
        part = word[i:j]
        found = log_p.get(part)
        if found is None:
            yield j, sum(self.byte_p[b] for b in part.encode("utf-8", "surrogatepass")), None
        else:
            yield j, found, part
        while part in starts and j < n:
            j += 1
            part = word[i:j]
            found = log_p.get(part)
            if found is not None:
                yield j, found, part

    def total(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations: forward recursion over the ends of pieces.

        Probabilities are added as they are while the word's own stays far above the smallest numbers, else as logs.
        """
        marked = " " + word
        n = len(marked)
        if n > PLAIN_CHARACTERS:
            return self._total_of_logs(marked)
        ahead = [0.0] * (n + 1)
        ahead[0] = 1.0
        step = self.steps.get
        for i in range(n):
            value = ahead[i]
            j = i + 1
            part = marked[i]
            found, longer = step(part, NOWHERE)
            if found is not None:
                ahead[j] += value * found[1]
            else:
                ahead[j] += value * math.exp(sum([self.byte_p[b] for b in part.encode("utf-8", "surrogatepass")]))
            while longer and j < n:
                j += 1
                found, longer = step(marked[i:j], NOWHERE)
                if found is not None:
                    ahead[j] += value * found[1]
        return math.log(ahead[n]) if ahead[n] > PLAIN_LEAST else self._total_of_logs(marked)

    def _total_of_logs(self, word: str) -> float:
        n = len(word)
        ahead: list = [None] * (n + 1)
        ahead[0] = [0.0]
        value = 0.0
        log, exp = math.log, math.exp
        for i in range(n):
            terms = ahead[i]
            ahead[i] = None
            if len(terms) == 1:
                value = terms[0]
            else:
                top = max(terms)
                value = top + log(sum([exp(t - top) for t in terms]))
            for j, p, _ in self._edges(word, i):
                if ahead[j] is None:
                    ahead[j] = [value + p]
                else:
                    ahead[j].append(value + p)
        terms = ahead[n]
        top = max(terms)
        return top + log(sum([exp(t - top) for t in terms]))

    def best(self, word: str) -> list[str]:
        """Pieces of the most probable segmentation; bytes as `<0xNN>`. Of equal ones, the one found first."""
        word = " " + word
        n = len(word)
        value: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        value[0] = 0.0
        step, byte_p = self.steps.get, self.byte_p
        for i in range(n):
            at = value[i]
            j = i + 1
            part = word[i]
            found, longer = step(part, NOWHERE)
            p = found[0] if found is not None else sum([byte_p[b] for b in part.encode("utf-8", "surrogatepass")])
            if value[j] is None or at + p > value[j]:
                value[j], back[j] = at + p, (i, part if found is not None else None)
            while longer and j < n:
                j += 1
                part = word[i:j]
                found, longer = step(part, NOWHERE)
                if found is not None:
                    reached = at + found[0]
                    if value[j] is None or reached > value[j]:
                        value[j], back[j] = reached, (i, part)
        out, j = [], n
        while j:
            i, piece = back[j]
            if piece is None:
                out.extend(f"<0x{b:02X}>" for b in reversed(word[i:j].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
            j = i
        return out[::-1]


def vocabulary(path: str) -> tuple[dict[str, float], list[float]]:
    """Pieces of a piece file with first log probabilities from its scores (ranks, as 1 / (rank + shift)), and the bytes'.
    The word mark becomes a space; pieces with a mark elsewhere than in front are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:]:
            continue
        ranks[piece.replace("▁", " ")] = max(0.0, -model.get_score(i))
    ranks.setdefault(" ", float(len(ranks)))
    weight = {p: 1.0 / (min(r, 1e6) + RANK_SHIFT) for p, r in ranks.items()}
    byte = 1.0 / (1e6 + RANK_SHIFT)
    total = sum(weight.values()) + 256 * byte
    return {p: math.log(w / total) for p, w in weight.items()}, [math.log(byte / total)] * 256


def _chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per chunk and distinct word: hash, word, chunk, docs (uint16 places), counts (uint32), train (tokens in
    training documents); and one per document: hash, chunk, place, id, tokens, held_out."""
    id_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("hash", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("word", T.BinaryType()),
        T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("train", T.LongType()),
        T.StructField("place", T.IntegerType()), T.StructField("id", id_type), T.StructField("tokens", T.LongType()),
        T.StructField("held_out", T.BooleanType())])
    held = F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("id"), held.alias("held_out"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        arrow = None
        digest = xxhash.xxh3_64_intdigest
        chunk = TaskContext.get().partitionId() << 30
        known: dict = {}
        tokens, ids, flags, size = [], [], [], 0

        def binary(data, starts, width):
            offsets = np.append(starts, len(data)).astype(np.int32) * width
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()),
                                                                    pa.py_buffer(data.tobytes())])

        def rows_of():
            lengths = np.array([len(t) for t in tokens], np.int64)
            train = ~np.array(flags, bool)
            n = len(tokens)
            places = pa.array(range(n), pa.int32())
            hashes = np.array([digest(f"{chunk + i}") for i in range(n)], np.uint64).view(np.int64)
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(np.full(n, chunk)), none(pa.binary()), none(pa.binary()), none(pa.binary()),
                 none(pa.int64()), places, pa.array(ids, arrow), pa.array(lengths), pa.array(flags, pa.bool_())], names=names)
            if not lengths.sum():
                return
            pair = (np.concatenate(tokens) << 16) | np.repeat(np.arange(n, dtype=np.int64), lengths)
            pair, count = np.unique(pair, return_counts=True)
            word, doc = pair >> 16, pair & 0xFFFF
            listed = list(known)
            borders = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            in_train = np.add.reduceat(count * train[doc], borders)
            m = len(borders)
            for at in range(0, m, 50_000):
                to = min(m, at + 50_000)
                lo, hi = borders[at], borders[to] if to < m else len(pair)
                start, some = borders[at:to] - lo, listed[at:to]
                none = lambda kind, k=to - at: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([digest(w) for w in some], np.uint64).view(np.int64)), pa.array(np.full(to - at, chunk)),
                     pa.array(some, pa.binary()), binary(doc[lo:hi].astype(np.uint16), start, 2),
                     binary(count[lo:hi].astype(np.uint32), start, 4), pa.array(in_train[at:to].astype(np.int64)),
                     none(pa.int32()), none(arrow), none(pa.int64()), none(pa.bool_())], names=names)

        names = [f.name for f in schema.fields]
        for batch in batches:
            arrow = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, key_, flag in zip(*(part.column(i).to_pylist() for i in range(3))):
                    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    tokens.append(np.array([known.setdefault(w, len(known)) for w in found], np.int64))
                    ids.append(key_)
                    flags.append(flag)
                    size += len(found)
                    if size >= CHUNK_TOKENS or len(tokens) >= CHUNK_DOCS:
                        yield from rows_of()
                        chunk += CHUNK_ROOM
                        known, tokens, ids, flags, size = {}, [], [], [], 0
        if tokens:
            yield from rows_of()

    return rows.mapInArrow(run, schema)


def _bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """Write a table dealt by `hash`, which later joins and groupings on `hash` read as dealt."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, "hash").write.bucketBy(buckets, "hash").format("parquet").saveAsTable(table)
    return spark.table(table)


def _piece_counts(lexicon: DataFrame, path: str) -> dict[str, float]:
    """Counts of the pieces in the best segmentations of the training words; at most the vocabulary reaches the driver."""
    def run(batches):
        import pyarrow as pa

        lattice, counts = Lattice(*vocabulary(path)), {}
        for batch in batches:
            for word, c in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for piece in lattice.best(word.decode("utf-8", "surrogatepass")):
                    counts[piece] = counts.get(piece, 0) + c
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["piece", "n"])

    table = (lexicon.where("train > 0").select("word", "train").mapInArrow(run, "piece string, n long")
             .groupBy("piece").agg(F.sum("n").alias("n"))).toArrow()
    return dict(zip(table.column("piece").to_pylist(), table.column("n").to_pylist()))


def trained(counts: dict[str, float], ends: int, path: str) -> tuple[dict[str, float], list[float], float]:
    """(pieces' log probabilities, the bytes', the end's): smoothed shares of all pieces and ends; they sum to 1."""
    pieces, _ = vocabulary(path)
    names = [f"<0x{b:02X}>" for b in range(256)]
    total = sum(counts.values()) + ends + SMOOTHING * (len(pieces) + 257)
    log_of = lambda n: math.log((n + SMOOTHING) / total)
    return {p: log_of(counts.get(p, 0)) for p in pieces}, [log_of(counts.get(b, 0)) for b in names], log_of(ends)


def _with_totals(lexicon: DataFrame, model) -> DataFrame:
    """hash, train and `total`, the natural log of the word's probability."""
    def run(batches):
        import pyarrow as pa

        lattice = Lattice(*model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([lattice.total(w.decode("utf-8", "surrogatepass")) for w in part.column(2).to_pylist()],
                              pa.float64())], names=["hash", "train", "total"])

    return lexicon.select("hash", "train", "word").mapInArrow(run, "hash long, train long, total double")


def _summed(joined: DataFrame, denominator: int) -> DataFrame:
    """(key, known, base, score) summed over the words of each document.

    A task sums what it holds and hands over one packed row per chunk; the rows of a chunk, no more than its
    documents' distinct words, are then added up in one place.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []
        size = 0

        def flush():
            key, known, base, score = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(key, return_inverse=True)
            known, base, score = (np.bincount(at, weights=v, minlength=len(keys)) for v in (known, base, score))
            chunk = keys // CHUNK_ROOM
            borders = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(keys))
            kinds = (((keys % CHUNK_ROOM).astype(np.uint16)), known.astype(np.int64), base, score)
            packed = [[v[lo:hi].tobytes() for lo, hi in zip(borders[:-1], borders[1:])] for v in kinds]
            return pa.RecordBatch.from_arrays(
                [pa.array(chunk[borders[:-1]] * CHUNK_ROOM), *[pa.array(v, pa.binary()) for v in packed]],
                names=["chunk", "place", "known", "base", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, train, total = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            docs, counts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            lengths = np.array([len(d) // 2 for d in docs])
            doc = np.frombuffer(b"".join(docs), np.uint16).astype(np.int64)
            count = np.frombuffer(b"".join(counts), np.uint32).astype(np.float64)
            held.append((np.repeat(chunk, lengths) + doc, count * np.repeat(train > 0, lengths),
                         count * np.repeat(np.log10((train + 1) / denominator), lengths),
                         count * np.repeat(total, lengths)))
            size += len(doc)
            if size >= PAIRS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add(table):
        import numpy as np
        import pyarrow as pa

        place, known, base, score = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (
            ("place", np.uint16), ("known", np.int64), ("base", np.float64), ("score", np.float64)))
        places, at = np.unique(place, return_inverse=True)
        sums = [np.bincount(at, weights=v, minlength=len(places)) for v in (known, base, score)]
        return pa.table({"key": pa.array(table.column("chunk")[0].as_py() + places.astype(np.int64)),
                         "known": pa.array(sums[0].astype(np.int64)), "base": pa.array(sums[1]), "score": pa.array(sums[2])})

    rows = joined.select("chunk", "train", "total", "docs", "counts").mapInArrow(
        run, "chunk long, place binary, known binary, base binary, score binary")
    return rows.groupBy("chunk").applyInArrow(add, "key long, known long, base double, score double")


def scored(docs: DataFrame, key: str, text: str = "text", *, path: str) -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Tokens are words with A-Z lower-cased, then one end. Rows whose crc32(key as text) modulo 7 is 2 are held out;
    a null key counts as an empty text (its remainder is 0). base_score is the add-one unigram of words. `score`
    is the subword model's: the sum over all segmentations of each word, and the end; white space itself is not
    scored. Null and empty texts hold only the end; repeated keys and rows are scored each on its own; words of
    any length and characters outside the vocabulary (by their bytes) have a probability. Without training
    documents all counts are 0 and the smoothed start stands alone. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _bucketed(_chunks(docs, text, key), buckets, "chunked_words")
    words = table.where("docs is not null")
    documents = table.where("docs is null").select("chunk", "place", "id", "tokens", "held_out")
    lexicon = checkpointed(words.groupBy("hash").agg(F.sum("train").alias("train"), F.min("word").alias("word")))
    seen = lexicon.agg(F.sum("train").alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    ends = documents.where(~F.col("held_out")).count()
    n_train, distinct = int(seen["n"] or 0) + ends, int(seen["v"]) + (ends > 0)
    denominator = n_train + distinct + 1

    pieces, byte_p, end_p = trained(_piece_counts(lexicon, path), ends, path)
    totals = _bucketed(_with_totals(lexicon, spark.sparkContext.broadcast((pieces, byte_p))), buckets, "word_totals")
    sums = _summed(words.drop("train").join(totals, "hash"), denominator)
    out = documents.withColumn("key", F.col("chunk") + F.col("place")).join(sums, "key", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    return out.select(
        F.col("id").alias(key), "held_out", (F.col("tokens") + 1).alias("n_tokens"),
        (zero("known", "long") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (zero("base", "double") + F.lit(math.log10((ends + 1) / denominator))).alias("base_score"),
        ((zero("score", "double") + F.lit(end_p)) / math.log(10)).alias("score"))

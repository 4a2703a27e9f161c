"""N-gram Jaccard join by PartEnum signatures; returns sets' sizes and the components of their links.

Sets are grouped into bands of size. Within a band, two sets that are similar enough differ in at most k elements.
The hash domain is cut into first-level partitions, so that some of them hold at most one difference, and each
of those into three parts: any two parts of the three give a signature, and similar sets share one. A set
signs for its own band and the next larger one. Pairs of sets that share a signature are bounded by parity sketches, as random
ones would chain most sets of a size together; those left open form candidate clusters, band by band: similar sets share a
signature of a band for which both sign, so chains through sets of other sizes join nothing. Signatures of many sets are not
listed pair by pair: those with the same first set form a bundle, within which sketches are compared. Every pair of a cluster is
then bounded again and, where that leaves it open, checked exactly.
"""

from __future__ import annotations

import math
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import BROADCAST_IDS, checkpointed, components, dropping_shuffles, small_side

N, PERCENT = 4, 85
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000
#: Elements (8 bytes each) of the sets in one block of a comparison; a task holds two blocks.
BLOCK_ELEMENTS = 1_500_000
#: Sets that stand for the largest component of a block when blocks of one cluster are first linked.
DELEGATES = 32
#: Bits of the fixed-size filter over candidate sets; false hits only cost space.
FILTER_BITS = 1 << 24
ROWS = 512
#: Nodes of one signature of which every pair is a candidate by itself; bins of a sketch per difference allowed; nodes of a
#: bundle in a block.
SMALL, SKETCH_BITS, BUNDLE = 16, 6, 8_192


class Bands:
    """Bands of set sizes and the partitions each needs."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.upper, self._shape = percent, [], {}
        self._next = 1

    def of(self, size: int) -> int:
        from bisect import bisect_left

        while not self.upper or self.upper[-1] < size:
            self.upper.append(max(self._next, self._next * 100 // self.percent))
            self._next = self.upper[-1] + 1
        return bisect_left(self.upper, size)

    def differences(self, both: int) -> int:
        """Most elements in which two sets with `both` elements together, if similar enough, can differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def sketch_bits(self, band: int) -> int:
        """Bins of the parity sketch of a set that signs for a band: several for each difference that two may have there."""
        self.shape(band)
        bits = 256
        while bits < SKETCH_BITS * self.differences(2 * self.upper[band]):
            bits *= 2
        return bits

    def shape(self, band: int) -> tuple[int, int, int]:
        """(k, first-level partitions, weak partitions a set may have). A partition is weak for a set if two of its
        parts are empty: the signature of two empty parts says nothing. k // 2 partitions can hold two differences
        or more; the rest, one more than the weak ones allowed, cannot."""
        if band not in self._shape:
            while len(self.upper) <= band:
                self.of(self.upper[-1] + 1 if self.upper else 1)
            k = self.differences(2 * self.upper[band])
            least = (self.upper[band - 2] + 1) if band > 1 else 1  # smallest set that signs here
            need = k // 2 + 1
            slack = 1
            for _ in range(8):
                empty = math.exp(-least / (3.0 * (need + slack)))
                weak = (need + slack) * (3 * empty * empty - 2 * empty ** 3)
                slack = max(slack, min(need + 2, math.ceil(weak + 3 * math.sqrt(weak))))
            self._shape[band] = (k, need + slack, slack)
        return self._shape[band]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of 64-bit hashes of their distinct n-word shingles."""

    def __init__(self, n: int = N):
        import numpy as np
        import xxhash

        self.n, self.known, self.digest = n, {}, xxhash.xxh3_64_intdigest
        # odd multipliers, one for each place in a shingle
        self.place = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None):
        import numpy as np

        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            raw = [known[w] for w in found]
        except KeyError:
            digest = self.digest
            for w in found:
                if w not in known:
                    known[w] = digest(w)
            raw = [known[w] for w in found]
        h = np.array(raw, np.uint64)
        width = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                total = total + h[i:len(h) - width + 1 + i] * self.place[i]
            return np.unique(_mix(total))


def set_key(elements) -> int:
    """64-bit key of a set, as a signed long; equal sets have equal keys."""
    import numpy as np

    with np.errstate(over="ignore"):
        total = np.add.reduce(_mix(elements + np.uint64(0x9E3779B97F4A7C15))) + np.uint64(len(elements))
        return int(_mix(np.array([total], np.uint64)).view(np.int64)[0])


def node_key(key: int, band: int) -> int:
    """64-bit key, as a signed long, of a set as a member of one band's clusters."""
    import numpy as np

    with np.errstate(over="ignore"):
        return int(_mix(np.array([key], np.int64).view(np.uint64) + np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def band_signatures(elements, bands: Bands, only: tuple[int, int] | None = None):
    """(band, signatures of one set as an int64 array) for its band and the next; none where only equal sets are similar.
    Bands outside ``only`` (first, last) are left out."""
    import numpy as np

    band = bands.of(len(elements))
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements))])
        top = elements >> np.uint64(32)
        for b in (band, band + 1):
            k, parts, allowed = bands.shape(b)
            if k == 0 or only and not only[0] <= b <= only[1]:
                continue
            place = (top * np.uint64(3 * parts)) >> np.uint64(32)
            border = np.searchsorted(place, np.arange(3 * parts + 1, dtype=np.uint64))
            sums = (running[border[1:]] - running[border[:-1]]).reshape(parts, 3)
            counts = np.diff(border).reshape(parts, 3)
            base = np.arange(parts, dtype=np.uint64) * np.uint64(3) + np.uint64(b << 40)
            weak = (counts == 0).sum(axis=1) >= 2
            keep_empty = weak.sum() > allowed
            out = []
            for left, (x, y) in enumerate(((1, 2), (0, 2), (0, 1))):
                sig = _mix(_mix(sums[:, x] + base + np.uint64(left)) + sums[:, y])
                if not keep_empty:
                    sig = sig[(counts[:, x] + counts[:, y]) > 0]
                out.append(sig)
            yield b, np.concatenate(out).view(np.int64)


def signatures(elements, bands: Bands):
    """Signatures of one set (int64 array) for its band and the next."""
    import numpy as np

    return np.concatenate([np.empty(0, np.int64), *[found for _, found in band_signatures(elements, bands)]])


def _signed(docs: DataFrame, text: str, n: int, percent: int, rounds: int, this: int, only: tuple[int, int] | None = None) -> DataFrame:
    """(sig, node) of every distinct set a task meets, a node for each band it signs for (within ``only``); copies within a task
    sign once. Of several rounds, each hands out one range of the signatures' hashes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles, bands, seen = Shingler(n), Bands(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sigs, nodes = [], []
                for t in batch.column(0).slice(at, ROWS).to_pylist():
                    elements = shingles(t)
                    if not len(elements):
                        continue
                    key = set_key(elements)
                    if key in seen:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    for band, found in band_signatures(elements, bands, only):
                        if rounds > 1:
                            found = found[(found.view(np.uint64) >> np.uint64(32)) * np.uint64(rounds) >> np.uint64(32) == np.uint64(this)]
                        sigs.append(found)
                        nodes.append(np.full(len(found), node_key(key, band), np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))],
                                                     names=["sig", "node"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "sig long, node long")


def _sharing(signed: DataFrame) -> DataFrame:
    """(a, b, whole): pairs of nodes that share a signature. Of a signature with up to SMALL nodes every pair, else, marked as
    `whole`, every node with the first one. Rows are sorted by signature and read once in order; no more than SMALL nodes of a
    signature are held."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(sig, node):
            """Pairs of complete signatures."""
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            group, first = np.repeat(np.arange(len(start)), size), np.repeat(start, size)
            large = size[group] > SMALL
            low, high, whole = [], [], []
            later = np.flatnonzero(large & (first < np.arange(len(sig))))
            low.append(node[first[later]]), high.append(node[later]), whole.append(np.ones(len(later), bool))
            small = np.flatnonzero((size[group] > 1) & ~large)
            for step in range(1, SMALL):
                small = small[small + step < len(sig)]
                small = small[group[small] == group[small + step]]
                if not len(small):
                    break
                low.append(node[small]), high.append(node[small + step]), whole.append(np.zeros(len(small), bool))
            return np.concatenate(low), np.concatenate(high), np.concatenate(whole)

        def batch_of(low, high, whole):
            order = np.lexsort((whole, high, low))
            low, high, whole = low[order], high[order], whole[order]
            new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (whole[1:] != whole[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (low, high, whole)], names=["a", "b", "whole"])

        held, open_ = (np.empty(0, np.int64), np.empty(0, np.int64)), None  # rows of the last signature, or it and its first node
        for batch in batches:
            sig, node = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            if not len(sig):
                continue
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]  # copies sign in several tasks
            sig, node = sig[new], node[new]
            if open_ is not None:
                more = int(np.searchsorted(sig, open_[0], side="right"))
                others = node[:more][node[:more] != open_[1]]
                if len(others):
                    yield batch_of(np.full(len(others), open_[1]), others, np.ones(len(others), bool))
                sig, node = sig[more:], node[more:]
                if not len(sig):
                    held = sig, node
                    continue
                open_ = None
            last = int(np.searchsorted(sig, sig[-1]))
            if len(sig) - last > SMALL:
                open_, last, held = (sig[-1], node[last]), len(sig), (sig[:0], node[:0])
            else:
                held = sig[last:], node[last:]
            low, high, whole = found(sig[:last], node[:last]) if last else (node[:0], node[:0], np.empty(0, bool))
            if len(low):
                yield batch_of(low, high, whole)
        if len(held[0]) > 1:
            yield batch_of(*found(*held))

    dealt = signed.repartition("sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(run, "a long, b long, whole boolean").distinct()


def _filter_bits(pairs: DataFrame) -> bytes:
    """A bitmap of fixed size over the hashes of the nodes in pairs."""
    import numpy as np

    place = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    table = (pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.shiftright(place, 5).cast("int").alias("w"), (place % 32).cast("int").alias("i"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))).toArrow()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[table.column("w").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return bitmap.tobytes()


def _listed(key: int, size: int, bands: Bands, bitmap) -> list[tuple[int, int]]:
    """(node, band) of a set for the two bands it signs for, where the filter lets it through."""
    import numpy as np

    band = bands.of(size)
    both = [(node_key(key, b), b) for b in (band, band + 1)]
    return [(x, b) for x, b in both if bitmap[x % FILTER_BITS >> 5] >> np.uint32(x % FILTER_BITS & 31) & np.uint32(1)]


def _sized(docs: DataFrame, text: str, carry: list[str], n: int) -> DataFrame:
    """Carried columns (_c0, ...), the text as _t, n and sid."""
    from pyspark.sql import types as T

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("_t"))

    def run(batches):
        import pyarrow as pa

        shingles = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingles(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                    names=[*part.schema.names, "n", "sid"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("sid", T.LongType())]))


def _rounds_of(rows: DataFrame, percent: int, rounds: int) -> list[tuple[tuple[int, int], int, int]]:
    """((first band, last band), ranges of hashes, this range) of rounds that sign about one share of all signatures each: bands
    of sizes that lie together, or a part of a band with more than a share."""
    bands, volume = Bands(percent), {}
    for r in rows.where("n > 0").groupBy("n").agg(F.count("*").alias("sets")).collect():
        for b in (bands.of(r.n), bands.of(r.n) + 1):
            k, parts, _ = bands.shape(b)
            if k:
                volume[b] = volume.get(b, 0) + 3 * parts * r.sets
    share, out, held = max(1.0, sum(volume.values()) / rounds), [], 0.0
    for b in sorted(volume):
        if volume[b] > share:
            parts = math.ceil(volume[b] / share)
            out += [((b, b), parts, i) for i in range(parts)]
            held = share
        elif out and out[-1][1] == 1 and held + volume[b] <= share:
            out[-1], held = ((out[-1][0][0], b), 1, 0), held + volume[b]
        else:
            out.append(((b, b), 1, 0))
            held = float(volume[b])
    return out


def _links_by_size(rows: DataFrame, text: str, n: int, percent: int, rounds: int) -> DataFrame:
    """`_sharing` of all signatures of `_sized` rows. A round signs for some bands and reads only sets that sign for them, so
    that a text is signed once, or twice at a border, however many rounds there are."""
    bands, parts = Bands(percent), []
    for only, ranges, this in _rounds_of(rows, percent, rounds):
        bands.shape(only[1])
        least = bands.upper[only[0] - 2] + 1 if only[0] > 1 else 1
        some = rows.where(F.col("n").between(least, bands.upper[only[1]]))
        parts.append(checkpointed(_sharing(_signed(some, text, n, percent, ranges, this, only))))
    if not parts:
        return rows.sparkSession.createDataFrame([], "a long, b long, whole boolean")
    return reduce(DataFrame.union, parts)


def _candidate_sets(rows: DataFrame, text: str, n: int, percent: int, wanted) -> DataFrame:
    """Of `_sized` rows, once per task, the sets the filter lets through; see `_described`."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles, bands, seen = Shingler(n), Bands(percent), set()
        bitmap = np.frombuffer(wanted.value, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for i, (size, key) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if key in seen:
                        continue
                    listed = _listed(key, size, bands, bitmap)
                    if not listed:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    elements = shingles(part.column(0)[i].as_py())
                    out.append((key, size, [x for x, _ in listed], [_parities(elements, bands.sketch_bits(b)).view(np.int64).tolist() for _, b in listed],
                                elements.tobytes()))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)],
                                                     names=["sid", "n", "nodes", "sketches", "elements"])

    return rows.where("n > 0").select(text, "n", "sid").mapInArrow(
        run, "sid long, n long, nodes array<long>, sketches array<array<long>>, elements binary")


def _described(docs: DataFrame, text: str, carry: list[str], n: int, percent: int, wanted) -> DataFrame:
    """Carried columns (_c0, ...), n, sid and, once per task for sets the filter lets through, their nodes in the two bands
    they sign for, a parity sketch for each, and the set itself."""
    from pyspark.sql import types as T

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("_t"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()),
                           T.StructField("nodes", T.ArrayType(T.LongType(), False)),
                           T.StructField("sketches", T.ArrayType(T.ArrayType(T.LongType(), False), False)), T.StructField("elements", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingles, bands, seen = Shingler(n), Bands(percent), set()
        bitmap = np.frombuffer(wanted.value, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, keys, nodes, sketches, sets = [], [], [], [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    elements = shingles(t)
                    sizes.append(len(elements))
                    key = set_key(elements) if len(elements) else None
                    keys.append(key)
                    here, drawn = [], []
                    if key is not None and key not in seen:
                        for x, b in _listed(key, len(elements), bands, bitmap):
                            here.append(x)
                            drawn.append(_parities(elements, bands.sketch_bits(b)).view(np.int64).tolist())
                        if here:
                            if len(seen) > REMEMBERED:
                                seen.clear()
                            seen.add(key)
                    nodes.append(here or None)
                    sketches.append(drawn or None)
                    sets.append(elements.tobytes() if here else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.list_(pa.int64()))), pa.array(sets, pa.binary())],
                    names=[*part.schema.names[:-1], "n", "sid", "nodes", "sketches", "elements"])

    return rows.mapInArrow(run, schema)


def _parities(elements, bits: int):
    """Parity of the elements in each of `bits` bins, as 64-bit words."""
    import numpy as np

    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def _sketches(sets, differences):
    """Parity of the elements in each of `bits` bins: the bins in which two sets differ are at most the elements in
    which they do."""
    import numpy as np

    typical = int(np.quantile([len(s) for s in sets], 0.75))
    bits = 256
    while bits < 16 * differences(2 * typical) and 2 * bits * len(sets) <= 1 << 29:
        bits *= 2
    out = np.empty((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        out[i] = _parities(s, bits)
    return out


def link_forest(keys, sets, labels, blocks, percent: int) -> list[tuple[int, int]]:
    """Links (key, key) that join all labels which links between the sets of different labels can join.

    Every pair of different labels (and, where two blocks are given, of different blocks) is bounded by size and
    sketch and then compared, nearest first, until one link joins them.
    """
    import numpy as np

    bands = Bands(percent)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    keys, labels, blocks = ([values[i] for i in order] for values in (keys, labels, blocks))
    size = np.array([len(s) for s in sets], np.int64)
    label = np.unique(np.array(labels, np.int64), return_inverse=True)[1]
    block = np.array(blocks, np.int64)
    across = len(set(blocks)) > 1
    sketch = _sketches(sets, bands.differences)
    most = np.searchsorted(size * percent, size * 100, side="right")  # sets from here on are too large
    found = []
    for i in range(len(sets)):
        js = np.arange(i + 1, most[i])
        js = js[label[js] != label[i]]
        if across:
            js = js[block[js] != block[i]]
        if not len(js):
            continue
        apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (100 - percent) * (size[i] + size[js])
        js, apart = js[near], apart[near]
        for j in js[np.argsort(apart, kind="stable")]:
            if label[j] == label[i]:
                continue
            at = np.searchsorted(sets[i], sets[j])
            at[at == size[i]] = size[i] - 1
            common = int((sets[i][at] == sets[j]).sum())
            if 100 * common >= percent * (size[i] + size[j] - common):
                label[label == label[j]] = label[i]
                found.append((keys[i], keys[j]))
    return found


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (task, cluster, block, label, sid, elements). Links found within each task and cluster."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.to_pydict()
        clusters: dict = {}
        for c, b, l, s, e in zip(*(table[k] for k in ("cluster", "block", "label", "sid", "elements"))):
            clusters.setdefault(c, {})[s] = (b, l, e)
        a, b = [], []
        for members in clusters.values():
            keys = list(members)
            for x, y in link_forest(keys, [np.frombuffer(members[k][2], np.uint64) for k in keys],
                                    [members[k][1] for k in keys], [members[k][0] for k in keys], percent):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _compared_in_rounds(rows: DataFrame, percent: int, rounds: int) -> DataFrame:
    """`_compared` of all tasks, written; of several rounds each has its share of the tasks, so that one share of the sets is
    shuffled at a time."""
    turn = F.pmod(F.xxhash64("task", F.lit(3)), F.lit(rounds))
    parts = [rows.where(turn == this) if rounds > 1 else rows for this in range(rounds)]
    return reduce(DataFrame.union, [checkpointed(_compared(part, percent)) for part in parts])


def _candidate_links(docs: DataFrame, text: str, n: int, percent: int, rounds: int) -> DataFrame:
    """`_sharing` of all signatures (a pair may come once a round), one range of their hashes a round; a round's shuffle is let go before the next."""
    return reduce(DataFrame.union, [checkpointed(_sharing(_signed(docs, text, n, percent, rounds, this))) for this in range(rounds)])


def _drawn(sets: DataFrame) -> DataFrame:
    """(node, n, sketch) of every node."""
    return sets.select("n", F.explode(F.arrays_zip("nodes", "sketches")).alias("_s")).select(
        F.col("_s.nodes").alias("node"), "n", F.col("_s.sketches").alias("sketch")).distinct()


def _near_enough(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and sketches leave it open whether their sets are similar."""
    left, right = (drawn.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    near = (F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(near).select("a", "b")


def _near_in_bundles(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes which such pairs join among the nodes of one bundle: those paired with the same a.
    Bundles above a block's size are dealt block against block."""
    members = checkpointed(pairs.select(F.col("a").alias("bundle"), F.explode(F.array("a", "b")).alias("node")).distinct())
    sizes = checkpointed(members.groupBy("bundle").agg(F.ceil(F.count("*") / BUNDLE).cast("int").alias("blocks")))
    packs = max(1, math.ceil(members.count() / BUNDLE))
    rows = members.join(sizes, "bundle").withColumn("block", F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks")).cast("int")).join(drawn, "node")
    one = rows.where("blocks = 1").withColumn("task", F.struct(
        F.lit(0).cast("long").alias("c"), F.pmod(F.xxhash64("bundle"), F.lit(packs)).cast("int").alias("x"), F.lit(0).alias("y")))
    more = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("task", F.struct(
        F.col("bundle").alias("c"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))).drop("other")

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        bundle, node, n, block = (table.column(c).to_numpy() for c in ("bundle", "node", "n", "block"))
        words = table.column("sketch").combine_chunks()
        ends, words = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
        order = np.lexsort((node, n, bundle))
        starts = np.flatnonzero(np.r_[True, bundle[order][1:] != bundle[order][:-1]])
        for at in np.split(order, starts[1:]):
            # nodes of a bundle sign for one band, so their sketches are of one length
            sketch = np.stack([words[ends[i]:ends[i + 1]] for i in at])
            size, label, part = n[at], np.arange(len(at)), block[at]
            most = np.searchsorted(size * percent, size * 100, side="right")
            across = part.min() != part.max()
            for i in range(len(at)):
                js = np.arange(i + 1, most[i])
                js = js[(label[js] != label[i]) & (part[js] != part[i])] if across else js[label[js] != label[i]]
                if len(js):
                    apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                    js = js[apart * (100 + percent) <= (100 - percent) * (size[i] + size[js])]
                if len(js):
                    joined, first = np.unique(label[js], return_index=True)
                    label[np.isin(label, joined)] = label[i]
                    a.append(np.full(len(first), node[at[i]]))
                    b.append(node[at[js[first]]])
        none = [np.empty(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    columns = ("task", "bundle", "node", "n", "block", "sketch")
    return one.select(*columns).unionByName(more.select(*columns)).groupBy("task").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, text: str = "text", *, n: int = N, percent: int = PERCENT, rounds: int = 1,
                       carry: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, labels). rows: the `carry` columns (default: all but the text) as _c0, _c1, ..., `n` (set size), `sid` (key
    of the set) and `rid`; labels: sid and `component` of every set that is linked with another set.

    Rows of one component are joined by a chain of links: 100 * common >= percent * union of their sets of distinct
    n-word shingles (ASCII letters lower-cased; fewer than n words: the whole sequence as one). Null texts
    and texts without words have n = 0 and a null sid: they are linked with nothing. Equal sets share a sid.
    Repeated rows stay. Sids are 64-bit keys; two different sets share a key with a chance of 2^-64 a pair.

    Exactness: similar sets share a signature (pigeonhole) of a band for which both sign, and their sketches differ in no more
    bins than they do in elements, hence they share a cluster of this band; within a cluster every pair of sets in
    different components is bounded or compared. Clusters above a block's size are compared block by block,
    blocks of one cluster in different tasks: first each alone, then delegates of all, then only pairs of
    blocks that still hold different components.

    With `rounds` about that share of the signatures is made at a time, by bands of sizes, so that the
    shuffle of signatures takes that part of the disk, and clusters are compared in that many turns; every step's shuffle is
    let go when it is written. The result does not depend on it.
    """
    with dropping_shuffles(docs.sparkSession) if rounds > 1 else nullcontext():
        return _labelled(docs, text, n, percent, rounds, carry)


def _labelled(docs: DataFrame, text: str, n: int, percent: int, rounds: int, carry: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame]:
    carry = [c for c in docs.columns if c != text] if carry is None else list(carry)
    share = docs.sparkSession.sparkContext.broadcast
    if rounds > 1:  # texts are written with their sizes first, so that every round reads only what it signs
        own = f"_c{carry.index(text)}" if text in carry else "_t"
        rows = _sized(docs, text, carry, n).withColumn("rid", F.monotonically_increasing_id())
        rows = checkpointed(rows.drop("_t") if own != "_t" else rows)
        pairs = _links_by_size(rows, own, n, percent, rounds)
        sets, rows = checkpointed(_candidate_sets(rows, own, n, percent, share(_filter_bits(pairs)))), rows.drop("_t")
    else:
        pairs = _candidate_links(docs, text, n, percent, rounds)
        described = checkpointed(_described(docs, text, carry, n, percent, share(_filter_bits(pairs))).withColumn("rid", F.monotonically_increasing_id()))
        sets, rows = described.where("elements is not null"), described.drop("nodes", "sketches", "elements")
    # pairs that their sketches keep apart join no cluster
    drawn = checkpointed(_drawn(sets))
    near = _near_enough(pairs.where("not whole").select("a", "b").distinct(), drawn, percent)
    bundled = _near_in_bundles(pairs.where("whole"), drawn, percent)
    clusters = checkpointed(components(near.unionByName(bundled)).withColumnRenamed("component", "cluster"))

    # tasks are dealt over ids and sizes; the sets themselves follow in one join
    members = checkpointed(sets.select("sid", "n", F.explode("nodes").alias("node")).distinct()
                           .join(clusters, "node").select("sid", "n", "cluster"))
    sizes = checkpointed(members.groupBy("cluster").agg(F.sum("n").alias("total")))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("total") / BLOCK_ELEMENTS).cast("int"), F.lit(1)))
    total = sizes.where("blocks = 1").agg(F.sum("total")).first()[0] or 0
    packs = max(1, 4 * math.ceil(total / BLOCK_ELEMENTS))
    dealt = checkpointed(members.drop("n").join(small_side(sizes, BROADCAST_IDS), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")))
    placed = sets.select("sid", "n", "elements").join(small_side(dealt, BROADCAST_IDS), "sid")
    alone = placed.withColumn("task", F.when(F.col("blocks") == 1, F.struct(
        F.lit(0).cast("long").alias("c"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("int").alias("x"), F.lit(0).alias("y"))
    ).otherwise(F.struct(F.col("cluster").alias("c"), F.col("block").alias("x"), F.lit(-1).alias("y"))))
    columns = ("task", "cluster", "block", "label", "sid", "elements")
    links = _compared_in_rounds(alone.withColumn("label", F.col("sid")).withColumn("block", F.lit(0)).select(*columns), percent, rounds)
    labels = checkpointed(components(links))
    if sizes.where("blocks > 1").limit(1).count():
        for delegates in (True, False):
            turns = rounds
            large = placed.where("blocks > 1").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
                "label", F.coalesce("component", "sid"))
            if delegates:
                counts = large.groupBy("cluster", "block", "label").agg(F.countDistinct("sid").alias("members"))
                main = counts.groupBy("cluster", "block").agg(F.max_by("label", F.struct("members", "label")).alias("label"),
                                                              F.max("members").alias("members"))
                some = large.join(main, ["cluster", "block", "label"]).where(
                    F.pmod(F.xxhash64("sid", F.lit(2)), F.ceil(F.col("members") / DELEGATES)) == 0)
                tasks = some.withColumn("task", F.struct(F.col("cluster").alias("c"), F.lit(-2).alias("x"), F.lit(-2).alias("y")))
            else:
                open_ = large.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
                if rounds > 1:  # a set travels once per other block of its cluster; a turn takes no more than a round of all sets
                    sent = open_.join(sizes, "cluster").agg(F.sum(F.col("total") * (F.col("blocks") - 1))).first()[0] or 0
                    turns *= math.ceil(max(sent, 1) / sizes.agg(F.sum("total")).first()[0])
                others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
                tasks = (large.join(open_, "cluster").select("*", others.alias("other")).where("other <> block")
                         .withColumn("task", F.struct(F.col("cluster").alias("c"), F.least("block", "other").alias("x"),
                                                      F.greatest("block", "other").alias("y"))))
            links = links.union(_compared_in_rounds(tasks.select(*columns), percent, turns))
            labels = checkpointed(components(links))
    return rows, labels.select(F.col("node").alias("sid"), "component")


def component_ids(docs: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """`key`, n_shingles and component_id (smallest key reachable by links, the row's own included) of every row."""
    rows, labels = jaccard_components(docs, text, carry=(key,), **how)
    found = checkpointed(rows.join(labels, "sid", "left").select("_c0", "n", F.coalesce("component", "sid").alias("group")))
    least = found.where("`group` is not null").groupBy("group").agg(F.min("_c0").alias("least"), F.count("*").alias("rows"))
    shared = checkpointed(least.where("rows > 1").select(F.col("group").alias("_g"), "least"))
    out = found.join(small_side(shared, BROADCAST_IDS), F.col("group") == F.col("_g"), "left")
    return out.select(F.col("_c0").alias(key), F.col("n").alias("n_shingles"),
                      F.coalesce("least", "_c0").alias("component_id"))


def deduplicated(docs: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """One row of each component, with all its columns: the smallest key, nulls last, then the first met. Rows without
    words all stay."""
    rows, labels = jaccard_components(docs, text, carry=tuple(docs.columns), **how)
    slim = rows.where("sid is not null").select(
        "sid", F.struct(F.col(f"_c{docs.columns.index(key)}").isNull().alias("last"),
                        F.col(f"_c{docs.columns.index(key)}").alias("key"), "rid").alias("place"))
    slim = checkpointed(slim.join(labels, "sid", "left").select(F.coalesce("component", "sid").alias("group"), "place"))
    first = (slim.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("rows")).where("rows > 1")
             .select("group", F.col("first.rid").alias("kept")))
    lost = checkpointed(slim.join(first, "group").where("place.rid <> kept").select(F.col("place.rid").alias("rid")))
    return rows.join(small_side(lost, BROADCAST_IDS), "rid", "left_anti").select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Mixing sources to target weights: word budgets per source, then pivotal rounding of fractional copies.

Every document of a source starts with the same number of copies, target over size of the source. The whole
part is taken; fractional parts meet in pairs that pass words between each other until one of the two is whole,
at random but with the expectation kept. What is left over in a bucket meets the leftovers of other buckets in a
tree of reductions, so that one fraction is left per source and its words miss the target by at most one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import BROADCAST_IDS, checkpointed, global_rank, small_side, words

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source that meet in one task, and leftovers that meet in one task of the tree.
BUCKET, FAN_IN = 4096, 64


def size_in_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sizes: one row per source (source, source_size, units). Adds weight, target and place.

    Sources in code point order, null last, take the weights in turn. Targets share all words by weight; those
    above `most` times their source's size stop there and the excess is shared by the rest, until none is above.
    Each round is one aggregate over the table of sources.
    """
    ranked = global_rank(sizes, "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    table = checkpointed(ranked.select("source", "source_size", "units", F.col("_rank").alias("place"), pick.alias("weight"),
                                       (F.col("source_size") * float(most)).alias("stop")))
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= F.col("stop")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("stop"))).alias("held"),
                        F.sum(F.when(~above, F.col("weight"))).alias("weight"),
                        F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], ((row["all"] or 0) - (row["held"] or 0.0)) / row["weight"]
    level = 0.0 if level is None else level
    return table.withColumn("target", F.least(F.col("stop"), F.lit(level) * F.col("weight"))).drop("stop", "weight")


def _uniform(key, salt: int) -> float:
    """A number in [0, 1) that depends on the key alone."""
    x = (int(key) ^ (salt * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def pivot(keys, sizes, shares, salt: int = 0) -> tuple[list, int | None, float]:
    """Round shares in [0, 1) to 0 or 1 so that the words they stand for are kept, but for one leftover.

    Returns (rounded: 0, 1 or None for the leftover, its place or None, its share). Moving `up` words from b to a
    with probability down / (up + down), else `down` words from a to b, keeps every expectation.
    """
    rounded: list = [None] * len(keys)
    held, share = None, 0.0
    for i in range(len(keys)):
        f, size = float(shares[i]), int(sizes[i])
        if f <= 0.0 or f >= 1.0 or size == 0:
            rounded[i] = int(f >= 1.0 or (f > 0.0 and _uniform(keys[i], salt + 1) < f))
            continue
        if held is None:
            held, share = i, f
            continue
        big = int(sizes[held])
        up, down = min((1 - share) * big, f * size), min(share * big, (1 - f) * size)
        if _uniform(int(keys[i]) * 31 + int(keys[held]), salt) * (up + down) < down:
            if (1 - share) * big <= f * size:
                rounded[held], held, share = 1, i, f - up / size
            else:
                rounded[i], share = 0, share + up / big
        elif share * big <= (1 - f) * size:
            rounded[held], held, share = 0, i, f + down / size
        else:
            rounded[i], share = 1, share - down / big
        if share <= 1e-12 or share >= 1 - 1e-12:
            rounded[held], held = int(share > 0.5), None
    return rounded, held, share


def _rounded(units: DataFrame, salt: int) -> DataFrame:
    """units: (place, bucket, rid, k, key, size, share). One pivotal pass per source and bucket; `up` is null for
    the leftover, whose share is what remains. Largest first: a document settles against others of its size, so
    the leftover tends to be small."""
    def run(table):
        import pyarrow as pa

        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("rid", "ascending"), ("k", "ascending")])
        up, held, share = pivot(table.column("key").to_pylist(), table.column("size").to_pylist(),
                                table.column("share").to_pylist(), salt)
        shares = [None] * len(up)
        if held is not None:
            shares[held] = share
        return (table.drop_columns(["share"]).append_column("share", pa.array(shares, pa.float64()))
                .append_column("up", pa.array(up, pa.int32())))

    return units.groupBy("place", "bucket").applyInArrow(
        run, "place long, bucket long, rid long, k int, key long, size long, share double, up int")


def copies(docs: DataFrame, text: str = "text", source: str = "source", *, weights=WEIGHTS, most: float = MOST_COPIES,
           carry: tuple[str, ...] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, units). rows: the written input as _c0, _c1, ... (the `carry` columns, default all) and rid; units: one row
    per document with rid, size, source_size, target and copies.

    Rows that agree in all columns are told apart by a running number, not by their place, and all point to one
    of them: a table dealt out in another way gives the same result. Null texts have size 0; a source of size
    0 has target 0; the null source is the last one. Documents of size 0 have nothing to pass on and are rounded
    alone. No document exceeds `most` copies. An empty table gives empty results.
    """
    carry = list(docs.columns) if carry is None else list(carry)
    every = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in sorted(docs.columns)]
    rows = checkpointed(docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{source}`").alias("source"),
        size_in_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(*every).alias("content"))
        .withColumn("rid", F.monotonically_increasing_id()))
    alike = checkpointed(rows.groupBy("content", "source", "size").agg(F.count("*").alias("m"), F.min("rid").alias("rid")))
    targets = checkpointed(source_targets(alike.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("units")), weights, most))
    per = targets.select(F.col("source").alias("_s"), "place", "source_size", "target",
                         F.ceil(F.col("units") / BUCKET).alias("buckets"))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    units = (alike.join(small_side(per), F.col("source").eqNullSafe(F.col("_s")))
             .select("rid", "size", "place", "source_size", "target", "buckets", share.alias("share"), "content",
                     F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"))
             .withColumn("key", F.xxhash64("content", "k", F.lit(seed)))
             .withColumn("whole", F.floor("share").cast("int")))
    start = units.select("place", F.pmod("key", "buckets").cast("long").alias("bucket"), "rid", "k", "key", "size",
                         (F.col("share") - F.col("whole")).alias("share"))
    levels = math.ceil(math.log(max(2, targets.agg(F.max(F.ceil(F.col("units") / BUCKET))).first()[0] or 1), FAN_IN))
    level = checkpointed(_rounded(start, seed))
    decided = level.where("up is not null")
    for depth in range(1, levels + 1):
        left = level.where("up is null").drop("up").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        level = checkpointed(_rounded(left, seed + 10 * depth))
        decided = decided.unionByName(level.where("up is not null"))
    last = level.where("up is null").withColumn("up", (F.pmod(F.xxhash64("key", F.lit(seed + 7)), F.lit(1 << 30)) / float(1 << 30)
                                                       < F.col("share")).cast("int"))
    decided = checkpointed(decided.unionByName(last).select("rid", "k", "place", "size", "up"))
    per = targets.select("place", "source_size", "target")
    out = decided.join(small_side(per), "place").withColumn("copies", F.col("up") + F.when(
        F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))).otherwise(0).cast("int"))
    return rows, out.select("rid", "k", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with its columns."""
    rows, units = copies(docs, text, source, **how)
    taken = checkpointed(units.groupBy("rid").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0"))
    again = rows.join(small_side(taken, BROADCAST_IDS), "rid").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return again.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])

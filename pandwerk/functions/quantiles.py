"""Exact linear-interpolated percentiles and ranks for groups of any size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed

# Accuracy of the sketch that brackets a percentile; a bracket holds a few rows in this many.
SKETCH_ACCURACY = 10_000


def group_percentiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """One row per group: ``by``, ``n`` and an array ``q`` of exact percentiles of ``value``.

    For groups of any size the percentiles are bracketed with a bounded sketch first, and only rows
    inside a bracket are ranked; no aggregation state holds a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return bracketed_percentiles(rows, by, probs)


def bracketed_percentiles(rows: DataFrame, by: list[str], probs: list[float],
                          accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact percentiles of ``_v`` from a sketch, a counting pass and a ranking of the brackets.

    Merged sketches may miss by more than their nominal error; a bracket that does not hold its
    rank is noticed, and the brackets are widened until all do. The result is one row per group.
    """
    margin = 4.0 / accuracy
    while True:
        picked = _ranked_brackets(rows, by, probs, accuracy, margin)
        found = picked.collect()  # groups times probabilities
        if margin > 1 or all(r["_low"] is not None and r["_high"] is not None for r in found):
            break
        margin *= 8
    frame = rows.sparkSession.createDataFrame(found, picked.schema)
    part = F.col("_pos") - F.floor("_pos")
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * part
    return frame.withColumn("_q", quantile).groupBy(*by, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))


def _ranked_brackets(rows: DataFrame, by: list[str], probs: list[float], accuracy: int, margin: float) -> DataFrame:
    """Per group and probability the two order statistics around its position, NULL if missed."""
    ends = []
    for p in probs:
        ends += [max(p - margin, 0.0), min(p + margin, 1.0)]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_ends"))

    def bracket(i, p):
        lo = F.col("_min") if p - margin <= 0 else F.col("_ends")[2 * i]
        hi = F.col("_max") if p + margin >= 1 else F.col("_ends")[2 * i + 1]
        return F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"))

    sketch = sketch.select(*by, "n", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("_b"))
    tagged = _join_on(rows, sketch, by)
    below = [F.count_if(F.col("_v") < F.col("_b")[i]["lo"]).alias(f"_below{i}") for i in range(len(probs))]
    counted = tagged.groupBy(*by).agg(F.first("n").alias("n"), *below)
    inside = (tagged.select(*by, "_v", F.explode(F.filter("_b", lambda b: (F.col("_v") >= b["lo"])
                                                          & (F.col("_v") <= b["hi"]))["i"]).alias("_i"))
              .groupBy(*by, "_i", "_v").agg(F.count("*").alias("_c")))
    order = Window.partitionBy(*by, "_i").orderBy("_v")
    ranked = _join_on(inside, counted, by).withColumn("_cum", F.sum("_c").over(order))
    offset = F.array(*[F.col(f"_below{i}") for i in range(len(probs))])[F.col("_i")]
    p_of = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    ranked = (ranked.withColumn("_pos", (F.col("n") - 1) * p_of)
              .withColumn("_upto", F.col("_cum") + offset).withColumn("_from", F.col("_upto") - F.col("_c")))
    # a rank is held when the bracket starts at or before it and ends after it
    starts = F.min("_from") <= F.floor("_pos")
    picked = ranked.groupBy(*by, "_i", "n", "_pos").agg(
        F.when(starts, F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v")))).alias("_low"),
        F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v"))).alias("_high"))
    return picked


def column_percentiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = SKETCH_ACCURACY) -> dict[str, list[float]]:
    """Exact percentiles of the values of several columns, by column; a column without values is left out.

    As `bracketed_percentiles`, with the columns side by side: a batch is sorted column by column, and only how many values lie
    below a bracket and the counted values inside are shuffled.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    margin = 4.0 / accuracy
    while columns:
        numbers, found = _column_brackets(rows, len(columns), probs, accuracy, margin)
        missed = [1 for at in numbers for i in range(len(probs)) if None in found.get((at, i), (None, None))]
        if margin > 1 or not missed:
            break
        margin *= 8
    out = {}
    for at, n in numbers.items() if columns else ():
        out[columns[at]] = []
        for i, p in enumerate(probs):
            low, high = found[at, i]
            place = (n - 1) * p
            out[columns[at]].append(low + (high - low) * (place - math.floor(place)))
    return out


def _column_brackets(rows: DataFrame, width: int, probs: list[float], accuracy: int, margin: float) -> tuple[dict, dict]:
    """Number of values by column, and by (column, probability) the two order statistics around its position, None if missed."""
    ends = F.array(*[F.lit(e) for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))])
    sketch = rows.agg(*[a.alias(f"{name}{i}") for i in range(width) for name, a in (
        ("n", F.count(f"_{i}")), ("min", F.min(f"_{i}")), ("max", F.max(f"_{i}")), ("ends", F.percentile_approx(f"_{i}", ends, accuracy)))]).first()
    numbers = {at: sketch[f"n{at}"] for at in range(width) if sketch[f"n{at}"]}
    brackets = {at: ([sketch[f"min{at}"] if p - margin <= 0 else sketch[f"ends{at}"][2 * i] for i, p in enumerate(probs)],
                     [sketch[f"max{at}"] if p + margin >= 1 else sketch[f"ends{at}"][2 * i + 1] for i, p in enumerate(probs)]) for at in numbers}

    def count(batches):
        for batch in batches:
            for at, (low, high) in brackets.items():
                values = np.sort(batch.column(at).drop_null().to_numpy(zero_copy_only=False))
                first, last = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
                places, held, counts = [np.arange(len(low))], [np.full(len(low), np.nan)], [first]
                for i in range(len(low)):
                    different, n = np.unique(values[first[i]:last[i]], return_counts=True)
                    places.append(np.full(len(n), i)), held.append(different), counts.append(n)
                place = np.concatenate(places)
                below = np.arange(len(place)) < len(low)  # values below a bracket have no value here
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array(np.full(len(place), at), pa.int32()), "i": pa.array(place, pa.int32()),
                    "v": pa.array(np.concatenate(held), pa.float64(), mask=below), "c": pa.array(np.concatenate(counts), pa.int64())})

    counted = rows.mapInArrow(count, "at int, i int, v double, c long").groupBy("at", "i", "v").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("at", "i").orderBy(F.col("v").asc_nulls_first()))
    n = F.array(*[F.lit(numbers.get(at, 0)) for at in range(width)])[F.col("at")]
    ranked = counted.withColumn("upto", upto).where("v is not null").withColumn(
        "pos", (n - 1) * F.array(*[F.lit(float(p)) for p in probs])[F.col("i")])
    # a rank is held when the bracket starts at or before it and ends after it
    picked = ranked.groupBy("at", "i", "pos").agg(
        F.when(F.min(F.col("upto") - F.col("c")) <= F.floor("pos"), F.min(F.when(F.col("upto") > F.floor("pos"), F.col("v")))).alias("low"),
        F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("v"))).alias("high"))
    return numbers, {(r["at"], r["i"]): (r["low"], r["high"]) for r in picked.collect()}


def _join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(F.broadcast(right))


def average_ranks(df: DataFrame, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """One row per distinct (group, value): its number of rows ``n`` and average rank ``rank`` among the group's rows.

    Values are counted first. The counted values of all groups are dealt by range of (group, value) and sorted; a rank is the
    count up to a value within its range plus the group's counts in earlier ranges. No task holds a group, and no row is
    compared with the borders of ranges.
    """
    return _ranked_counts(df, by, value, {"n": F.count("*")}, ranges).withColumnRenamed("_rank_n", "rank")


def _ranked_counts(df: DataFrame, by: list[str], value: str, counts: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Per (group, value) several counts of its rows, and ``_rank_<count>``: the average rank among the rows each counts."""
    counted = df.groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
    keys = [*by, value]
    dealt = counted.repartitionByRange(ranges, *keys) if ranges else counted.repartitionByRange(*keys)
    placed = checkpointed(dealt.withColumn("_range", F.spark_partition_id()))
    # one row per group and range that holds some of it: ranges plus groups, at most
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_total_{n}") for n in counts]).select(
        *by, "_range", *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in counts])
    within = Window.partitionBy("_range", *by).orderBy(value)
    joined = placed.join(before, [*by, "_range"])
    return joined.select(*keys, *counts, *[
        (F.sum(n).over(within) + F.col(f"_before_{n}") - (F.col(n) - 1) / 2).alias(f"_rank_{n}") for n in counts])


#: A (group, value) that a share of 1 / HEAVY of all rows holds is looked up by broadcast; there are at most HEAVY of them.
HEAVY = 1_000


def with_average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with the ``rank`` of their value. Values that very many rows hold do not travel: their ranks are broadcast to
    the rows, all others are joined by (group, value)."""
    return _looked_up(df, checkpointed(average_ranks(df, by, value)), [*by, value], "rank")


def with_shared_ranks(df: DataFrame, by: list[str], value: str, shared: str, k: int) -> DataFrame:
    """Rows with an array ``ranks``: the average rank of their value among the group's rows that belong to each of ``k``
    sets, NULL in sets the row is not in. ``shared`` is an array of ``k`` booleans, the sets a row belongs to.

    Values are counted and dealt once for all sets.
    """
    sets = range(k)
    counts = {"n": F.count("*")} | {f"n{i}": F.count_if(F.col(shared)[i]) for i in sets}
    ranks = _ranked_counts(df, by, value, counts).select(*by, value, "n", F.array(*[F.col(f"_rank_n{i}") for i in sets]).alias("ranks"))
    found = _looked_up(df, checkpointed(ranks), [*by, value], "ranks")
    return found.withColumn("ranks", F.array(*[F.when(F.col(shared)[i], F.col("ranks")[i]) for i in sets]))


def _looked_up(df: DataFrame, ranks: DataFrame, keys: list[str], name: str) -> DataFrame:
    total = ranks.agg(F.sum("n")).first()[0] or 0
    slim = ranks.select(*keys, name, (F.col("n") * HEAVY >= total).alias("_heavy"))
    heavy = F.broadcast(slim.where("_heavy").select(*keys, F.col(name).alias("_known")))
    marked = df.join(heavy, keys, "left")
    often = marked.where("_known is not null").withColumnRenamed("_known", name)
    seldom = marked.where("_known is null").drop("_known").join(slim.where("not _heavy").drop("_heavy"), keys)
    return often.unionByName(seldom)


def smallest_per_group(df: DataFrame, by: list[str], hash_text: Column, tie: str, take: DataFrame) -> DataFrame:
    """Per group, the key ``(hash, tie)`` below or at which exactly ``take`` rows lie.

    ``take`` holds ``by`` and ``k``. The hash text is hexadecimal, so its first four digits
    split each group into even buckets; only the bucket holding the k-th row is ordered.
    """
    keyed = df.select(*by, hash_text.alias("_h"), F.col(tie).alias("_t")).withColumn(
        "_b", F.substring("_h", 1, 4))
    buckets = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    cum = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b"))
    hit = (buckets.withColumn("_cum", cum).join(take, by)
           .where((F.col("_cum") >= F.col("k")) & (F.col("_cum") - F.col("_c") < F.col("k")))
           .select(*by, "_b", (F.col("k") - (F.col("_cum") - F.col("_c"))).alias("_nth")))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", "_t"))
    return (keyed.join(hit, [*by, "_b"]).withColumn("_rn", rank).where("_rn = _nth")
            .select(*by, F.col("_h").alias("cut_hash"), F.col("_t").alias("cut_id")))

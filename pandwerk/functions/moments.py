"""Pairwise-complete second moments of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pandwerk.functions.scalar import nan_to_null

_SCHEMA = "g int, i int, j int, n double, mx double, my double, sxx double, syy double, sxy double"


def centred_block(x: np.ndarray) -> np.ndarray:
    """Counts, means and centred sums ``(n, mx, my, sxx, syy, sxy)`` of every pair of columns.

    Each pair is centred on the means of the rows it shares, so the sums do not depend on where
    the values lie or on which rows miss another column.
    """
    present = ~np.isnan(x)
    mask, filled = present.astype(float), np.nan_to_num(x)
    k = x.shape[1]
    n = mask.T @ mask
    out = np.zeros((6, k, k))
    out[0] = n
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, (filled.T @ mask) / n, 0.0)
    for i in range(k):
        both = mask[:, [i]] * mask
        # second pass over the shared rows: takes off what rounding left in the mean
        mean_i = mean[i] + np.divide(((filled[:, [i]] - mean[i]) * both).sum(axis=0), n[i], out=np.zeros(k), where=n[i] > 0)
        mean_j = mean[:, i] + np.divide(((filled - mean[:, i]) * both).sum(axis=0), n[i], out=np.zeros(k), where=n[i] > 0)
        dx, dy = (filled[:, [i]] - mean_i) * both, (filled - mean_j) * both
        out[1, i], out[2, i] = mean_i, mean_j
        out[3, i], out[4, i], out[5, i] = (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)
    return out


def merged_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The block of both row sets together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, cross = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * cross,
                     a[4] + b[4] + dy * dy * cross, a[5] + b[5] + dx * dy * cross])


def pairwise_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(i, j, n, mx, my, sxx, syy, sxy)``: means and centred sums where both columns are present."""
    return grouped_moments(df, [columns]).drop("g")


def grouped_moments(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """`pairwise_moments` within each of several lists of columns, which may overlap, from one scan; ``g`` is the list.

    Each task merges its Arrow batches to one k-by-k block a list, so only blocks are shuffled; blocks of
    tasks are merged by the same rule.
    """
    columns = list(dict.fromkeys(c for group in groups for c in group))
    numeric = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    places = [[columns.index(c) for c in group] for group in groups]

    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: list = [None] * len(places)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            for g, at in enumerate(places):
                block = centred_block(x[:, at])
                totals[g] = block if totals[g] is None else merged_blocks(totals[g], block)
        for g, total in enumerate(totals):
            if total is not None:
                k = len(places[g])
                i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
                yield pd.DataFrame({"g": g, "i": i.ravel(), "j": j.ravel(), **{
                    name: total[m].ravel() for m, name in enumerate(("n", "mx", "my", "sxx", "syy", "sxy"))}})

    blocks = numeric.mapInPandas(reduce_partition, schema=_SCHEMA)
    # a pair has one block per task
    pair = Window.partitionBy("g", "i", "j")
    rows = F.sum("n").over(pair)
    centre = lambda c: F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), rows), F.lit(0.0))
    spread = blocks.withColumns({"_mx": centre("mx"), "_my": centre("my")})
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    return spread.groupBy("g", "i", "j").agg(
        F.sum("n").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"),
        F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"))


def correlation_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(feature_a, feature_b, n, corr)`` for all ordered pairs; NULL where undefined."""
    return grouped_correlation(df, [columns]).drop("g")


def grouped_correlation(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """`correlation_long` within each list of columns, from one scan; ``g`` is the list."""
    names = F.array(*[F.array(*[F.lit(c) for c in group]) for group in groups])
    # a constant column leaves rounding noise of its mean only
    varies = lambda s, m: F.col(s) > F.col("n") * F.col(m) * F.col(m) * 1e-26
    return grouped_moments(df, groups).select(
        "g", F.get(names[F.col("g")], F.col("i")).alias("feature_a"), F.get(names[F.col("g")], F.col("j")).alias("feature_b"),
        F.col("n").cast("bigint").alias("n"),
        F.when(varies("sxx", "mx") & varies("syy", "my"), F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy")).alias("corr"))

"""Feature statistics and selection."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pandwerk.functions.lineage import checkpointed
from pandwerk.functions.moments import correlation_long, grouped_correlation, pairwise_moments
from pandwerk.functions.quantiles import column_percentiles, with_shared_ranks
from pandwerk.functions.scalar import nan_to_null
from pandwerk.operators.clean import complete_rows, numeric_columns

MI_BINS = 10


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every ordered pair of columns over rows where both are present."""
    return correlation_long(df, columns)


def _presence_classes(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Columns that are present in exactly the same rows, found from pair counts."""
    counts = {(r.i, r.j): r.n for r in pairwise_moments(df, columns).select("i", "j", "n").collect()}
    classes: list[list[int]] = []
    for i in range(len(columns)):
        for cls in classes:
            j = cls[0]
            if counts[i, i] == counts[j, j] == counts[i, j]:
                cls.append(i)
                break
        else:
            classes.append([i])
    return [[columns[i] for i in cls] for cls in classes]


def spearman(df: DataFrame, columns: list[str], key: str = "bag_id") -> DataFrame:
    """Rank correlation of every ordered pair; ranks are taken over the rows a pair shares.

    Columns with the same missing rows share one ranking, so the number of rankings follows the number of distinct
    missing patterns, not the number of pairs. A row travels once per column; the rankings of a column beside each pattern
    come from one count of its values by pattern.
    """
    clean = checkpointed(df.select(key, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns]))
    classes = _presence_classes(clean, columns)
    present = F.array(*[F.col(cls[0]).isNotNull() for cls in classes])
    entries = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("feature"), F.col(c).alias("value"))) for i, c in enumerate(columns)])
    long = clean.select(key, present.alias("present"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(key, "present", "e.*")
    ranked = with_shared_ranks(long, ["feature"], "value", "present", len(classes)).select(key, "feature", "ranks")
    # dealt by key once, for both steps of the pivot
    wide = checkpointed(ranked.repartition(key).groupBy(key).pivot("feature", list(range(len(columns)))).agg(
        *[F.max(F.col("ranks")[k]).alias(f"beside_{k}") for k in range(len(classes))]))
    at = {c: i for i, c in enumerate(columns)}
    cases = []
    for a, b in itertools.combinations_with_replacement(range(len(classes)), 2):
        other = {c: b for c in classes[a]} | {c: a for c in classes[b]}
        cases.append(({c: f"{at[c]}_beside_{k}" for c, k in other.items()}, classes[a], classes[b]))
    own = F.create_map(*[F.lit(x) for n, c in {n: c for case, _, _ in cases for c, n in case.items()}.items() for x in (n, c)])
    part = F.create_map(*[F.lit(x) for k, columns_ in enumerate(classes) for c in columns_ for x in (c, k)])
    # of two patterns together, only pairs across them
    across = F.array(*[F.lit(left is not right) for _, left, right in cases])
    corr = grouped_correlation(wide, [list(case.values()) for case, _, _ in cases]).select(
        "g", own[F.col("feature_a")].alias("feature_a"), own[F.col("feature_b")].alias("feature_b"), "n", "corr")
    return corr.where(~across[F.col("g")] | (part[F.col("feature_a")] != part[F.col("feature_b")])).drop("g")


def label_correlation(corr: DataFrame, label: str) -> DataFrame:
    """Features by correlation to the label, strongest positive first."""
    return (corr.where((F.col("feature_a") == label) & (F.col("feature_b") != label))
            .select(F.col("feature_b").alias("feature"), "corr").orderBy(F.desc_nulls_last("corr"), "feature"))


def corr_matrix(corr: DataFrame, columns: list[str]) -> np.ndarray:
    """k-by-k matrix on the driver, k being the number of features."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.full((len(columns), len(columns)), np.nan)
    for r in corr.collect():
        if r.feature_a in at and r.feature_b in at and r["corr"] is not None:
            out[at[r.feature_a], at[r.feature_b]] = r["corr"]
    return out


#: Share of a column's variance that others must leave over for it to count as independent of them, and the least
#: standardised weight with which a column takes part in a dependency.
INDEPENDENT, TAKES_PART = 1e-10, 1e-6


def independent_columns(corr: np.ndarray) -> tuple[list[int], set[int]]:
    """(a largest set of independent columns, all columns that take part in a dependency) of a correlation matrix.

    Pivoted Cholesky: the column with most variance left over is taken next, until none has any. A column left out is
    a combination of those taken; it and all that weigh in it depend on each other.
    """
    k = len(corr)
    left, taken, factor = np.diag(corr).copy(), [], np.zeros((k, 0))
    while len(taken) < k:
        open_ = [j for j in range(k) if j not in taken]
        p = max(open_, key=lambda j: left[j])
        if not left[p] > INDEPENDENT:
            break
        column = (corr[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        factor = np.column_stack([factor, column])
        left = left - column**2
        taken.append(p)
    dependent: set[int] = set()
    for j in set(range(k)) - set(taken):
        weights = np.linalg.solve(corr[np.ix_(taken, taken)], corr[taken, j]) if taken else np.empty(0)
        dependent |= {j} | {t for t, v in zip(taken, weights) if abs(v) > TAKES_PART}
    return taken, dependent


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors with intercept over complete rows, largest first.

    Sums are taken on the executors; the driver factorises a matrix of the number of features. A column that others
    determine has an infinite factor, as has the intercept beside a constant column; every other factor is taken
    against an independent set of the rest. The intercept's factor comes from the uncentred second moments.
    """
    rows = complete_rows(df.select(*columns))
    k = len(columns)
    n, cross, mean = 0.0, np.zeros((k, k)), np.zeros(k)
    for r in pairwise_moments(rows, columns).collect():
        n, cross[r.i, r.j], mean[r.i] = r.n, r.sxy, r.mx
    scale = np.sqrt(np.diag(cross))
    constant = scale <= np.abs(mean) * np.sqrt(n) * 1e-13
    scale[constant] = 1.0
    corr = cross / np.outer(scale, scale)
    corr[constant], corr[:, constant] = 0.0, 0.0
    taken, dependent = independent_columns(corr)
    inverse = np.linalg.inv(corr[np.ix_(taken, taken)])
    own = dict(zip(taken, np.diag(inverse)))
    far = (mean / scale)[taken]
    intercept = np.inf if constant.any() else 1.0 + n * far @ inverse @ far
    values = [(c, float("inf") if j in dependent else float(own[j])) for j, c in enumerate(columns)] + [("intercept", float(intercept))]
    out = df.sparkSession.createDataFrame(values, "variables string, VIF double")
    return out.orderBy(F.desc("VIF"), "variables")


def f_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F statistic of a univariate linear regression of the label on each feature."""
    corr = correlation_long(df, [*features, label]).where(
        (F.col("feature_b") == label) & (F.col("feature_a") != label))
    r2 = F.col("corr") * F.col("corr")
    return corr.select(F.col("feature_a").alias("feature"),
                       (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("score"))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = MI_BINS) -> DataFrame:
    """Plug-in mutual information (nats) between quantile-binned features and the label.

    Deterministic stand-in for a nearest-neighbour estimate. Only counts per
    (feature, bin, label value) are shuffled.
    """
    rows = checkpointed(df.select(*dict.fromkeys([label, *features])))
    joint = _binned_counts(rows, features, label, column_percentiles(rows, features, [i / bins for i in range(1, bins)]))
    total = F.sum("c").over(Window.partitionBy("feature"))
    by_bin = F.sum("c").over(Window.partitionBy("feature", "bin"))
    by_label = F.sum("c").over(Window.partitionBy("feature", label))
    shared = joint.withColumns({"n": total, "cx": by_bin, "cy": by_label})
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    return shared.groupBy("feature").agg(F.sum(term).alias("score"))


def _binned_counts(df: DataFrame, features: list[str], label: str, cuts: dict[str, list[float]]) -> DataFrame:
    """Rows ``(feature, bin, label, c)``: a value's bin is the number of cuts below it, 0 for a missing one.

    Batches are binned and counted column by column; features without cuts are left out.
    """
    known = [f for f in features if f in cuts]
    edges = [np.array(cuts[f], dtype=float) for f in known]
    laid = df.select(F.col(label).alias("_label"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(known)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("_label").dictionary_encode()
            missing = len(labels.dictionary)
            at = labels.indices.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, ends in enumerate(edges):
                place = np.searchsorted(ends, batch.column(f"_{i}").fill_null(-np.inf).to_numpy(zero_copy_only=False), side="left")
                codes, n = np.unique(place * (missing + 1) + at, return_counts=True)
                place, of = codes // (missing + 1), codes % (missing + 1)
                yield pa.RecordBatch.from_pydict({
                    "place": pa.array(np.full(len(codes), i), pa.int32()), "bin": pa.array(place, pa.int32()),
                    "label": labels.dictionary.take(pa.array(of, pa.int32(), mask=of == missing)), "c": pa.array(n, pa.int64())})

    counts = laid.mapInArrow(count, f"place int, bin int, label {df.schema[label].dataType.simpleString()}, c long")
    names = F.array(*[F.lit(f) for f in known])
    return counts.groupBy(names[F.col("place")].alias("feature"), "bin", F.col("label").alias(label)).agg(F.sum("c").alias("c"))


SCORES = {"f_regression": f_scores, "mutual_info_regression": mutual_information}


def k_best(df: DataFrame, features: list[str], label: str, score: str, k: int = 10) -> DataFrame:
    """The ``k`` numeric features with the highest score over complete rows."""
    rows = complete_rows(df)
    numeric = [c for c in numeric_columns(df) if c in features]
    return SCORES[score](rows, numeric, label).orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def normalised_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F and mutual-information scores of chosen features, each divided by its maximum."""
    rows = checkpointed(complete_rows(df))
    f, mi = f_scores(rows, features, label), mutual_information(rows, features, label)
    both = f.withColumnRenamed("score", "f").join(mi.withColumnRenamed("score", "mi"), "feature")
    # one row per feature
    everything = Window.partitionBy()
    return both.select("feature", (F.col("f") / F.max("f").over(everything)).alias("f_score"),
                       (F.col("mi") / F.max("mi").over(everything)).alias("mi_score"))


def fold_one_hot(name: str) -> str:
    return name.split("_x0_")[0]


def k_most_important(weights: DataFrame, k: int = 10) -> list[str]:
    """Source columns of the ``k`` heaviest model inputs; rows are ``(feature, weight)``."""
    top = weights.orderBy(F.desc("weight"), F.desc("feature")).limit(k).collect()
    return list(dict.fromkeys(fold_one_hot(r.feature) for r in top))


def ward_clusters(corr: np.ndarray, features: list[str], cut: float) -> dict[str, int]:
    """Groups of correlated features: Ward linkage on 1 - |r|, merged below ``cut``.

    Cluster 0 holds nothing; a feature alone in its cluster is uncorrelated. The input is a
    matrix of the number of features.
    """
    dist = 1.0 - np.abs(np.nan_to_num(corr))
    np.fill_diagonal(dist, np.inf)
    members = {i: [i] for i in range(len(features))}
    while len(members) > 1:
        alive = sorted(members)
        sub = dist[np.ix_(alive, alive)]
        a, b = np.unravel_index(int(np.argmin(sub)), sub.shape)
        if sub[a, b] >= cut:
            break
        i, j = alive[min(a, b)], alive[max(a, b)]
        ni, nj, dij = len(members[i]), len(members[j]), dist[i, j]
        for m in alive:
            if m in (i, j):
                continue
            nm = len(members[m])
            square = ((ni + nm) * dist[i, m] ** 2 + (nj + nm) * dist[j, m] ** 2 - nm * dij**2) / (ni + nj + nm)
            dist[i, m] = dist[m, i] = np.sqrt(max(square, 0.0))
        members[i] += members.pop(j)
    out = {}
    for number, rows in enumerate(sorted(members.values(), key=min), start=1):
        out.update({features[r]: number for r in rows})
    return out


def feature_clusters(df: DataFrame, features: list[str], label: str, cut: float = 0.4) -> DataFrame:
    """Rows ``(feature, cluster, size, corr)``: cluster and absolute correlation to the label."""
    corr = correlation_long(df, [*features, label])
    rows = corr.collect()  # (k+1)^2 numbers
    frame = df.sparkSession.createDataFrame(rows, corr.schema)
    clusters = ward_clusters(corr_matrix(frame, features), features, cut)
    sizes = {c: list(clusters.values()).count(c) for c in clusters.values()}
    assigned = df.sparkSession.createDataFrame(
        [(f, c, sizes[c]) for f, c in clusters.items()], "feature string, cluster int, size int")
    to_label = label_correlation(frame, label).select("feature", F.abs("corr").alias("corr"))
    return assigned.join(to_label, "feature")


def uncorrelated_features(clusters: DataFrame) -> DataFrame:
    """The feature closest to the label in every cluster, ties kept."""
    place = F.rank().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("corr")))
    return clusters.withColumn("_p", place).where("_p = 1").drop("_p")


def feature_subsets(df: DataFrame, features: list[str], label: str, text_columns: tuple, importances: dict[str, DataFrame],
                    k: int = 10, cut: float = 0.4) -> dict[str, list[str]]:
    """Named feature lists for re-training: best by score, by each model, and uncorrelated."""
    numeric = [c for c in numeric_columns(df) if c in features]
    best = [r.feature for r in k_best(df, features, label, "mutual_info_regression", k).collect()]
    out = {"kbest": best}
    for algorithm, weights in importances.items():
        out[f"important_{algorithm}"] = k_most_important(weights, k)
    alone = [r.feature for r in uncorrelated_features(feature_clusters(df, numeric, label, cut)).collect()]
    chosen = df.select(label, *alone)
    best_alone = [r.feature for r in k_best(chosen, alone, label, "mutual_info_regression", k).collect()]
    out["kbest_uncorrelated"] = [c for c in text_columns if c != "bag_function"] + best_alone
    return out


def first_rows(df: DataFrame, n: int, by: str = "data_source", order: str = "bag_id") -> DataFrame:
    """First ``n`` rows per source in id order; Spark cuts each partition before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(
        F.col("_rn") <= n).drop("_rn")

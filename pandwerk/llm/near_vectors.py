"""Near-duplicate vectors by sorted projection passes.

In every pass vectors of one label are ordered by the concatenated signs of random projections; close vectors agree in
a long prefix and come to lie near each other. Each is compared exactly with the vectors of its window, and the links
of all passes are united. Within the components found, all pairs are then counted block by block, so that the
number of links misses none inside a component however many vectors share it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed, components, global_rank

THRESHOLD = 0.98
#: Ranks compared together, and ranks of the next window that join them.
WINDOW, OVERLAP = 512, 128
#: Sign bits concatenated into one sort key.
BITS = 48
#: Accepted chance that a pair right at the threshold meets in no pass.
MISS = 1e-5
#: Vectors in one block of a comparison inside a component; a task holds two blocks.
BLOCK = 2048


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has met with a chance of 1 - miss, by one rule for all sizes.

    A bit separates the pair with the chance angle / pi; they meet if they agree in the bits that cut `rows`
    vectors down to half a window, with two bits to spare for unbalanced projections.
    """
    bits = max(1.0, math.log2(max(2, rows) / (window / 2)) + 2)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(miss) / math.log(1 - meet)))


def usable(vector: Column, label: Column) -> Column:
    """Label and vector not null, vector not empty, without null or non-finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(table, column: str = "vector"):
    """Rows of a list column as unit vectors in double precision, by dimension: (dimension, row numbers, matrix)."""
    import numpy as np

    lists = table.column(column).combine_chunks() if hasattr(table.column(column), "combine_chunks") else table.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = flat[(starts[rows][:, None] + np.arange(d))]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
        yield int(d), rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """(pass, label, dim, sort, gid): one sort key for each vector and pass."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        planes: dict = {}
        place = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            gid, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for d, rows, x in _unit(batch):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((passes, d, BITS))
                labels = label.take(pa.array(rows))
                for p in range(passes):
                    sort = ((x @ planes[d][p] >= 0) * place).sum(axis=1)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), labels, pa.array(np.full(n, d, np.int32)), pa.array(sort),
                         pa.array(gid[rows])], names=["pass", "label", "dim", "sort", "gid"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("gid", "label", "vector").mapInArrow(run, f"pass int, label {kind}, dim int, sort long, gid long")


def _adjacent(x, labels, threshold: float):
    """Boolean matrix of links among unit vectors of equal label, none with itself."""
    import numpy as np

    found = x @ x.T >= threshold
    found &= labels[:, None] == labels[None, :]
    np.fill_diagonal(found, False)
    return found


def _window_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links found in each window, reduced to one row per vector that has any: (a, b)."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        gids, out = table.column("gid").to_numpy(), []
        codes = np.unique(table.column("code").to_numpy(), return_inverse=True)[1]
        for _, at, x in _unit(table):
            ids, found = gids[at], _adjacent(x, codes[at], threshold)
            least = np.where(found.any(axis=1), ids, np.iinfo(np.int64).max)
            while True:  # the smallest id of each connected part of the window
                near = np.where(found, least[None, :], np.iinfo(np.int64).max).min(axis=1)
                new = np.minimum(least, near)
                if (new == least).all():
                    break
                least = new
            linked = found.any(axis=1) & (least != ids)
            out.append(np.stack([ids[linked], least[linked]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.groupBy("block").applyInArrow(run, "a long, b long")


def _counted(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: (task, component, side, gid, weight, vector). (gid, links): weights of the linked vectors in the task."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        gids, weights = table.column("gid").to_numpy(), table.column("weight").to_numpy().astype(np.float64)
        component, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        out_ids, out_sums = [], []
        for _, at, x in _unit(table):
            order = np.lexsort((side[at], component[at]))
            at, x = at[order], x[order]
            borders = np.flatnonzero(np.concatenate([[True], component[at][1:] != component[at][:-1], [True]]))
            for lo, hi in zip(borders[:-1], borders[1:]):
                some = at[lo:hi]
                found = x[lo:hi] @ x[lo:hi].T >= threshold
                np.fill_diagonal(found, False)
                if side[some].max() != side[some].min():  # two blocks: pairs inside either are counted elsewhere
                    found &= side[some][:, None] != side[some][None, :]
                out_ids.append(gids[some])
                out_sums.append(found @ weights[some])
        return pa.table({"gid": pa.array(np.concatenate(out_ids)), "links": pa.array(np.concatenate(out_sums).astype(np.int64))})

    return rows.groupBy("task").applyInArrow(run, "gid long, links long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *,
                    threshold: float = THRESHOLD, seed: int = 7) -> DataFrame:
    """`key`, n_links, component_id and kept for every row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least the
    threshold. Rows that `usable` leaves out, and vectors of different dimension, link with nothing. Equal vectors
    of one label are compared once, with their number as weight, and link with each other. component_id is the
    smallest key reachable by links, the row's own included (null keys are passed over; a row with a null key and no
    other has a null component); kept: key = component_id, false for a null key. Repeated rows count as
    vectors of their own. An empty table gives an empty result.
    """
    ok = usable(F.col(f"`{vector}`"), F.col(f"`{label}`"))
    rows = checkpointed(table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"),
                                     F.when(ok, F.col(f"`{vector}`")).alias("vector"))
                        .withColumn("gid", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))))
    vectors = checkpointed(rows.where("gid is not null").groupBy("gid").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"),
        F.min("id").alias("id")))
    passes = passes_for(vectors.count(), threshold)
    ranked = global_rank(_keys(vectors, passes, seed), "pass", "label", "dim", "sort", "gid")
    block = F.floor(F.col("_rank") / WINDOW).cast("long")
    inside = ranked.select("gid", F.hash("label").alias("code"), F.when(
        (F.col("_rank") % WINDOW < OVERLAP) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block)).alias("blocks"))
    # vectors travel once to their ranks, then to the windows
    windows = inside.join(vectors.select("gid", "vector"), "gid").select(F.explode("blocks").alias("block"), "gid", "code", "vector")
    found = checkpointed(components(checkpointed(_window_links(windows, threshold).distinct())))

    members = vectors.select("gid", "vector", "weight").join(found.select(F.col("node").alias("gid"), "component"), "gid")
    sizes = checkpointed(found.groupBy("component").agg(F.count("*").alias("m")))
    members = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
    packs = max(1, math.ceil((sizes.where(F.col("m") <= BLOCK).agg(F.sum("m")).first()[0] or 0) / BLOCK) * 2)
    spread = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.struct(F.lit(0).cast("long").alias("c"), F.pmod(F.xxhash64("component"), F.lit(packs))
                                                 .cast("int").alias("x"), F.lit(0).alias("y"))).otherwise(
        F.struct(F.col("component").alias("c"), F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")))
    links = _counted(spread.withColumn("task", task).select("task", "component", "side", "gid", "weight", "vector"), threshold)
    links = links.groupBy("gid").agg(F.sum("links").alias("links"))
    least = (found.select(F.col("node").alias("gid"), "component").join(vectors.select("gid", "id"), "gid")
             .groupBy("component").agg(F.min("id").alias("least")))
    joined = (vectors.select("gid", "weight", "id").join(links, "gid", "left")
              .join(found.select(F.col("node").alias("gid"), "component"), "gid", "left").join(least, "component", "left"))
    each = checkpointed(joined.select("gid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                      F.coalesce("least", "id").alias("component_id")))
    out = rows.select("id", "gid").join(each, "gid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

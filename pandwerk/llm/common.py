"""Helpers shared by the operators: stages, row keys, ranks, component labels."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pandwerk.functions.lineage import delete, dropping_shuffles, scratch_path

#: Words everywhere: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A side is broadcast when its written table holds at most this many rows (of a few numbers each).
BROADCAST_ROWS = 20_000
#: The same for tables of one or two numbers that are joined to whole texts.
BROADCAST_IDS = 400_000

__all__ = ["BROADCAST_IDS", "BROADCAST_ROWS", "GAP", "WORD", "checkpointed", "components", "dropping_shuffles", "global_rank", "let",
           "lower_ascii", "read_table", "recording", "release", "scratch_path", "small_side", "words"]


#: Tables written while `recording`, until `release` finds them unused.
_RECORDED: list[str] = []
_ACTIVE: list[bool] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into a table beside the checkpoints and read it back."""
    path = scratch_path(df.sparkSession, "stage")
    if _ACTIVE:
        _RECORDED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recording():
    """Remember the tables written inside, for a later `release`."""
    _ACTIVE.append(True)
    try:
        yield
    finally:
        _ACTIVE.pop()


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the recorded tables that `docs` does not read."""
    files = docs.inputFiles() if _RECORDED else []
    for path in list(_RECORDED):
        if not any(path.rsplit("/", 1)[-1] in f for f in files):
            delete(spark, path)
            _RECORDED.remove(path)


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (a plain reference inside a lambda is evaluated per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, so that results do not depend on locale or Unicode tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_side(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it holds at most `most` rows; else leave the join to Spark."""
    return F.broadcast(table) if table.count() <= most else table


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Add `_rank` (0-based position in the total order), without one task for all rows.

    Rows are dealt by range and sorted; a row's place is its place in the partition plus the rows of earlier
    partitions. One count per partition reaches the driver.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    written = checkpointed(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = sorted((r["p"], r["n"]) for r in written.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return written.withColumn("_rank", F.lit(0).cast("long")).drop("_place")
    starts = written.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return (written.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn("_rank", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
            .drop("_place", "_part", "_start"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long); returns (node, component), component = smallest node reachable.

    Alternates two steps until nothing moves: every node hands its larger neighbours to the smallest node it
    sees, then every node hands its smaller neighbours to it. Hubs are reduced by map-side minima; each step
    is written, so a lost executor costs one step. Null ends and self links are ignored.
    """
    current = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    current = checkpointed(current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = checkpointed(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]

"""Whitening of vectors by the covariance of their distinct values, weighted by how often each occurs or by one.

Entries are rounded down to a grid of whole numbers, so equal vectors are equal keys. Each distinct vector is met once: it
enters the covariance with its weight, is projected once, and its result is joined back to all rows that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed

#: Grid steps per unit. (A common offset of all entries would change no result.)
SCALE = 64
COMPONENTS = 16
#: A vector that a share of 1 / HEAVY of all rows holds is joined apart; there are at most HEAVY of them.
HEAVY = 1_000
#: Largest whole number taken, far inside the range of long.
LARGEST = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: `n` fitted vectors (weights added up), exact sums per dimension (without the offset),
    unit components in rows by falling eigenvalue, their eigenvalues and shares of the total variance."""

    n: int
    sums: list[int]
    components: list[list[float]]
    eigenvalues: list[float]
    explained: list[float]


def _packed(steps):
    """Rows of whole numbers as bytes: a width in bytes, then the numbers. Equal rows give equal bytes."""
    import numpy as np

    out = []
    for row in steps:
        most = int(np.abs(row).max()) if len(row) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
        out.append(bytes([width]) + row.astype(f"<i{width}").tobytes())
    return out


def _unpacked(keys):
    """The inverse of `_packed` for keys of one dimension: an int64 matrix."""
    import numpy as np

    return np.stack([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in keys])


def _keyed(rows: DataFrame, scale: int) -> DataFrame:
    """Add `key` and `dims` to rows whose last column is the vector; rows without a usable vector are left out."""
    import pyspark.sql.types as T

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("key", T.BinaryType()), T.StructField("dims", T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            steps, places = [], []
            ends = vectors.offsets.to_numpy() if len(vectors) else np.zeros(1, np.int64)
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            present = np.asarray(vectors.is_valid())
            for i in np.flatnonzero(present):
                v = np.floor(values[ends[i]:ends[i + 1]] * scale)
                if np.isfinite(v).all() and (np.abs(v) < LARGEST).all():
                    steps.append(v.astype(np.int64))
                    places.append(i)
            kept = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:-1], pa.array(_packed(steps), pa.binary()), pa.array([len(s) for s in steps], pa.int32())],
                names=[*batch.schema.names[:-1], "key", "dims"])

    return rows.mapInArrow(run, schema)


def _in_few_tasks(table: DataFrame) -> DataFrame:
    """No more tasks than a few per core, so that their blocks together stay few whatever the table's size."""
    return table.coalesce(max(1, 4 * table.sparkSession.sparkContext.defaultParallelism))


def _totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Sum of weights and exact weighted sums per dimension; one row per dimension reaches the driver."""
    def run(batches):
        import pyarrow as pa

        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column("key").to_pylist())
                w = batch.column("weight").to_pylist()
                part = [sum(map(int.__mul__, column, w)) for column in x.T.tolist()]
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
                n += sum(w)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()),
                                              pa.array([str(v) for v in [n, *sums]])], names=["dim", "total"])

    found = _in_few_tasks(distinct.select("key", "weight")).mapInArrow(run, "dim int, total string")
    rows = found.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (int(rows[0]["total"]), [int(r["total"]) for r in rows[1:]]) if rows else (0, [])


def _covariance(table: DataFrame, n: int, width: int, centred) -> "np.ndarray":  # noqa: F821
    """Covariance with divisor `n` of what `centred(batch)` returns, (rows, weights): one block per task, rows of which
    are added up by Spark. A width-by-width block reaches the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        block = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x, w = centred(batch)
                block += (x * w[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(block.tolist(), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    cells = _in_few_tasks(table).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / (2 * n)


def _mean_and_rest(n: int, sums: list[int]):
    """S/n as a whole number and a small rest, so that x - S/n loses nothing to the size of x."""
    import numpy as np

    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - h * n) / n for s, h in zip(sums, whole)])


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """`distinct`: (key, weight) of every distinct vector of one dimension. Directions without spread, to rounding, are
    no components, as they cannot be scaled to one."""
    import numpy as np

    n, sums = _totals(distinct)
    if not n or not sums:
        return Whitening(n, sums, [], [], [])
    whole, rest = _mean_and_rest(n, sums)

    def centred(batch):
        return (_unpacked(batch.column("key").to_pylist()) - whole) - rest, batch.column("weight").to_numpy().astype(float)

    v = _covariance(distinct.select("key", "weight"), n, len(sums), centred)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    usable = values > len(sums) * np.finfo(float).eps * max(values[0], 0.0)
    most = min(components, int(usable.sum()))
    return Whitening(n, sums, vectors[:, :most].T.tolist(), values[:most].tolist(), (values[:most] / np.trace(v)).tolist())


def _projected(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(key, weight, deviation, whitened) of every distinct vector."""
    import numpy as np

    whole, rest = _mean_and_rest(model.n, model.sums)
    axes = np.array(model.components).T / np.sqrt(model.eigenvalues)
    n, sums = model.n, model.sums
    # within this bound whole-number arithmetic of 64 bits is exact
    bound = (1 << 62) // max(1, len(sums))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("key").to_pylist())
            reach = n * int(np.abs(x).max()) + max(map(abs, sums))
            if reach * reach < bound:
                away = n * x - np.array(sums, np.int64)
                deviation = (away * away).sum(axis=1).tolist()
            else:
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
            z = ((x - whole) - rest) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), pa.array(list(map(str, deviation))),
                 pa.array(z.tolist(), pa.list_(pa.float64()))], names=["key", "weight", "deviation", "whitened"])

    return distinct.select("key", "weight").mapInArrow(
        run, "key binary, weight long, deviation string, whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' weighted covariance, centred, minus the identity."""
    import numpy as np

    k = len(model.components)
    if not k:
        return 0.0
    row = projected.agg(*[F.sum(F.col("whitened")[i] * F.col("weight")).alias(f"s{i}") for i in range(k)]).first()
    mean = np.array([row[f"s{i}"] / model.n for i in range(k)])

    def centred(batch):
        z = np.array(batch.column("whitened").to_pylist())
        return z - mean, batch.column("weight").to_numpy().astype(float)

    v = _covariance(projected.select("whitened", "weight"), model.n, k, centred)
    return float(np.abs(v - np.eye(k)).max())


def whitened(vectors: DataFrame, vector: str = "embedding", *, weights: str = "one", components: int = COMPONENTS,
             scale: int = SCALE, carry: tuple[str, ...] | None = None) -> tuple[DataFrame, Whitening, float]:
    """(rows, model, identity error). Rows: the `carry` columns (default: all but the vector) as _c0, _c1, ...,
    `deviation` (decimal, exact: sum over dimensions of (n * x - S)^2) and `whitened` (array<double>, one entry per
    component).

    x = floor(scale * entry). `weights`: "one" fits every distinct x vector once, "count" as often as it occurs.
    Rows go out once per input row, repeats included, except those whose vector is null, holds null, NaN or infinite
    entries, or entries of 2^53 grid steps and more. Vectors of another length than the most frequent one (on a tie the
    longest), empty ones included, cannot share its covariance and are left out as well. An empty table, and vectors
    without any spread, give a model without components and rows with empty arrays.

    Distinct vectors are found by a grouping that is combined map-side. The result is joined back by the vector's packed
    bytes; vectors that many rows hold (at most 1,000 of them can hold a thousandth each) are joined by broadcast, so no
    task gets all rows of one vector. The driver holds dims-by-dims blocks only.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are 'one' or 'count', not {weights!r}")
    carry = [c for c in vectors.columns if c != vector] if carry is None else list(carry)
    column = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], column.alias("_v")).where(
        "_v is not null and not exists(_v, e -> e is null)")
    rows = checkpointed(_keyed(rows, scale))
    shapes = rows.groupBy("dims").agg(F.count("*").alias("n")).agg(F.max_by("dims", F.struct("n", "dims")).alias("dims")).first()
    rows = rows.where(F.col("dims") == F.lit(shapes["dims"])).drop("dims")
    counts = rows.groupBy("key").agg(F.count("*").alias("held"))
    distinct = checkpointed(counts.select("key", "held", (F.lit(1) if weights == "one" else F.col("held")).cast("long").alias("weight")))
    model = fit(distinct, components)
    if not model.components:
        none = F.array().cast("array<double>")
        return rows.drop("key").select("*", F.lit(0).cast("decimal(38,0)").alias("deviation"), none.alias("whitened")), model, 0.0
    projected = checkpointed(_projected(distinct, model).withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))
    error = identity_error(projected, model)
    held = distinct.agg(F.sum("held")).first()[0]
    results = projected.drop("weight")
    # each holds a share of 1 / HEAVY of the rows, so there are HEAVY at most
    heavy = F.broadcast(checkpointed(distinct.where(F.col("held") * HEAVY >= held).select("key")))
    often = F.broadcast(checkpointed(results.join(heavy, "key", "left_semi")))
    frequent = rows.join(often, "key")
    rare = rows.join(heavy, "key", "left_anti").join(results.join(heavy, "key", "left_anti"), "key")
    return frequent.unionByName(rare).drop("key"), model, error

"""Left joins whose missing keys stay where they are, and a filter of fixed size ahead of a join."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter per wanted key, and at least and at most; false hits only cost space.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``. Rows with a NULL key match nothing, so they are not shuffled to one task."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    added = [f for f in right.schema.fields if f.name not in keys]
    missing = left.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return left.where(known).join(right, keys, "left").unionByName(missing)


def possibly_among(rows: DataFrame, key: str, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows whose key is among the keys of ``wanted``, with some others: a bitmap over the keys' hashes decides, so that
    wide rows need no shuffle to be left out. Rows without a key go."""
    bits = LEAST_BITS
    while bits < min(BITS_PER_KEY * wanted.count(), most_bits):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    table = (wanted.where(F.col(key).isNotNull()).select(F.shiftright(place, 5).cast("int").alias("w"), (place % 32).cast("int").alias("i"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[table.column("w").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    held = rows.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @F.arrow_udf("boolean")
    def known(places):
        import pyarrow as pa

        at = places.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(held.value, np.uint32)[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    return rows.where(F.col(key).isNotNull() & known(place))

"""Per-key counts when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one input chunk.
CHUNK_ROWS = 131_072
#: Input chunks are merged this many at a time.
FAN_IN = 8


def tree_merge(partials: DataFrame, keys: list[str], sums: list[str], chunk: str, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Add up per-chunk partial sums in ceil(log_fan_in(chunks)) rounds.

    In each round a task merges at most ``fan_in`` partials of one key, however many rows that key has.
    """
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        partials = partials.groupBy(*keys, F.floor(F.col(chunk) / fan_in).cast("int").alias(chunk)).agg(*[F.sum(c).alias(c) for c in sums])
    return partials.drop(chunk)


def tree_count_distinct(rows: DataFrame, keys: list[str], values: list[str], name: str, chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Number of distinct ``values`` per ``keys``, without a reducer that receives all of a hot key.

    The input is taken in chunks of CHUNK_ROWS rows, of which there are the more the larger it is: rows are spread by a
    hash of keys and values together, so a key with any share of the rows lies evenly over all chunks, and copies, partly
    removed before the shuffle, meet in one chunk. Each chunk counts its own distinct values; the counts are merged by
    :func:`tree_merge`.

    Defined cases: NULL keys form a group; rows whose values are all NULL do not count; the
    result is empty for an empty table; other columns are ignored.
    """
    chunks = chunks or max(1, -(-rows.count() // CHUNK_ROWS))
    present = rows.filter(~F.forall(F.array(*[F.col(v).isNull() for v in values]), lambda x: x)) if len(values) > 1 else rows.filter(F.col(values[0]).isNotNull())
    distinct = present.groupBy(*keys, *values).agg(F.lit(1).alias("_one"))
    local = distinct.withColumn("_chunk", F.pmod(F.hash(*keys, *values), F.lit(chunks))).groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias(name))
    return tree_merge(local, keys, [name], "_chunk", chunks, fan_in)

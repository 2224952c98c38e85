"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_join, state_hash


def consecutive(deliveries: DataFrame, series: str, order: list[str], snapshot: str) -> DataFrame:
    """(snapshot, previous, next) within each series, ordered by ``order`` and then the snapshot id.

    One row per delivery, so the window holds delivery metadata only, never table rows.
    """
    w = Window.partitionBy(series).orderBy(*order, snapshot)
    return deliveries.select(snapshot, F.lag(snapshot).over(w).alias("previous"), F.lead(snapshot).over(w).alias("next"))


def snapshot_changes(rows: DataFrame, pairs: DataFrame, snapshot: str, keys: list[str], values: list[str]) -> DataFrame:
    """Records added, removed or changed in each snapshot against the one before.

    ``pairs`` has (snapshot, previous, next) as made by :func:`consecutive`. Every row is
    tagged with the comparisons it takes part in, as their later or earlier side; one
    aggregation by (later snapshot, key) keeps the row hashes of either side and classifies.

    Defined cases: copies collapse (min and max of equal hashes); NULL is a value of its own
    in keys and values; a key with several states in one snapshot is changed if the least or
    the greatest state hash differs; the first snapshot of a series and snapshots not in
    ``pairs`` yield nothing; an empty previous snapshot makes every record added; further
    columns are not compared.
    """
    sides = pairs.select(
        F.col(snapshot).alias("_in"),
        F.explode(
            F.array(
                F.struct(F.when(F.col("previous").isNotNull(), F.col(snapshot)).alias("later"), F.lit(True).alias("is_later")),
                F.struct(F.col("next").alias("later"), F.lit(False).alias("is_later")),
            )
        ).alias("_s"),
    ).filter(F.col("_s.later").isNotNull())
    # one dimension row per snapshot, so the join stays a lookup; the tag is exploded after it
    sides = sides.groupBy("_in").agg(F.collect_list("_s").alias("_sides"))
    slim = rows.select(F.col(snapshot).alias("_in"), *keys, state_hash(*values).alias("_h"))
    tagged = lookup_join(slim, sides, ["_in"]).select(*keys, "_h", F.explode("_sides").alias("_s")).select(*keys, "_h", F.col("_s.later").alias("_later"), F.col("_s.is_later").alias("_new"))
    new, old = F.when(F.col("_new"), F.col("_h")), F.when(~F.col("_new"), F.col("_h"))
    states = tagged.groupBy("_later", *keys).agg(F.min(new).alias("n0"), F.max(new).alias("n1"), F.min(old).alias("o0"), F.max(old).alias("o1"))
    kind = (
        F.when(F.col("o0").isNull(), F.lit("added"))
        .when(F.col("n0").isNull(), F.lit("removed"))
        .when((F.col("n0") != F.col("o0")) | (F.col("n1") != F.col("o1")), F.lit("changed"))
    )
    return states.select(F.col("_later").alias(snapshot), *keys, kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())


def delivery_status(deliveries: DataFrame, rows: DataFrame, snapshot: str, counted: str, declared: str, checksum: str, series: str, order: list[str]) -> DataFrame:
    """Per delivery: distinct ``counted`` values, whether that reaches ``declared``, and which complete delivery it repeats.

    A delivery without rows has 0 values. A NULL ``declared`` proves nothing, so the delivery is not complete. ``repeats``
    is the first complete delivery of the series with the same checksum, NULL if there is none before it.
    """
    counts = rows.groupBy(snapshot).agg(F.count_distinct(counted).alias("n_found"))
    known = deliveries.join(counts, snapshot, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    known = known.withColumn("complete", F.coalesce(F.col("n_found") >= F.col(declared), F.lit(False)))
    w = Window.partitionBy(series, checksum, "complete").orderBy(*order, snapshot)
    first = F.first(snapshot).over(w)
    return known.withColumn("repeats", F.when(F.col("complete") & F.col(checksum).isNotNull() & (first != F.col(snapshot)), first))

"""References to keys that are missing, deleted or not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, hot_keys, told


def existence_deltas(states: DataFrame, key: str, at: str, active: str) -> DataFrame:
    """(key, at, seen, exists): +1/-1 changes of a key's existence from its dated states.

    States of one key and date count once, as active if any of them is. A NULL date counts as the
    beginning of time. ``seen`` is the number of states that begin at that date.
    """
    dated = states.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.coalesce(F.col(at), F.lit(0)).cast("long").alias("at")).agg(F.max(F.col(active).cast("int")).alias("on"))
    before = F.lag("on", 1, 0).over(Window.partitionBy("key").orderBy("at"))
    return dated.select("key", "at", F.lit(1).alias("seen"), (F.coalesce("on", F.lit(0)) - before).alias("exists"))


#: A date and the moment after it, in which the references of one date are taken back.
ON, AFTER = 0, 1


def reference_deltas(references: DataFrame) -> DataFrame:
    """(key, at, step, refs): +n for the references to a key at a date, -n after it.

    A reference counts at the date of its own delivery, which states it in full; a later delivery that still has
    it states it again. References are added up per (key, at) before the shuffle, so a hot key brings one row per date.
    """
    counted = references.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", F.col("at").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", "at", F.inline(F.array(F.struct(F.lit(ON).alias("step"), F.col("n").alias("refs")), F.struct(F.lit(AFTER).alias("step"), (-F.col("n")).alias("refs")))))


def running_counts(references: DataFrame, existence: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, at, step, refs, seen, exists, ever): running sums of all signed changes of a key up to each of its dates.

    ``before`` has the sums that :func:`counts_after` left of earlier periods; then only the changes since are needed.
    """
    zero = F.lit(0).cast("long")
    log = references.select("key", "at", "step", "refs", zero.alias("seen"), zero.alias("exists"))
    log = log.unionByName(existence.select("key", "at", F.lit(ON).alias("step"), zero.alias("refs"), F.col("seen").cast("long"), F.col("exists").cast("long")))
    if before is not None:
        log = log.unionByName(before.select("key", F.lit(-1).cast("long").alias("at"), F.lit(ON).alias("step"), "refs", "seen", "exists"))
    log = log.groupBy("key", "at", "step").agg(*[F.sum(c).alias(c) for c in ("refs", "seen", "exists")])
    of_key = Window.partitionBy("key")
    so_far = of_key.orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select("key", "at", "step", *[F.sum(c).over(so_far).alias(c) for c in ("refs", "seen", "exists")], F.sum("seen").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("ever"))


def counts_after(references: DataFrame, existence: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, refs, seen, exists): the sums of all changes, to be stored as the next period's ``before``."""
    zero = F.lit(0).cast("long")
    parts = references.select("key", "refs", zero.alias("seen"), zero.alias("exists")).unionByName(existence.select("key", zero.alias("refs"), F.col("seen").cast("long"), F.col("exists").cast("long")))
    parts = parts if before is None else parts.unionByName(before.select("key", "refs", "seen", "exists"))
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("refs", "seen", "exists")])


def orphan_keys(references: DataFrame, existence: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, at, n_refs, reason) of every key with positive references and no existence at a date.

    ``missing`` if no state exists at all, ``late`` if the first one begins after the date,
    ``deleted`` if existence has been taken back.
    """
    sums = running_counts(reference_deltas(references), existence, before)
    reason = F.when(F.col("ever") == 0, "missing").when(F.col("seen") == 0, "late").otherwise("deleted")
    return sums.filter((F.col("refs") > 0) & (F.col("exists") <= 0) & (F.col("at") >= 0)).select("key", "at", F.col("refs").alias("n_refs"), reason.alias("reason"))


def orphan_records(references: DataFrame, orphans: DataFrame, n_orphans: int) -> DataFrame:
    """The reference rows with their reason; ``references`` has (key, at) and any other columns.

    Up to BROADCAST_ROWS orphan keys and dates are broadcast, so the references are not shuffled. Beyond that, keys with
    more than 1/64 of all references, of which there are 64 at most, are salted; the rest joins by a shuffle on (key, at).
    """
    slim = orphans.select("key", "at", "reason")
    if n_orphans <= BROADCAST_ROWS:
        return references.join(F.broadcast(slim), ["key", "at"])
    hot = hot_keys(references, "key")
    if not hot:
        return references.join(slim, ["key", "at"])
    is_hot = F.col("key").isin(hot)
    hot_orphans = slim.filter(is_hot)
    salts = 32
    salted = references.filter(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*references.columns), F.lit(salts)))
    spread = salted.join(hot_orphans.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "at", "_salt"]).drop("_salt")
    return references.filter(F.col("key").isNotNull() & ~is_hot).join(slim, ["key", "at"]).unionByName(spread)


def find_orphans(references: DataFrame, states: DataFrame, key: str, at: str, active: str) -> DataFrame:
    """Every row of ``references`` (key, at, ...) whose key has no existence at its date, with the reason.

    Defined cases: references with a NULL key or date are not references; copies are kept as they
    come; empty tables give empty results; with no states at all every reference is missing.
    """
    orphans = cut(orphan_keys(references, existence_deltas(states, key, at, active)), told={"n": F.count(F.lit(1))})
    return orphan_records(references, orphans, told(orphans, "n"))

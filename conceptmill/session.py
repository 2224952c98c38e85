"""Session defaults, lineage cuts and joins that survive hot keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the left rows is joined apart, so at most HOT_KEYS keys are.
HOT_KEYS = 64
#: Below this many rows a hot key fits into one task anyway.
HOT_FLOOR = 200_000
#: Dimension rows that may be broadcast (fixed-width columns, so some tens of MB at most).
BROADCAST_ROWS = 200_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("conceptmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of its own only where that is unset and one process runs all."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="conceptmill-")
        context.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  a leftover scratch table harms nothing
        pass


_runs: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The application's folder in the shared checkpoint folder; it is deleted when the interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{_shared_folder(spark)}/conceptmill-{app}"
        atexit.register(_delete, spark, _runs[app])
    return _runs[app]


def cut(df: DataFrame, instead_of: DataFrame | None = None, told: dict[str, Column] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    This cuts the lineage like a checkpoint, survives lost executors, and gives the planner
    true sizes: a checkpoint keeps size estimates that square with every self-join of a loop.
    ``instead_of`` is an earlier cut that nothing reads any more; its files are deleted. The
    rest goes when the interpreter ends. Aggregates in ``told`` are worked out while the table is
    written, without a further job; :func:`told` has them. ``compression`` is by default the session's.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation() if told else None
    (df.observe(seen, *[c.alias(n) for n, c in told.items()]) if told else df).write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path, out._told = path, seen.get if told else {}
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(table: DataFrame) -> None:
    """Delete the files of a :func:`cut` that nothing reads any more."""
    if getattr(table, "_cut_path", None):
        _delete(table.sparkSession, table._cut_path)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs deleted now: Spark does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def told(table: DataFrame, name: str) -> int:
    """What :func:`cut` worked out while it wrote the table; 0 for a sum over no rows."""
    return table._told.get(name) or 0


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a large table with a dimension that is unique by ``on``.

    The dimension is counted first. Up to ``max_rows`` rows it is broadcast; beyond, the
    fact side is salted and the dimension repeated once per salt, so that one key with
    a third of the fact rows spreads over ``salts`` tasks. NULL keys match nothing.
    """
    if dim.limit(max_rows + 1).count() <= max_rows:
        return fact.join(F.broadcast(dim), on, how)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns if fact.schema[c].dataType.typeName() != "map"]), F.lit(salts)))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, total: int | None = None) -> list:
    """Keys that hold more than 1/HOT_KEYS of the rows; at most HOT_KEYS of them."""
    total = df.count() if total is None else total
    if total < HOT_FLOOR:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.filter(F.col("_n") > F.lit(total // HOT_KEYS)).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """Equi-join with a right side unique by ``key``, hot left keys and NULL ones apart.

    NULL keys match nothing, so those rows go around the join rather than into one of its tasks.
    The hot keys, at most HOT_KEYS by their definition, have at most that many right rows,
    which are broadcast; all other rows take the ordinary shuffle join.
    """
    further = [c for c in right.columns if c != key]
    rest = left.filter(F.col(key).isNotNull())
    hot = hot_keys(rest, key, total)
    is_hot = F.col(key).isin(hot)
    parts = [(rest.filter(~is_hot) if hot else rest).join(right.filter(~is_hot) if hot else right, key, how)]
    if hot:
        parts.append(rest.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))
    if how == "left" and left.schema[key].nullable:
        parts.append(left.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in further]))
    return reduce(DataFrame.unionByName, parts)


def state_hash(*columns: str) -> Column:
    """64-bit hash in which NULL is a value of its own at every position."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)

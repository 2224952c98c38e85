"""The tables that expressions are evaluated on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, drop

# Identifiers of the release format
IS_A, INFERRED, SOME_MODIFIER = 116680003, 900000000000011006, 900000000000451002
PRIMITIVE, DEFINED = 900000000000074008, 900000000000073002
FSN, SYNONYM, DEFINITION = 900000000000003001, 900000000000013009, 900000000000550004
PREFERRED, ACCEPTABLE = 900000000000548007, 900000000000549004
ASSOCIATIONS = 900000000000522004
SAME_AS, REPLACED_BY, WAS_A, MOVED_TO, MOVED_FROM = 900000000000527005, 900000000000526001, 900000000000528000, 900000000000524003, 900000000000525002
PARTIALLY_EQUIVALENT = 1186924009
GB_ENGLISH, US_ENGLISH = 900000000000508004, 900000000000509007

SCHEMAS = {
    "concept": "concept_id BIGINT, module_id BIGINT, effective_time INT, active BOOLEAN, defined BOOLEAN",
    "isa": "child BIGINT, parent BIGINT",
    "relationship": "source BIGINT, grp INT, type BIGINT, target BIGINT",
    "concrete": "source BIGINT, grp INT, type BIGINT, kind STRING, canon STRING, num_key STRING",
    "member": "refset BIGINT, row_no BIGINT, effective_time INT, active BOOLEAN, module_id BIGINT, referenced BIGINT, fields MAP<STRING,STRING>",
    "member_schema": "refset BIGINT, pos INT, field STRING, kind STRING",
    "refset_domain": "refset BIGINT, concept_based BOOLEAN",
    "description": "description_id BIGINT, concept_id BIGINT, module_id BIGINT, type_id BIGINT, effective_time INT, active BOOLEAN, language STRING, term STRING, dialects ARRAY<STRUCT<refset: BIGINT, acceptability: BIGINT>>",
    "association": "refset BIGINT, source BIGINT, target BIGINT",
    "identifier": "scheme BIGINT, code STRING, component BIGINT, module_id BIGINT, effective_time INT, active BOOLEAN",
}


@dataclass
class Config:
    """Aliases of identifier schemes and dialects, and the language of member texts."""

    schemes: dict[str, int] = field(default_factory=dict)
    dialects: dict[str, int] = field(default_factory=lambda: {"en-gb": GB_ENGLISH, "en-us": US_ENGLISH})
    language: str = "en"

    @classmethod
    def load(cls, path: str) -> Config:
        read = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = set(read) - {"schemes", "dialects", "language"}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        made = cls()
        made.schemes |= {k.lower(): int(v) for k, v in read.get("schemes", {}).items()}
        made.dialects |= {k.lower(): int(v) for k, v in read.get("dialects", {}).items()}
        made.language = read.get("language", made.language)
        return made

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def is_concept_id(column):
    return F.pmod(F.floor(column / 10), F.lit(100)).isin(0, 10)


def build_closure(isa: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth): proper pairs with the least depth, by doubling.

    With all pairs up to depth d at hand, a pair between d and 2d splits after exactly d links, so each round
    joins the pairs of depth d with all others and finds every longer pair once per
    shortest way. The number of rounds is the logarithm of the depth. Pairs (x, x) of cycles are kept out.
    """
    pairs = cut(isa.filter(F.col("child") != F.col("parent")).select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")).distinct())
    step = 1
    while True:
        upper = pairs.filter(F.col("depth") == step).select("ancestor", F.col("descendant").alias("middle"))
        lower = pairs.select(F.col("ancestor").alias("middle"), "descendant", (F.col("depth") + step).alias("depth"))
        longer = cut(upper.join(lower, "middle").filter(F.col("ancestor") != F.col("descendant")).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        if not longer.limit(1).count():
            return pairs
        pairs = cut(pairs.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")), instead_of=pairs)
        drop(longer)
        step *= 2


class Catalog:
    """Tables by name, made when first asked for; ``sources`` maps a name to a function that makes it."""

    def __init__(self, spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], config: Config | None = None, manifest: dict | None = None):
        self.spark, self.config, self.manifest = spark, config or Config(), manifest or {}
        self._sources, self._made = sources, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in self._sources:
                self._made[name] = self._sources[name]()
            elif name == "closure":
                self._made[name] = build_closure(self.isa)
            elif name == "membership":
                self._made[name] = self.member.filter("active").join(self.concept.select(F.col("concept_id").alias("referenced")), "referenced", "left_semi").select("refset", F.col("referenced").alias("member")).distinct()
            elif name == "refset_domain":
                self._made[name] = self.member.groupBy("refset").agg(F.max(is_concept_id(F.col("referenced"))).alias("concept_based"))
            elif name == "word":
                self._made[name] = words(self.description)
            elif name == "display":
                self._made[name] = displays(self.description)
            elif name in SCHEMAS:
                self._made[name] = self.spark.createDataFrame([], SCHEMAS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    @cached_property
    def schema_of(self) -> dict[int, dict[str, tuple[str, str]]]:
        """refset -> lower-case field -> (field, kind); one row per field of a table, so metadata only."""
        out: dict[int, dict[str, tuple[str, str]]] = {}
        for r in self.member_schema.orderBy("refset", "pos").collect():
            out.setdefault(r["refset"], {})[r["field"].lower()] = (r["field"], r["kind"])
        return out

    @cached_property
    def refsets(self) -> set[int]:
        """All reference sets with rows or a declared domain; those without own fields have no row in ``member_schema``."""
        return set(self.schema_of) | {r[0] for r in self.refset_domain.select("refset").collect()}


# Latin-1 letters and what they are searched as
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"


def folded(column):
    return F.translate(F.lower(column), FOLD_FROM, FOLD_TO)


def words(description: DataFrame) -> DataFrame:
    found = description.filter("active").select("concept_id", F.explode(F.regexp_extract_all(folded(F.col("term")), F.lit("([0-9a-z]+)"), 1)).alias("word"))
    return found.select("word", "concept_id").distinct()


def displays(description: DataFrame, refsets: tuple[int, ...] = (GB_ENGLISH, US_ENGLISH)) -> DataFrame:
    """(concept_id, term): the preferred synonym by the refsets in turn, else the fully specified name, else a synonym; ties go to the least id.

    One aggregation; only active English terms count.
    """
    rank = F.lit(None).cast("int")

    def preferred(refset: int):
        return F.exists("dialects", lambda d: (d["refset"] == refset) & (d["acceptability"] == PREFERRED))

    for i, r in reversed(list(enumerate(refsets))):
        rank = F.when((F.col("type_id") == SYNONYM) & preferred(r), i).otherwise(rank)
    rank = F.coalesce(rank, F.when(F.col("type_id") == FSN, len(refsets)).when(F.col("type_id") == SYNONYM, len(refsets) + 1))
    ranked = description.filter("active AND language = 'en'").withColumn("rank", rank).filter(F.col("rank").isNotNull())
    return ranked.groupBy("concept_id").agg(F.min(F.struct("rank", "description_id", "term")).alias("d")).select("concept_id", F.col("d.term").alias("term"))


def save(catalog: Catalog, path: str) -> None:
    """Write all tables as compressed Parquet, each sorted by the column that queries look up; never over an existing index."""
    order = {"concept": "concept_id", "isa": "child", "closure": "ancestor", "relationship": "type", "concrete": "type", "member": "refset", "description": "concept_id", "membership": "refset", "word": "word", "association": "target", "identifier": "code", "display": "concept_id"}
    staged = f"{path}.part"
    spark = catalog.spark
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(path)):
        raise FileExistsError(path)
    fs.delete(fs_path(staged), True)
    for name in [*SCHEMAS, "closure", "membership", "word", "display"]:
        df = getattr(catalog, name)
        if name in order:
            df = df.repartitionByRange(F.col(order[name])).sortWithinPartitions(order[name])
        df.write.option("compression", "zstd").parquet(f"{staged}/{name}")
    spark.createDataFrame([(json.dumps(catalog.manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
    if not fs.rename(fs_path(staged), fs_path(path)):
        raise OSError(f"could not publish {path}")


def load(spark: SparkSession, path: str, config: Config | None = None) -> Catalog:
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()) or "{}")
    names = [*SCHEMAS, "closure", "membership", "word", "display"]
    return Catalog(spark, {n: (lambda n=n: spark.read.parquet(f"{path}/{n}")) for n in names}, config, manifest)


def verify(catalog: Catalog) -> dict[str, int]:
    """Violations of every integrity rule, counted; a sound index has none."""
    c, checks = catalog, {}
    ids = c.concept.select("concept_id")
    active = c.concept.filter("active").select("concept_id")
    missing = lambda df, column, known: df.filter(F.col(column).isNotNull()).join(known.select(F.col("concept_id").alias(column)), column, "left_anti").count()
    checks["duplicate_concepts"] = ids.groupBy("concept_id").count().filter("count > 1").count()
    checks["unresolved_modules"] = missing(c.concept, "module_id", ids)
    checks["isa_ends_not_active"] = missing(c.isa, "child", active) + missing(c.isa, "parent", active)
    # a concept on a cycle is below another one and above it
    turned = c.closure.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"))
    checks["cyclic_pairs"] = c.closure.join(turned, ["ancestor", "descendant"], "left_semi").count()
    checks["attribute_sources_not_active"] = missing(c.relationship, "source", active) + missing(c.concrete, "source", active)
    checks["duplicate_descriptions"] = c.description.groupBy("description_id").count().filter("count > 1").count()
    checks["empty_terms"] = c.description.filter("term IS NULL OR term = ''").count()
    checks["bad_languages"] = c.description.filter(~F.coalesce(F.col("language").rlike("^[a-z]{2}$"), F.lit(False))).count()
    checks["duplicate_identifiers"] = c.identifier.groupBy("scheme", "code").count().filter("count > 1").count()
    checks["identifier_control_characters"] = c.identifier.filter(F.col("code").rlike("[\\x00-\\x1f\\x7f]")).count()
    return checks

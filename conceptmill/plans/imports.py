"""Queries over a catalog that went through release files: written from the star-schema terminology, imported again; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..catalog import Catalog
from ..engine import Engine
from ..session import drop, run_folder
from ..sources.release_files import DESCRIPTORS, ReleaseArchive
from ..sources.snapshot import MODULE_DEPENDENCY, import_snapshot
from ..sources.star import SCHEME, Star, cid
from . import expressions

DATE = 20991231
#: Expressions whose answer must be that of the tables, by what of the import they rest on.
ASKED = [
    "ecl_descendants", "ecl_ancestors", "ecl_parents", "ecl_attribute_equality", "ecl_group", "ecl_isa_attribute", "ecl_concrete_greater", "ecl_group_with_concrete", "ecl_concept_filter_time", "ecl_concept_filter_status",
    "ecl_concept_filter_active", "ecl_description_language", "ecl_description_inactive", "ecl_description_dialect", "ecl_term_words", "ecl_term_wild", "ecl_history_min", "ecl_identifier", "ecl_member_rows", "ecl_member_all_fields", "ecl_member_projection_numbers",
]
_imported: dict[tuple[str, str], Catalog] = {}


def imported(spark: SparkSession, d: str) -> Catalog:
    """The directory's terminology, written as release files and imported, once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _imported:
        star = Star(spark, d).catalog(stored=False)
        release = ReleaseArchive(star, f"{run_folder(spark)}/release-{uuid.uuid4().hex}", DATE, cid(32, 3), [cid(10, SCHEME)])
        _imported[key] = import_snapshot(spark, release, config=star.config)
        for table in (star.isa, star.concept):
            drop(table)
    return _imported[key]


def run(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Engine(imported(spark, d)).evaluate(expressions.EXPRESSIONS[name][0]).df

    query.__name__ = f"import_{name[4:]}"
    return query


def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each imported table that the tables give a number for."""
    c = imported(spark, d)
    parts = [getattr(c, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("relationship", "concrete", "identifier", "association")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def import_domains(spark: SparkSession, d: str) -> DataFrame:
    """Which reference sets hold concepts, by their descriptors or rows."""
    return imported(spark, d).refset_domain


def import_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the import says of the edition."""
    m = imported(spark, d).manifest
    return spark.createDataFrame([(m["edition"], m["date"], m["root_editions"], m["history_skipped"])], "edition string, release_date int, root_editions int, history_skipped bigint")


QUERIES = {q.__name__: q for q in map(run, ASKED)} | {f.__name__: f for f in (import_counts, import_domains, import_manifest)}
SQL = {f"import_{name[4:]}": expressions.SQL[name] for name in ASKED} | {
    "import_counts": """
SELECT 'relationship' AS table_name, (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) AS n
UNION ALL SELECT 'concrete', (SELECT count(*) FROM orders) + 6 * (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'identifier', (SELECT count(*) FROM customer)
UNION ALL SELECT 'association', (SELECT count(*) FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f)""",
    "import_domains": f"SELECT unnest([{', '.join(str(cid(31, k)) for k in (1, 2, 3))}, {fixed.SAME_AS}, {MODULE_DEPENDENCY}, {DESCRIPTORS}]) AS refset, true AS concept_based UNION ALL SELECT unnest([{fixed.GB_ENGLISH}, {fixed.US_ENGLISH}]), false",
    "import_manifest": f"SELECT 'http://snomed.info/sct/{cid(32, 3)}/version/{DATE}' AS edition, CAST({DATE} AS INTEGER) AS release_date, CAST(1 AS INTEGER) AS root_editions, CAST(0 AS BIGINT) AS history_skipped",
}

"""Which edition an index is of, whether its modules fit together, and whether a newer release is out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .snapshot import ImportFailure, edition_candidates

# Fixed value: the reference set of module dependencies
MODULE_DEPENDENCY = 900000000000534007


def broken_dependencies(catalog: Catalog) -> DataFrame:
    """(module_id, needs, problem) of active module dependencies whose modules are missing, or whose dates are not both there."""
    rows = catalog.member.filter((F.col("refset") == MODULE_DEPENDENCY) & F.col("active"))
    date = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    told = rows.select("module_id", F.col("referenced").alias("needs"), ((date("sourceEffectiveTime") == "") | (date("targetEffectiveTime") == "")).alias("undated"))
    known = catalog.concept.select("concept_id", F.lit(True).alias("is_known"))
    for end in ("module_id", "needs"):
        told = told.join(known.withColumnRenamed("concept_id", end).withColumnRenamed("is_known", f"known_{end}"), end, "left")
    problem = F.when(F.col("known_module_id").isNull() | F.col("known_needs").isNull(), "missing").when(F.col("undated"), "undated")
    return told.select("module_id", "needs", problem.alias("problem")).filter(F.col("problem").isNotNull())


def edition_module(catalog: Catalog, expected: int | None = None) -> int:
    """The expected module, or the only one that no other depends on; anything else is an error that names the candidates."""
    found = [r[0] for r in edition_candidates(catalog).orderBy("module_id").limit(100).collect()]
    if expected is not None:
        if not catalog.concept.filter(F.col("module_id") == expected).limit(1).count():
            raise ImportFailure(f"the release has no rows of the module {expected}")
        return expected
    if len(found) != 1:
        raise ImportFailure(f"the edition is one of {found}: name it")
    return found[0]


def assess(mine: dict, published: list[dict]) -> str:
    """up_to_date, reissued, behind(n) or unknown, from dates and checksums of the own and the published releases."""
    same_day = [p for p in published if p.get("date") == mine.get("date")]
    newer = {p["date"] for p in published if p.get("date") and mine.get("date") and p["date"] > mine["date"]}
    if newer:
        return f"behind({len(newer)})"
    if not same_day:
        return "unknown"
    return "up_to_date" if any(p.get("archive_sha256") == mine.get("archive_sha256") for p in same_day) else "reissued"

"""Write results: codes, CSV with labels, typed values and rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, Result


def write_codes(result: Result, path: str, as_json: bool = False) -> None:
    """One code per line, in numeric order."""
    ordered = result.df.select("concept_id").orderBy("concept_id")
    code = F.col("concept_id").cast("string")
    ordered.select(F.to_json(F.struct(code.alias("code"))) if as_json else code).write.text(path)


def guarded(column):
    """A cell that a spreadsheet would take for a formula begins with an apostrophe."""
    return F.when(column.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), column)).otherwise(column)


def labelled_csv(engine: Engine, result: Result) -> DataFrame:
    labels = engine.labelled(result.df.select("concept_id"))
    return labels.orderBy("concept_id").select(F.col("concept_id").cast("string").alias("code"), guarded(F.coalesce("display", F.lit(""))).alias("display"))


def write_csv(engine: Engine, result: Result, path: str) -> None:
    labelled_csv(engine, result).write.option("header", True).option("escape", '"').csv(path)


# Names of the value kinds, in their order
KIND_NAMES = ["concept", "component", "number", "boolean", "time", "string"]


def json_lines(result: Result) -> DataFrame:
    """One JSON object per value, with type and value, or per row."""
    if result.kind == "values":
        name = F.element_at(F.array(*map(F.lit, KIND_NAMES)), F.col("kind").cast("int") + 1)
        return result.ordered().select(F.to_json(F.struct(name.alias("type"), F.col("text").alias("value"))).alias("value"))
    return result.ordered().select(F.to_json(F.struct(*[F.col(c) for c in result.df.columns])).alias("value"))


def write_json(result: Result, path: str) -> None:
    json_lines(result).write.text(path)

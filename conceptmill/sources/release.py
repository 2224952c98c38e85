"""A catalog of the RF2-shaped domain tables: the newest state of every row as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..catalog import Catalog, Config
from ..operators.hierarchy import heavy_paths
from ..session import cut
from .tables import table


def newest(rows: DataFrame, key: str, at: str, columns: list[str], tie: Column | None = None) -> DataFrame:
    """The newest state of each key in one aggregation; a NULL date is the oldest, ties go to the greatest remaining columns."""
    order = [F.coalesce(at, F.lit(0)).alias("_t"), *([tie.alias("_tie")] if tie is not None else [])]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("s")).select(key, *[f"s.{c}" for c in columns])


class Release:
    def __init__(self, spark: SparkSession, directory: str, as_of: int | None = None):
        self.spark, self.d, self.as_of = spark, directory, as_of

    def t(self, name: str) -> DataFrame:
        """A table's rows up to the date; rows without a date count as the oldest."""
        rows = table(self.spark, self.d, name)
        return rows if self.as_of is None or "effective_time" not in rows.columns else rows.filter(F.coalesce("effective_time", F.lit(0)) <= self.as_of)

    def concept(self) -> DataFrame:
        core = self.t("sct_concept").select("id", "effective_time", "active", "module_id", "definition_status_id")
        meta = self.t("metadata_concept").select("id", "effective_time", "active", "module_id", F.lit(fixed.PRIMITIVE).cast("bigint").alias("definition_status_id"))
        now = newest(core.unionByName(meta), "id", "effective_time", ["effective_time", "active", "module_id", "definition_status_id"])
        return now.select(F.col("id").alias("concept_id"), "module_id", "effective_time", (F.col("active") == 1).alias("active"), (F.col("definition_status_id") == fixed.DEFINED).alias("defined"))

    def links(self) -> DataFrame:
        if not hasattr(self, "_links"):
            rows = newest(self.t("sct_relationship"), "id", "effective_time", ["active", "type_id", "characteristic_type_id", "source_id", "destination_id", "relationship_group"], F.col("active"))
            self._links = cut(rows.filter(f"active = 1 AND characteristic_type_id = {fixed.INFERRED}"))
        return self._links

    def isa(self) -> DataFrame:
        """The is-a links above which no cycle lies: a link of a concept on or below a cycle is left out."""
        links = self.links().filter(F.col("type_id") == fixed.IS_A).select(F.col("source_id").alias("child"), F.col("destination_id").alias("parent")).distinct()
        forest = heavy_paths(links, "child", "parent", numbers=False)
        return links.join(forest.nodes.select(F.col("node").alias("child")), "child", "left_semi")

    def relationship(self) -> DataFrame:
        return self.links().filter(F.col("type_id") != fixed.IS_A).select(F.col("source_id").alias("source"), F.col("relationship_group").alias("grp"), F.col("type_id").alias("type"), F.col("destination_id").alias("target"))

    def member(self) -> DataFrame:
        rows = self.t("refset_member").withColumn("row_no", F.xxhash64("id"))
        now = rows.groupBy("id").agg(F.max(F.struct("delivery_id", F.coalesce("effective_time", F.lit(0)).alias("_t"), "active", "refset_id", "row_no", "effective_time", "module_id", "referenced_component_id", "map_group", "map_target")).alias("s")).select("s.*")
        fields = F.create_map(F.lit("mapGroup"), F.coalesce(F.col("map_group").cast("string"), F.lit("")), F.lit("mapTarget"), F.coalesce("map_target", F.lit("")))
        return now.select(F.col("refset_id").alias("refset"), "row_no", "effective_time", (F.col("active") == 1).alias("active"), "module_id", F.col("referenced_component_id").alias("referenced"), fields.alias("fields"))

    def member_schema(self) -> DataFrame:
        refsets = self.t("refset_member").select(F.col("refset_id").alias("refset")).distinct()
        return refsets.select("refset", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("mapGroup").alias("field"), F.lit("integer").alias("kind")), F.struct(F.lit(1).alias("pos"), F.lit("mapTarget").alias("field"), F.lit("text").alias("kind")))).alias("x")).select("refset", "x.*")

    def association(self) -> DataFrame:
        now = self.t("historical_association").groupBy("id").agg(F.max(F.struct("delivery_id", F.coalesce("effective_time", F.lit(0)).alias("_t"), "active", "refset_id", "referenced_component_id", "target_component_id")).alias("s")).select("s.*")
        told = now.filter("active = 1").select(F.col("refset_id").alias("refset"), F.col("referenced_component_id").alias("source"), F.col("target_component_id").alias("target")).distinct()
        known = release_catalog(self.spark, self.d, self.as_of).concept.select("concept_id")
        for end in ("source", "target"):
            told = told.join(known.withColumnRenamed("concept_id", end), end, "left_semi")
        return told.select("refset", "source", "target")

    def identifier(self) -> DataFrame:
        now = self.t("identifier_snapshot").groupBy("scheme", "code").agg(F.max(F.struct("delivery_id", F.col("active").cast("int").alias("on"), "referenced_component", "module_id", "effective_time")).alias("s"))
        return now.select("scheme", "code", F.col("s.referenced_component").alias("component"), "s.module_id", "s.effective_time", (F.col("s.on") == 1).alias("active"))

    def catalog(self) -> Catalog:
        sources = {n: getattr(self, n) for n in ("relationship", "member_schema", "association", "identifier")}
        sources |= {n: (lambda n=n: cut(getattr(self, n)())) for n in ("concept", "isa", "member")}
        return Catalog(self.spark, sources, Config(), {"edition": "release"})


_catalogs: dict[tuple, Catalog] = {}


def release_catalog(spark: SparkSession, directory: str, as_of: int | None = None) -> Catalog:
    """The directory's catalog as of a date, built once per application."""
    key = (spark.sparkContext.applicationId, directory, as_of)
    if key not in _catalogs:
        _catalogs[key] = Release(spark, directory, as_of).catalog()
    return _catalogs[key]

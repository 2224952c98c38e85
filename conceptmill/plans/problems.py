"""The pN_ queries over the domain tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import schema_drift
from ..operators.hierarchy import descendants, heavy_paths, paths, roots_and_depths
from ..operators.orphan_references import find_orphans
from ..operators.snapshot_changes import consecutive, delivery_status, snapshot_changes
from ..operators.tree_aggregate import tree_count_distinct
from ..session import cut, lookup_join
from ..sources.tables import table

# Identifiers of the release format
IS_A = 116680003
INFERRED = 900000000000011006


def _status(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "edition_manifest").select("delivery_id", "edition", "release_date", "delivered_at", "concept_count", "archive_sha256")
    return delivery_status(manifest, table(spark, d, "identifier_snapshot").select("delivery_id", "referenced_component"), "delivery_id", "referenced_component", "concept_count", "archive_sha256", "edition", ["release_date", "delivered_at"])


def p1_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Which deliveries are incomplete or repeat another."""
    return _status(spark, d).select("delivery_id", "edition", "release_date", "n_found", "concept_count", "complete", "repeats")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    complete = cut(_status(spark, d).filter("complete"))
    pairs = consecutive(complete, "edition", ["release_date", "delivered_at"], "delivery_id")
    return snapshot_changes(table(spark, d, "identifier_snapshot"), pairs, "delivery_id", ["scheme", "code"], ["referenced_component", "module_id", "effective_time", "active"])


def is_a_links(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, destination_id) of the newest states that are active inferred is-a rows.

    The newest state of an id is one hash aggregation by one number: its date, then whether it is a link, then a hash
    of its ends, so that of different links of one date one holds, always the same. A NULL date is older than any other.
    """
    rows = table(spark, d, "sct_relationship")
    is_link = (F.col("active") == 1) & (F.col("type_id") == IS_A) & (F.col("characteristic_type_id") == INFERRED)
    link = F.coalesce(is_link, F.lit(False)).cast("long")
    rank = (F.coalesce("effective_time", F.lit(0)).cast("long") * 2 + link) * F.lit(1 << 34) + F.pmod(F.xxhash64("source_id", "destination_id"), F.lit(1 << 33)) * 2 + link
    ranked = rows.select("id", "source_id", "destination_id", rank.alias("rank"))
    newest = ranked.groupBy("id").agg(F.max("rank").alias("rank"), F.max_by("source_id", "rank").alias("source_id"), F.max_by("destination_id", "rank").alias("destination_id"))
    return newest.filter("rank % 2 = 1").select("source_id", "destination_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = roots_and_depths(is_a_links(spark, d), "source_id", "destination_id")
    return found.select(F.col("node").alias("concept_id"), F.col("root").alias("root_id"), F.col("depth").cast("long").alias("node_depth"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth, root and number of descendants of every concept of a tree."""
    forest = heavy_paths(is_a_links(spark, d), "source_id", "destination_id")
    full = paths(forest).join(forest.nodes, "node")
    return full.select(F.col("node").alias("concept_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), (F.col("size") - 1).alias("n_descendants"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(heavy_paths(is_a_links(spark, d), "source_id", "destination_id")).select(F.col("ancestor").alias("concept_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refset_member").select("delivery_id", "refset_id", "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counted = tree_count_distinct(_members(spark, d), ["delivery_id", "refset_id"], ["id"], "n_members")
    declared = table(spark, d, "member_manifest").filter(F.col("n_rows").isNotNull()).select("delivery_id", "refset_id", "n_rows").distinct()
    both = declared.join(counted, ["delivery_id", "refset_id"], "left")
    return both.filter(F.col("n_rows") != F.coalesce("n_members", F.lit(0))).select("delivery_id", "refset_id").distinct()


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members per delivery and refset."""
    return tree_count_distinct(_members(spark, d), ["delivery_id", "refset_id"], ["id"], "n_members")


def p3_refsets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members per refset over all deliveries."""
    return tree_count_distinct(_members(spark, d), ["refset_id"], ["id"], "n_members")


def _drift(spark: SparkSession, d: str) -> tuple[schema_drift.Drift, DataFrame]:
    files = table(spark, d, "refset_file").select(F.col("file_id").alias("file"), F.col("refset_id").alias("series"), F.col("release_date").alias("ordering"), F.col("header_columns").alias("header"))
    lines = table(spark, d, "refset_raw_row").select(F.col("file_id").alias("file"), "line_no", "line")
    return schema_drift.find_drift(cut(files), lines.select("file", "line")), lines


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    drift, _ = _drift(spark, d)
    return drift.changes.withColumnRenamed("file", "file_id")


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one consistent table; own fields as name=value in name order."""
    drift, lines = _drift(spark, d)
    rows = schema_drift.unified_rows(lines, cut(schema_drift.lineage(drift)))
    told = F.concat_ws("\t", F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    return rows.withColumnRenamed("file", "file_id").withColumn("fields", told)


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """The consistent fields of each refset with their common type."""
    drift, _ = _drift(spark, d)
    return schema_drift.unified_types(cut(schema_drift.lineage(drift))).withColumnRenamed("series", "refset_id")


def p4_notes(spark: SparkSession, d: str) -> DataFrame:
    """Files whose noted field_list differs from the own fields of their header, or whose repair is not noted."""
    files = table(spark, d, "refset_file")
    named = files.select(F.col("file_id").alias("file"), F.col("header_columns").alias("header"))
    cells = schema_drift.headers(named)
    own = schema_drift.own_columns(cells).groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("own"))
    fixed = schema_drift.repaired(cells).groupBy("file").agg(F.count(F.lit(1)).alias("n_repaired"))
    noted = F.array_sort(F.array_distinct(F.transform("field_list", lambda x: F.lower(F.regexp_replace(x, r"(?U)\s", "")))))
    both = files.select(F.col("file_id").alias("file"), "refset_id", noted.alias("noted"), F.col("header_repair").isNotNull().alias("repair_noted")).join(own, "file", "left").join(fixed, "file", "left")
    stale = F.col("noted").isNull() | ~F.col("noted").eqNullSafe(F.col("own"))
    return both.select(F.col("file").alias("file_id"), "refset_id", F.when(F.col("noted").isNull(), "absent").when(stale, "wrong").otherwise("right").alias("field_list_state"), (F.coalesce("n_repaired", F.lit(0)) > 0).alias("repaired"), "repair_noted")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """(key, at, in_table, delivery_id, record_key, field_name) of all referring rows, copies included."""
    manifest = table(spark, d, "edition_manifest").select("delivery_id", F.col("release_date").alias("at")).filter(F.col("at").isNotNull())
    shape = lambda df, name, record, field, key: df.select(F.lit(name).alias("in_table"), "delivery_id", record.alias("record_key"), F.lit(field).alias("field_name"), key.alias("key"))
    association = table(spark, d, "historical_association").filter("active = 1").select("delivery_id", "id", "referenced_component_id", "target_component_id")
    ends = association.select("delivery_id", F.col("id").alias("record_key"), F.explode(F.create_map(F.lit("referenced_component_id"), F.col("referenced_component_id"), F.lit("target_component_id"), F.col("target_component_id"))).alias("field_name", "key"))
    ends = ends.select(F.lit("historical_association").alias("in_table"), "delivery_id", "record_key", "field_name", "key")
    concept = (F.floor(F.col("referenced_component") / 10) % 100).isin(0, 10)
    identifiers = table(spark, d, "identifier_snapshot").filter(F.col("active") & concept)
    identifiers = shape(identifiers, "identifier_snapshot", F.concat(F.col("scheme").cast("string"), F.lit("#"), F.col("code")), "referenced_component", F.col("referenced_component"))
    declared = table(spark, d, "member_manifest")
    declared = shape(declared, "member_manifest", F.col("refset_id").cast("string"), "refset_id", F.col("refset_id"))
    rows = ends.unionByName(identifiers).unionByName(declared).filter(F.col("key").isNotNull())
    return lookup_join(rows, manifest, ["delivery_id"])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "sct_concept").select("id", "effective_time", "active").unionByName(table(spark, d, "metadata_concept").select("id", "effective_time", "active"))
    found = find_orphans(_references(spark, d), states, "id", "effective_time", "active")
    # an association's own end may well be retired: that is what it records
    return found.filter(~((F.col("field_name") == "referenced_component_id") & (F.col("reason") == "deleted"))).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = cut(_orphans(spark, d))
    month = F.floor(F.col("at") / 100).cast("long").alias("period_ym")
    rows = found.select("in_table", month, "delivery_id", "record_key", "field_name", "reason")
    skipped = found.filter((F.col("in_table") == "historical_association") & F.col("reason").isin("missing", "late")).select("delivery_id", F.col("record_key").alias("id"))
    counted = tree_count_distinct(skipped, ["delivery_id"], ["id"], "n_skipped")
    manifest = table(spark, d, "edition_manifest").filter(F.col("history_skipped").isNotNull()).select("delivery_id", F.col("release_date").alias("at"), "edition", "history_skipped")
    wrong = manifest.join(counted, "delivery_id", "left").filter(F.col("history_skipped") != F.coalesce("n_skipped", F.lit(0)))
    wrong = wrong.select(F.lit("edition_manifest").alias("in_table"), month, "delivery_id", F.col("edition").alias("record_key"), F.lit("history_skipped").alias("field_name"), F.lit("miscounted").alias("reason"))
    return rows.unionByName(wrong).distinct()


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, field, period and reason."""
    month = F.floor(F.col("at") / 100).cast("long").alias("period_ym")
    return _orphans(spark, d).groupBy("in_table", "field_name", month, "reason").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("key").alias("n_keys"))


from .problems_sql import SQL  # noqa: E402

QUERIES = {f.__name__: f for f in (p1_found, p1_deliveries, p2_found, p2_paths, p2_descendants, p3_found, p3_members, p3_refsets, p4_found, p4_rows, p4_fields, p4_notes, p5_found, p5_periods)}

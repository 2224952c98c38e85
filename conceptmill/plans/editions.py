"""Queries over the release tables, and search, labels, history and comparison; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..engine import Engine, diff
from ..sources.release import release_catalog
from ..sources.sinks import labelled_csv
from ..sources.star import cid as C
from ..sources.star import star_catalog
from .expressions import X
from .problems_sql import LINKS

CONCEPT_STATES = """
states AS (SELECT id, coalesce(effective_time, 0) AS t, active, module_id FROM sct_concept UNION SELECT id, coalesce(effective_time, 0), active, module_id FROM metadata_concept),
concepts AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, active DESC) = 1)"""
ATTRIBUTES = """
attributes AS (SELECT * FROM (SELECT DISTINCT * FROM sct_relationship) QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(effective_time, 0) DESC, active DESC) = 1),
rows_ AS (SELECT * FROM attributes WHERE active = 1 AND characteristic_type_id = 900000000000011006 AND type_id <> 116680003)"""
MEMBERS = f"""
{CONCEPT_STATES},
members AS (SELECT * FROM refset_member QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery_id DESC, coalesce(effective_time, 0) DESC, active DESC) = 1),
live AS (SELECT m.* FROM members m WHERE active = 1),
known AS (SELECT l.* FROM live l SEMI JOIN concepts c ON c.id = l.referenced_component_id)"""
TREE = f"WITH RECURSIVE {LINKS}, {CONCEPT_STATES}, down AS (SELECT id AS c FROM concepts WHERE id = 10001785000 UNION SELECT l.child FROM down d JOIN links l ON l.parent = d.c) SELECT c AS concept_id FROM down"

EXPRESSIONS = {
    "rel_descendants": ("<< 10001785000", TREE),
    "rel_attribute": ("* : 770001004 = *", f"WITH {CONCEPT_STATES}, {ATTRIBUTES} SELECT DISTINCT source_id AS concept_id FROM rows_ SEMI JOIN concepts c ON c.id = source_id WHERE type_id = 770001004"),
    "rel_group": ("* : { 770001004 = *, 770002006 = * }", f"WITH {CONCEPT_STATES}, {ATTRIBUTES} SELECT DISTINCT source_id AS concept_id FROM rows_ SEMI JOIN concepts c ON c.id = source_id WHERE relationship_group <> 0 GROUP BY source_id, relationship_group HAVING bool_or(type_id = 770001004) AND bool_or(type_id = 770002006)"),
    "rel_attribute_cardinality": ("* : [2..*] 770001004 = *", f"WITH {CONCEPT_STATES}, {ATTRIBUTES} SELECT source_id AS concept_id FROM rows_ SEMI JOIN concepts c ON c.id = source_id WHERE type_id = 770001004 GROUP BY source_id HAVING count(*) >= 2"),
    "rel_member_of": ("^ 700001005", f"WITH {MEMBERS} SELECT DISTINCT referenced_component_id AS concept_id FROM known WHERE refset_id = 700001005"),
    "rel_member_of_hot": ("^ (700001005 OR 700002003 OR 700003008)", f"WITH {MEMBERS} SELECT DISTINCT referenced_component_id AS concept_id FROM known WHERE refset_id IN (700001005, 700002003, 700003008)"),
    "rel_member_map": ('^ 700002003 {{ M mapGroup = #1, mapTarget = wild:"c*" }}', f"WITH {MEMBERS} SELECT DISTINCT referenced_component_id AS concept_id FROM known WHERE refset_id = 700002003 AND map_group = 1 AND lower(map_target) LIKE 'c%'"),
    "rel_member_targets": ("^ [mapTarget] 700002003", f"WITH {MEMBERS} SELECT DISTINCT CAST(5 AS TINYINT) AS kind, coalesce(map_target, '') AS text FROM live WHERE refset_id = 700002003"),
    "rel_refset_containing": ("^R (* {{ C active = 0 }})", f"WITH {MEMBERS} SELECT DISTINCT refset_id AS concept_id FROM known k SEMI JOIN (SELECT id FROM concepts WHERE active = 0) c ON c.id = k.referenced_component_id SEMI JOIN concepts r ON r.id = k.refset_id"),
    "rel_history": ("(* {{ C active = 1 }}) {{ + HISTORY (740001008 OR 740002001) }}", f"WITH {CONCEPT_STATES}, told AS (SELECT * FROM historical_association QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery_id DESC, coalesce(effective_time, 0) DESC, active DESC) = 1) SELECT id AS concept_id FROM concepts WHERE active = 1 UNION SELECT referenced_component_id FROM told SEMI JOIN (SELECT id FROM concepts WHERE active = 1) c ON c.id = target_component_id SEMI JOIN concepts s ON s.id = referenced_component_id WHERE active = 1 AND refset_id IN (SELECT id FROM concepts) AND refset_id IN (740001008, 740002001)"),
    "rel_concept_filter": ('* {{ C active = 0, effectiveTime >= "20200101" }}', f"WITH {CONCEPT_STATES} SELECT id AS concept_id FROM concepts WHERE active = 0 AND t >= 20200101"),
}
OLD = 20200101


def run(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Engine(release_catalog(spark, d)).evaluate(EXPRESSIONS[name][0]).df

    query.__name__ = name
    return query


def star(spark: SparkSession, d: str) -> Engine:
    return Engine(star_catalog(spark, d))


def search_match(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).search_matches("large bol")


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).search("large bolt", limit=20)


def search_within(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).search("customer 0000001", within=f"< {C(12, 3)}", limit=10).select("concept_id", "display")


def labels(spark: SparkSession, d: str) -> DataFrame:
    engine = star(spark, d)
    return engine.labelled(engine.concepts(f"< {C(15, 13)}"))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    engine = star(spark, d)
    return labelled_csv(engine, engine.evaluate(f"<! {C(11, 1)}"))


def window_of_result(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).evaluate(f"< {C(11, 1)}").window(10, 25)


def history_successors(spark: SparkSession, d: str) -> DataFrame:
    c = star_catalog(spark, d)
    return Engine(c).c.association.select("refset", F.col("source").alias("concept_id"), F.col("target").alias("successor"))


def edition_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff("* {{ C active = 1 }}", Engine(release_catalog(spark, d, OLD)), Engine(release_catalog(spark, d)))


def display_of_all(spark: SparkSession, d: str) -> DataFrame:
    return star_catalog(spark, d).display


def word_index(spark: SparkSession, d: str) -> DataFrame:
    return star_catalog(spark, d).word.join(star(spark, d).concepts(f"< {C(15, 13)}"), "concept_id", "left_semi")


def words_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The word index of every active description."""
    return star_catalog(spark, d).word


def refset_members(spark: SparkSession, d: str) -> DataFrame:
    return release_catalog(spark, d).membership


PART_TERM = "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (part)' END"
PARTS_LIKE = f"SELECT {X(17, 'p_partkey')} AS concept_id, {PART_TERM} AS display FROM part WHERE regexp_matches(lower(p_name), '(^|[^0-9a-z])large($|[^0-9a-z])') AND regexp_matches(lower(p_name), '(^|[^0-9a-z])bol')"
SQL = {name: sql for name, (_, sql) in EXPRESSIONS.items()} | {
    "search_match": f"SELECT concept_id FROM ({PARTS_LIKE})",
    "search_ranked": f"""
WITH hits AS ({PARTS_LIKE.replace("[^0-9a-z])bol", "[^0-9a-z])bolt")}),
short AS (SELECT *, strlen(display) AS size FROM hits ORDER BY size, concept_id LIMIT 400),
scored AS (SELECT *, regexp_extract_all(translate(lower(display), '{fixed.FOLD_FROM}', '{fixed.FOLD_TO}'), '[0-9a-z]+') AS w FROM short),
points AS (
  SELECT concept_id, display, true AS active, size,
    CASE WHEN lower(display) = 'large bolt' THEN 1000 ELSE 0 END + CASE WHEN starts_with(lower(display), 'large bolt') THEN 200 ELSE 0 END
    + CASE WHEN list_position(w, 'large') = 1 THEN 80 WHEN list_position(w, 'large') > 1 THEN 60 WHEN len(list_filter(w, lambda x: starts_with(x, 'large'))) > 0 THEN 25 ELSE 0 END
    + CASE WHEN list_position(w, 'bolt') = 2 THEN 80 WHEN list_position(w, 'bolt') > 0 THEN 60 WHEN len(list_filter(w, lambda x: starts_with(x, 'bolt'))) > 0 THEN 25 ELSE 0 END
    - 3 * greatest(len(w) - 2, 0) AS score FROM scored)
SELECT concept_id, display, active, score FROM points ORDER BY score DESC, size, concept_id LIMIT 20""",
    "search_within": f"""
SELECT {X(13, 'c_custkey')} AS concept_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' (customer)' END AS display
FROM customer WHERE c_nationkey = 3 AND c_name LIKE 'Customer#0000001%' ORDER BY strlen(display), concept_id LIMIT 10""",
    "labels": f"SELECT {X(17, 'p_partkey')} AS concept_id, {PART_TERM} AS display, true AS active FROM part WHERE p_brand = 'Brand#13'",
    "csv_rows": f"SELECT CAST({X(12, 'n_nationkey')} AS VARCHAR) AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' (nation)' END AS display FROM nation WHERE n_regionkey = 1",
    "window_of_result": f"SELECT * FROM (SELECT {X(12, 'n_nationkey')} AS concept_id FROM nation WHERE n_regionkey = 1 UNION SELECT {X(13, 'c_custkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION SELECT {X(14, 's_suppkey')} FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1) ORDER BY 1 LIMIT 25 OFFSET 10",
    "history_successors": f"SELECT CAST({fixed.SAME_AS} AS BIGINT) AS refset, {X(23, 'doc_id')} AS concept_id, {X(23, 'f')} AS successor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f",
    "edition_diff": f"""
WITH {CONCEPT_STATES},
then_ AS (SELECT * FROM states WHERE t <= {OLD} QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, active DESC) = 1),
n AS (SELECT id FROM concepts WHERE active = 1), o AS (SELECT id FROM then_ WHERE active = 1)
SELECT coalesce(n.id, o.id) AS concept_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM n FULL JOIN o ON n.id = o.id""",
    "word_index": f"SELECT DISTINCT {X(17, 'p_partkey')} AS concept_id, unnest(regexp_extract_all(lower(p_name || ' (part)'), '[0-9a-z]+')) AS word FROM part WHERE p_brand = 'Brand#13'",
    "words_of_all": f"""
WITH terms AS (
  SELECT {X(17, 'p_partkey')} AS concept_id, p_name || ' (part)' AS term FROM part UNION ALL SELECT {X(13, 'c_custkey')}, c_name || ' (customer)' FROM customer
  UNION ALL SELECT {X(12, 'n_nationkey')}, n_name || ' (nation)' FROM nation UNION ALL SELECT {X(11, 'r_regionkey')}, r_name || ' (region)' FROM region
  UNION ALL SELECT {X(23, 'doc_id')}, title FROM documents WHERE coalesce(title, '') <> '' AND coalesce(rating <> 1, false))
SELECT DISTINCT concept_id, unnest(regexp_extract_all(translate(lower(term), '{fixed.FOLD_FROM}', '{fixed.FOLD_TO}'), '[0-9a-z]+')) AS word FROM terms""",
    "refset_members": f"WITH {MEMBERS} SELECT DISTINCT refset_id AS refset, referenced_component_id AS member FROM known",
    "display_of_all": f"SELECT {X(17, 'p_partkey')} AS concept_id, {PART_TERM} AS term FROM part UNION ALL SELECT {X(13, 'c_custkey')}, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' (customer)' END FROM customer UNION ALL SELECT {X(12, 'n_nationkey')}, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' (nation)' END FROM nation UNION ALL SELECT {X(11, 'r_regionkey')}, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE r_name || ' (region)' END FROM region UNION ALL SELECT {X(23, 'doc_id')}, title FROM documents WHERE coalesce(title, '') <> '' AND coalesce(rating <> 1, false) AND CASE WHEN regexp_full_match(lower(lang), '[a-z]{{2}}') THEN lower(lang) ELSE 'en' END = 'en'",
}
QUERIES = {name: run(name) for name in EXPRESSIONS} | {f.__name__: f for f in (search_match, search_ranked, search_within, labels, csv_rows, window_of_result, history_successors, edition_diff, display_of_all, word_index, words_of_all, refset_members)}

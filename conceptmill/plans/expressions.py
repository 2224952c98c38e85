"""Expressions over the star terminology, each with SQL on the raw tables that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.star import cid as C
from ..sources.star import star_catalog

IS_A = 116680003
ORDERS, GEO = "(< {} OR < {} OR < {})".format(C(18, 0), C(18, 1), C(18, 2)), C(10, 1)
BY, PART, SUPP, QTY, PRICE, DISC, TAX, FLAG, LSTAT, URGENT = (C(30, k) for k in range(1, 11))
EV, REV, BUY = C(31, 1), C(31, 2), C(31, 3)


def X(c: int, key: str) -> str:
    """The concept id as SQL."""
    return f"(({c}000000000 + CAST({key} AS BIGINT)) * 1000)"


# links of the terminology on the raw tables
EDGES = f"""
types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part)),
stat AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS k FROM (SELECT DISTINCT o_orderstatus FROM orders)),
src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
edges AS (
  SELECT {X(11, 'r_regionkey')} AS c, CAST({C(10, 1)} AS BIGINT) AS p FROM region
  UNION SELECT {X(12, 'n_nationkey')}, {X(11, 'n_regionkey')} FROM nation
  UNION SELECT {X(13, 'c_custkey')}, {X(12, 'c_nationkey')} FROM customer
  UNION SELECT {X(14, 's_suppkey')}, {X(12, 's_nationkey')} FROM supplier
  UNION SELECT {X(15, "split_part(p_brand, '#', 2)")}, {C(10, 8)} FROM part
  UNION SELECT {X(16, 'k')}, {C(10, 9)} FROM types
  UNION SELECT {X(17, 'p_partkey')}, {X(15, "split_part(p_brand, '#', 2)")} FROM part
  UNION SELECT {X(17, 'p_partkey')}, {X(16, 'k')} FROM part JOIN types USING (p_type)
  UNION SELECT {X(18, 'k')}, {C(10, 10)} FROM stat
  UNION SELECT {X(19, 'left(o_orderpriority, 1)')}, {C(10, 11)} FROM orders
  UNION SELECT {X(20, 'o_orderkey')}, {X(18, 'k')} FROM orders JOIN stat USING (o_orderstatus)
  UNION SELECT {X(20, 'o_orderkey')}, {X(19, 'left(o_orderpriority, 1)')} FROM orders
  UNION SELECT {X(22, 'k')}, {C(10, 4)} FROM src
  UNION SELECT {X(23, 'd.doc_id')}, {X(22, 'k')} FROM documents d JOIN src USING (source) JOIN firsts f ON f.doc_id = d.doc_id AND f.first = d.doc_id
  UNION SELECT {X(24, 'user_id')}, {C(10, 12)} FROM events)"""


def below(seed: str, proper: bool = True) -> str:
    """SQL of the descendants of the ids that ``seed`` selects."""
    down = f"WITH RECURSIVE {EDGES}, down AS (SELECT e.c AS id FROM edges e WHERE e.p IN ({seed}) UNION SELECT e.c FROM edges e JOIN down d ON e.p = d.id) SELECT id AS concept_id FROM down"
    return down if proper else down + f" UNION SELECT * FROM ({seed}) s(concept_id)"


def above(seed: str, proper: bool = True) -> str:
    up = f"WITH RECURSIVE {EDGES}, top AS (SELECT CAST({C(10, 0)} AS BIGINT) AS root), links AS (SELECT * FROM edges UNION SELECT DISTINCT p, root FROM edges, top WHERE p BETWEEN {C(10, 1)} AND {C(10, 13)}), up AS (SELECT e.p AS id FROM links e WHERE e.c IN ({seed}) UNION SELECT e.p FROM links e JOIN up u ON e.c = u.id) SELECT id AS concept_id FROM up"
    return up if proper else up + f" UNION SELECT * FROM ({seed}) s(concept_id)"


def edges(select: str) -> str:
    return f"WITH {EDGES} {select}"


O = X(20, "o_orderkey")  # noqa: E741
L = X(20, "l_orderkey")
P13 = "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'"
N3 = "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3"
BRAND13, NATION3, REGION1, CUST = C(15, 13), C(12, 3), C(11, 1), C(13, 7)
HAS13 = f"{PART} = << {BRAND13}"
FROM3 = f"{SUPP} = << {NATION3}"
ALL_ORDERS = f"SELECT {O} AS concept_id FROM orders"


def lines(test: str) -> str:
    return f"SELECT DISTINCT {L} AS concept_id FROM lineitem WHERE {test}"


DEC = lambda c: f"CAST({c} AS DECIMAL(18,2))"
NUM = lambda c: f"regexp_replace(regexp_replace(CAST({DEC(c)} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
CUSTOMER_TERMS = "SELECT c_custkey AS k, 13 AS c, c_name AS term FROM customer UNION ALL SELECT p_partkey, 17, p_name FROM part UNION ALL SELECT n_nationkey, 12, n_name FROM nation UNION ALL SELECT r_regionkey, 11, r_name FROM region"
DOCS = f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents"
ACTIVE_TITLES = "coalesce(title, '') <> '' AND coalesce(rating <> 1, false)"
LANG = "CASE WHEN regexp_full_match(lower(lang), '[a-z]{2}') THEN lower(lang) ELSE 'en' END"

# name: (expression, SQL)
CONCEPTS: dict[str, tuple[str, str]] = {
    # hierarchy
    "ecl_descendants": (f"<< {REGION1}", below(f"SELECT {REGION1}", False)),
    "ecl_strict_descendants": (f"< {REGION1} |region|", below(f"SELECT {REGION1}")),
    "ecl_ancestors": (f"ancestorOf {C(13, 7)}", above(f"SELECT {C(13, 7)}")),
    "ecl_ancestors_or_self": (f">> {C(17, 11)}", above(f"SELECT {C(17, 11)}", False)),
    "ecl_children": (f"<! {NATION3}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {NATION3}")),
    "ecl_children_or_self": (f"childOrSelfOf {NATION3}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {NATION3} UNION SELECT {NATION3}")),
    "ecl_parents": (f">! {C(20, 5)}", edges(f"SELECT p AS concept_id FROM edges WHERE c = {C(20, 5)}")),
    "ecl_parents_or_self": (f">>! {C(20, 5)}", edges(f"SELECT p AS concept_id FROM edges WHERE c = {C(20, 5)} UNION SELECT {C(20, 5)}")),
    "ecl_nested_hierarchy": (f">! (<! {BRAND13})", edges(f"SELECT DISTINCT p AS concept_id FROM edges WHERE c IN (SELECT c FROM edges WHERE p = {BRAND13})")),
    "ecl_seed_set_descendants": (f"< ({REGION1} OR {NATION3} OR {C(12, 4)})", below(f"SELECT unnest([{REGION1}, {NATION3}, {C(12, 4)}])")),
    "ecl_unknown_literal": (f"<< 99999999999 OR {NATION3}", f"SELECT CAST({NATION3} AS BIGINT) AS concept_id"),
    "ecl_top": (f"!!> (<< {REGION1} MINUS {REGION1})", f"SELECT {X(12, 'n_nationkey')} AS concept_id FROM nation WHERE n_regionkey = 1"),
    "ecl_bottom": (f"bottom (<< {GEO})", edges(f"SELECT DISTINCT c AS concept_id FROM edges WHERE c // 1000000000000 IN (11, 12, 13, 14) AND c NOT IN (SELECT p FROM edges)")),
    # sets
    "ecl_union": (f"<< {BRAND13} OR << {C(16, 2)}", edges(f"SELECT DISTINCT c AS concept_id FROM edges WHERE p IN ({BRAND13}, {C(16, 2)}) UNION SELECT unnest([{BRAND13}, {C(16, 2)}])")),
    "ecl_intersection": (f"<< {BRAND13} AND << {C(16, 2)}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {BRAND13} INTERSECT SELECT c FROM edges WHERE p = {C(16, 2)}")),
    "ecl_exclusion": (f"< {BRAND13} MINUS << {C(16, 2)}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {BRAND13} EXCEPT SELECT c FROM edges WHERE p = {C(16, 2)}")),
    "ecl_comma_conjunction": (f"< {GEO}, << {NATION3}, <! {NATION3}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {NATION3}")),
    "ecl_wildcard_minus": (f"* MINUS (<< {C(10, 0)})", f"SELECT {X(23, 'doc_id')} AS concept_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f"),
    "ecl_identifier": ('"demo#Customer#000000007"', f"SELECT {X(13, 'c_custkey')} AS concept_id FROM customer WHERE c_name = 'Customer#000000007'"),
    # refinements
    "ecl_attribute_equality": (f"{ORDERS} : {BY} = << {NATION3}", f"SELECT {O} AS concept_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3"),
    "ecl_attribute_inequality": (f"{ORDERS} : {PART} != << {BRAND13}", lines(f"l_partkey NOT IN ({P13})")),
    "ecl_any_value": (f"* : {PART} = *", lines("true")),
    "ecl_not_any_value": (f"* : {PART} != *", "SELECT CAST(0 AS BIGINT) AS concept_id WHERE false"),
    "ecl_nested_value": (f"* : {PART} = (<< {BRAND13} AND << {C(16, 2)})", f"WITH {EDGES} SELECT DISTINCT {L} AS concept_id FROM lineitem JOIN edges a ON a.c = {X(17, 'l_partkey')} AND a.p = {BRAND13} JOIN edges b ON b.c = a.c AND b.p = {C(16, 2)}"),
    "ecl_wildcard_name": (f"* : * = {C(13, 7)}", f"SELECT {O} AS concept_id FROM orders WHERE o_custkey = 7"),
    "ecl_name_set": (f"{ORDERS} : ({PART} OR {SUPP}) = (<< {BRAND13} OR << {NATION3})", lines(f"l_partkey IN ({P13}) OR l_suppkey IN ({N3})")),
    "ecl_isa_attribute": (f"* : {IS_A} = {NATION3}", edges(f"SELECT c AS concept_id FROM edges WHERE p = {NATION3}")),
    "ecl_attribute_cardinality": (f"{ORDERS} : [2..3] {HAS13}", f"SELECT {L} AS concept_id FROM lineitem WHERE l_partkey IN ({P13}) GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 3"),
    "ecl_cardinality_zero": (f"{ORDERS} : [0..0] {PART} = *", f"SELECT {O} AS concept_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "ecl_cardinality_at_most": (f"{ORDERS} : [0..2] {PART} = *", f"SELECT {O} AS concept_id FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) <= 2"),
    "ecl_group": (f"{ORDERS} : {{ {HAS13}, {FROM3} }}", f"SELECT {L} AS concept_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_or(l_partkey IN ({P13})) AND bool_or(l_suppkey IN ({N3}))".replace("SELECT", "SELECT DISTINCT", 1)),
    "ecl_group_cardinality": (f"{ORDERS} : [2..*] {{ {HAS13} }}", f"SELECT {L} AS concept_id FROM lineitem WHERE l_partkey IN ({P13}) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 2"),
    "ecl_group_without": (f"{ORDERS} : {{ [0..0] {HAS13} }}", f"SELECT DISTINCT {L} AS concept_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING NOT bool_or(l_partkey IN ({P13}))"),
    "ecl_no_group": (f"{ORDERS} : [0..0] {{ {HAS13} }}", f"SELECT {O} AS concept_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN ({P13}))"),
    "ecl_group_disjunction": (f"{ORDERS} : {{ {HAS13} OR {FROM3} }}", lines(f"l_partkey IN ({P13}) OR l_suppkey IN ({N3})")),
    "ecl_group_with_concrete": (f"* : {{ {HAS13}, {QTY} >= #40 }}", f"SELECT DISTINCT {L} AS concept_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_or(l_partkey IN ({P13})) AND bool_or({DEC('l_quantity')} >= 40)"),
    "ecl_refinement_conjunction": (f"{ORDERS} : {HAS13}, {FROM3}", f"{lines(f'l_partkey IN ({P13})')} INTERSECT {lines(f'l_suppkey IN ({N3})')}"),
    "ecl_refinement_disjunction": (f"{ORDERS} : ({HAS13} AND {FROM3}) OR [0..0] {PART} = *", f"({lines(f'l_partkey IN ({P13})')} INTERSECT {lines(f'l_suppkey IN ({N3})')}) UNION SELECT {O} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "ecl_reverse": (f"* : R {BY} = << {C(19, 1)}", f"SELECT DISTINCT {X(13, 'o_custkey')} AS concept_id FROM orders WHERE o_orderpriority LIKE '1%'"),
    "ecl_reverse_cardinality": (f"< {BRAND13} : [3..*] R {PART} = {ORDERS}", f"SELECT {X(17, 'l_partkey')} AS concept_id FROM lineitem WHERE l_partkey IN ({P13}) GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 3"),
    "ecl_reverse_inequality": (f"< {NATION3} : reverseOf {BY} != << {C(19, 1)}", f"SELECT DISTINCT {X(13, 'o_custkey')} AS concept_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderpriority NOT LIKE '1%'"),
    "ecl_concrete_greater": (f"* : {PRICE} > #90000.50", lines(f"{DEC('l_extendedprice')} > 90000.50")),
    "ecl_concrete_not_equal": (f"* : {QTY} != #1", lines(f"{DEC('l_quantity')} <> 1")),
    "ecl_concrete_between": (f"* : {{ {DISC} >= #0.05, {DISC} <= #0.070, {TAX} < #+0.02 }}", f"SELECT DISTINCT {L} AS concept_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING bool_or({DEC('l_discount')} >= 0.05) AND bool_or({DEC('l_discount')} <= 0.07) AND bool_or({DEC('l_tax')} < 0.02)"),
    "ecl_concrete_text_set": (f'* : {FLAG} = ("R" "A"), {LSTAT} != "O"', f"{lines('l_returnflag IN (' + chr(39) + 'R' + chr(39) + ', ' + chr(39) + 'A' + chr(39) + ')')} INTERSECT {lines('l_linestatus <> ' + chr(39) + 'O' + chr(39))}"),
    "ecl_concrete_boolean": (f"{ORDERS} : {URGENT} = true", f"SELECT {O} AS concept_id FROM orders WHERE o_orderpriority LIKE '1%'"),
    # dotted
    "ecl_dotted": (f"(<< {C(19, 1)}) . {BY}", f"SELECT DISTINCT {X(13, 'o_custkey')} AS concept_id FROM orders WHERE o_orderpriority LIKE '1%'"),
    "ecl_dotted_chain": (f"(<< {C(19, 1)}) . {BY} . {IS_A}", f"SELECT DISTINCT {X(12, 'c_nationkey')} AS concept_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%'"),
    # membership
    "ecl_member_of": (f"^ {REV}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE rating IS NOT NULL AND source IS NOT NULL"),
    "ecl_refset_containing": (f"^R {C(24, 3)}", f"SELECT DISTINCT CAST({EV} AS BIGINT) AS concept_id FROM events WHERE user_id = 3 AND event_type <> 'error'"),
    "ecl_member_filter": (f'^ {EV} {{{{ M value >= #40, eventType = wild:"pur*" }}}}', f"SELECT DISTINCT {X(24, 'user_id')} AS concept_id FROM events WHERE event_type <> 'error' AND {DEC('value')} >= 40 AND event_type LIKE 'pur%'"),
    "ecl_member_blocks_merge": (f'^ {EV} {{{{ M value < #5 }}}} {{{{ M eventType = "click" }}}}', f"SELECT DISTINCT {X(24, 'user_id')} AS concept_id FROM events WHERE {DEC('value')} < 5 AND event_type = 'click'"),
    "ecl_member_inactive": (f"^ {EV} {{{{ M active = 0 }}}}", f"SELECT DISTINCT {X(24, 'user_id')} AS concept_id FROM events WHERE event_type = 'error'"),
    "ecl_member_any_status": (f'^ {EV} {{{{ M active = "*", eventDate >= "20240103" }}}}', f"SELECT DISTINCT {X(24, 'user_id')} AS concept_id FROM events WHERE strftime(ts, '%Y%m%d') >= '20240103'"),
    "ecl_member_boolean": (f"^ {REV} {{{{ M verified = true, rating != #5 }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE rating IS NOT NULL AND rating <> 5 AND verified AND source IS NOT NULL"),
    "ecl_member_concept_field": (f"^ {BUY} {{{{ M targetComponentId = << {NATION3} }}}}", f"SELECT {O} AS concept_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3"),
    "ecl_member_dates": (f'^ {REV} {{{{ M reviewedOn = ("20230721" "20230126"), reviewedOn != "" }}}}', f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE rating IS NOT NULL AND review_date IN ('2023-07-21', '2023-01-26')"),
    "ecl_reverse_members_filtered": (f"^R {C(24, 3)} {{{{ M active = 0 }}}}", f"SELECT DISTINCT CAST({EV} AS BIGINT) AS concept_id FROM events WHERE user_id = 3 AND event_type = 'error'"),
    "ecl_member_projection_concepts": (f"^ [targetComponentId] {BUY} {{{{ M effectiveTime >= \"19970101\" }}}}", f"SELECT DISTINCT {X(13, 'o_custkey')} AS concept_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    "ecl_hierarchy_of_members": (f"> ^ {EV}", f"SELECT unnest([CAST({C(10, 12)} AS BIGINT), {C(10, 0)}]) AS concept_id"),
    # concept and description filters
    "ecl_concept_filter_time": (f'{ORDERS} {{{{ C effectiveTime >= "19950101" }}}}', f"SELECT {O} AS concept_id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'"),
    "ecl_concept_filter_empty_time": (f'<< {REGION1} {{{{ C effectiveTime = "" }}}}', below(f"SELECT {REGION1}", False)),
    "ecl_concept_filter_active": (f"* {{{{ C active = 0 }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f"),
    "ecl_concept_filter_status": (f"{ORDERS} {{{{ C definitionStatus = defined }}}}", f"SELECT {O} AS concept_id FROM orders WHERE o_orderpriority LIKE '1%'"),
    "ecl_concept_filter_status_id": (f"{ORDERS} {{{{ C definitionStatusId != 900000000000073002 }}}}", f"SELECT {O} AS concept_id FROM orders WHERE o_orderpriority NOT LIKE '1%'"),
    "ecl_concept_filter_module": (f"{ORDERS} {{{{ C moduleId = ({C(32, 0)} {C(32, 2)}) }}}}", f"WITH {EDGES} SELECT {O} AS concept_id FROM orders JOIN stat USING (o_orderstatus) WHERE k % 3 IN (0, 2)"),
    "ecl_description_language": (f"* {{{{ D language = (de fr) }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE {ACTIVE_TITLES} AND {LANG} IN ('de', 'fr') AND source IS NOT NULL"),
    "ecl_description_type_not": (f"<< {REGION1} {{{{ type != syn }}}}", f"SELECT {X(11, 'r_regionkey')} AS concept_id FROM region WHERE r_regionkey = 1 UNION SELECT {X(12, 'n_nationkey')} FROM nation WHERE n_regionkey = 1 UNION SELECT {X(13, 'c_custkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1"),
    "ecl_description_inactive": (f"* {{{{ D active = 0 }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE coalesce(title, '') <> '' AND NOT coalesce(rating <> 1, false) AND source IS NOT NULL"),
    "ecl_description_dialect": (f"< {BRAND13} {{{{ type = syn, dialect = en-gb (prefer) }}}}", f"SELECT {X(17, 'p_partkey')} AS concept_id FROM part WHERE p_brand = 'Brand#13' AND p_partkey % 2 = 0"),
    "ecl_description_id": (f"* {{{{ D id = ({C(17, 3) + 10} {C(17, 4) + 110}) }}}}", f"SELECT unnest([CAST({C(17, 3)} AS BIGINT), {C(17, 4)}]) AS concept_id"),
    "ecl_term_prefix": (f'* {{{{ term = "cust 0000001" }}}} AND < {GEO}', f"SELECT {X(13, 'c_custkey')} AS concept_id FROM customer WHERE c_name LIKE 'Customer#0000001%'"),
    "ecl_term_words": (f'* {{{{ term = "bol lar" }}}}', f"SELECT {X(17, 'p_partkey')} AS concept_id FROM part WHERE regexp_matches(lower(p_name), '(^|[^0-9a-z])bol') AND regexp_matches(lower(p_name), '(^|[^0-9a-z])lar')"),
    "ecl_term_wild": (f'< {BRAND13} {{{{ D term = wild:"*bolt", type = syn }}}}', f"SELECT {X(17, 'p_partkey')} AS concept_id FROM part WHERE p_brand = 'Brand#13' AND lower(p_name) LIKE '%bolt'"),
    "ecl_term_set": (f'< {BRAND13} {{{{ term = ("nut" wild:"large*"), type = syn }}}}', f"SELECT {X(17, 'p_partkey')} AS concept_id FROM part WHERE p_brand = 'Brand#13' AND (regexp_matches(lower(p_name), '(^|[^0-9a-z])nut') OR lower(p_name) LIKE 'large%')"),
    # history
    "ecl_history_min": (f"(<< {C(10, 4)}) {{{{ + HISTORY-MIN }}}}", edges(f"SELECT {X(23, 'd.doc_id')} AS concept_id FROM documents d JOIN firsts f USING (doc_id) JOIN documents o ON o.doc_id = f.first WHERE o.source IS NOT NULL UNION SELECT {X(22, 'k')} FROM src UNION SELECT CAST({C(10, 4)} AS BIGINT)")),
    "ecl_history_mod": (f"{C(23, 1)} {{{{ +HISTORY_MOD }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 1)"),
    "ecl_history_max": (f"{C(23, 1)} {{{{ +HISTORY }}}}", f"SELECT {X(23, 'doc_id')} AS concept_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 1)"),
    "ecl_history_subset": (f"(<< {C(10, 4)}) {{{{ + HISTORY (900000000000526001) }}}}", below(f"SELECT {C(10, 4)}", False)),
}

TYPED = "SELECT CAST(0 AS TINYINT) AS kind"
VALUES: dict[str, tuple[str, str]] = {
    "ecl_dotted_typed": (f"(<< {C(19, 1)}) . ({PART} OR {QTY})", f"SELECT DISTINCT CAST(0 AS TINYINT) AS kind, CAST({X(17, 'l_partkey')} AS VARCHAR) AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%' UNION SELECT DISTINCT CAST(2 AS TINYINT), {NUM('l_quantity')} FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'"),
    "ecl_member_projection_numbers": (f"^ [value] {EV}", f"SELECT DISTINCT CAST(2 AS TINYINT) AS kind, {NUM('value')} AS text FROM events WHERE event_type <> 'error'"),
    "ecl_member_projection_dates": (f"^ [reviewedOn] {REV}", "SELECT DISTINCT CAST(4 AS TINYINT) AS kind, coalesce(strftime(review_date, '%Y%m%d'), '') AS text FROM documents WHERE rating IS NOT NULL"),
    "ecl_typed_intersection": (f"(^ [value] {EV} {{{{ M eventType = \"click\" }}}}) AND (^ [value] {EV} {{{{ M eventType = \"view\" }}}})", f"SELECT CAST(2 AS TINYINT) AS kind, {NUM('value')} AS text FROM events WHERE event_type = 'click' INTERSECT SELECT CAST(2 AS TINYINT), {NUM('value')} FROM events WHERE event_type = 'view'"),
    "ecl_typed_union_with_concepts": (f"(^ [rating] {REV}) OR {NATION3}", f"SELECT DISTINCT CAST(2 AS TINYINT) AS kind, CAST(rating AS VARCHAR) AS text FROM documents WHERE rating IS NOT NULL UNION SELECT CAST(0 AS TINYINT), '{NATION3}'"),
    "ecl_typed_difference": (f"(^ [eventType] {EV}) MINUS (^ [eventType] {EV} {{{{ M eventType = \"click\" }}}})", f"SELECT CAST(5 AS TINYINT) AS kind, event_type AS text FROM events WHERE event_type <> 'error' EXCEPT SELECT CAST(5 AS TINYINT), 'click'"),
}
ROWS: dict[str, tuple[str, str]] = {
    "ecl_member_rows": (f"^ [referencedComponentId, eventType, value] {EV} {{{{ M value > #10 }}}}", f"SELECT CAST({X(24, 'user_id')} AS VARCHAR) AS \"referencedComponentId\", event_type AS \"eventType\", CAST({DEC('value')} AS VARCHAR) AS value FROM events WHERE event_type <> 'error' AND {DEC('value')} > 10"),
    "ecl_member_all_fields": (f"^ [*] {BUY}", f"SELECT CAST({O} AS VARCHAR) AS \"referencedComponentId\", CAST({X(13, 'o_custkey')} AS VARCHAR) AS \"targetComponentId\" FROM orders"),
}
EXPRESSIONS = CONCEPTS | VALUES | ROWS


def run(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Engine(star_catalog(spark, d)).evaluate(EXPRESSIONS[name][0]).df

    query.__name__ = name
    return query


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run("ecl_group")(spark, d)


#: Expressions of the corpus that is counted as one plan.
CORPUS = {name: x for name, (x, _) in CONCEPTS.items() if name.split("_")[1] in ("descendants", "strict", "ancestors", "children", "parents", "union", "intersection", "exclusion", "attribute", "any", "group", "reverse", "concrete", "member", "concept", "term")}


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of concepts of every expression of the corpus; one without concepts has no row."""
    return Engine(star_catalog(spark, d)).evaluate_many(CORPUS).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """The number of concepts of every concept expression; one without concepts has no row."""
    return Engine(star_catalog(spark, d)).evaluate_many({name: x for name, (x, _) in CONCEPTS.items()}).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {name: run(name) for name in EXPRESSIONS} | {"corpus_counts": corpus_counts, "corpus_counts_all": corpus_counts_all}
SQL = {name: sql for name, (_, sql) in EXPRESSIONS.items()}
SQL["corpus_counts"] = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({CONCEPTS[name][1]}) HAVING count(*) > 0" for name in CORPUS)
SQL["corpus_counts_all"] = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({sql}) HAVING count(*) > 0" for name, (_, sql) in CONCEPTS.items())

"""A terminology made of the star-schema tables, with ids that plain SQL can reproduce.

``cid(c, k) = (c * 10^9 + k) * 1000`` is the concept of key k in class c. Classes: 10 roots, 11 region, 12 nation,
13 customer, 14 supplier, 15 brand, 16 part type, 17 part, 18 order status, 19 order priority, 20 order,
22 document source, 23 document, 24 event user, 30 attributes, 31 reference sets, 32 modules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..catalog import Catalog, Config
from ..functions import decimals
from ..session import cut
from .tables import table

ROOT, GEOGRAPHY, PARTS, ORDERS, DOCUMENTS, ATTRIBUTES, REFSETS, MODULES, BRANDS, TYPES, STATUSES, PRIORITIES, USERS, METADATA = range(14)
ORDERED_BY, HAS_PART, HAS_SUPPLIER, QUANTITY, PRICE, DISCOUNT, TAX, RETURN_FLAG, LINE_STATUS, URGENT = range(1, 11)
EVENTS, REVIEWS, BUYERS = 1, 2, 3
SCHEME = 21


def cid(c: int, k: int) -> int:
    return (c * 1_000_000_000 + k) * 1000


def col_id(c: int, key: Column) -> Column:
    return ((F.lit(c * 1_000_000_000).cast("bigint") + key.cast("bigint")) * 1000).alias("concept_id")


ASSOCIATION_REFSETS = [fixed.SAME_AS, fixed.REPLACED_BY, fixed.WAS_A, fixed.MOVED_TO, fixed.MOVED_FROM]
METADATA_IDS = [fixed.IS_A, fixed.PRIMITIVE, fixed.DEFINED, fixed.FSN, fixed.SYNONYM, fixed.DEFINITION, fixed.PREFERRED, fixed.ACCEPTABLE, fixed.ASSOCIATIONS, fixed.GB_ENGLISH, fixed.US_ENGLISH]


class Star:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.d = spark, directory

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    def part_types(self) -> DataFrame:
        """(p_type, k): numbered in order; types are a few hundred, so one window over the distinct ones."""
        return self.t("part").select("p_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_type")) - 1)

    def statuses(self) -> DataFrame:
        return self.t("orders").select("o_orderstatus").distinct().withColumn("k", F.row_number().over(Window.orderBy("o_orderstatus")) - 1)

    def sources(self) -> DataFrame:
        return self.t("documents").select("source").distinct().filter("source IS NOT NULL").withColumn("k", F.row_number().over(Window.orderBy("source")) - 1)

    def first_copies(self) -> DataFrame:
        """(doc_id, first): the least document with the same text."""
        docs = self.t("documents").select("doc_id", F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2"))
        firsts = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        return docs.join(firsts, ["h1", "h2"]).select("doc_id", "first")

    def brand(self) -> Column:
        return F.substring_index("p_brand", "#", -1).cast("int")

    def isa(self) -> DataFrame:
        link = lambda df, c, p: df.select(c.alias("child"), p.alias("parent"))
        const = lambda i: F.lit(i).cast("bigint")
        fixed_links = [(cid(10, k), cid(10, ROOT)) for k in range(1, 14)] + [(i, cid(10, METADATA)) for i in METADATA_IDS] + [(i, fixed.ASSOCIATIONS) for i in ASSOCIATION_REFSETS]
        fixed_links += [(cid(30, k), cid(10, ATTRIBUTES)) for k in range(1, 11)] + [(cid(31, k), cid(10, REFSETS)) for k in range(1, 4)] + [(cid(32, k), cid(10, MODULES)) for k in range(4)]
        part = self.t("part").select("p_partkey", "p_type", self.brand().alias("b"))
        orders = self.t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
        by_status = orders.join(F.broadcast(self.statuses()), "o_orderstatus")
        docs = self.t("documents").select("doc_id", "source").join(self.first_copies().filter("doc_id = first"), "doc_id").join(F.broadcast(self.sources()), "source")
        return reduce(
            DataFrame.unionByName,
            [
                self.spark.createDataFrame(fixed_links, "child bigint, parent bigint"),
                link(self.t("region"), col_id(11, F.col("r_regionkey")), const(cid(10, GEOGRAPHY))),
                link(self.t("nation"), col_id(12, F.col("n_nationkey")), col_id(11, F.col("n_regionkey"))),
                link(self.t("customer"), col_id(13, F.col("c_custkey")), col_id(12, F.col("c_nationkey"))),
                link(self.t("supplier"), col_id(14, F.col("s_suppkey")), col_id(12, F.col("s_nationkey"))),
                link(part.select("b").distinct(), col_id(15, F.col("b")), const(cid(10, BRANDS))),
                link(self.part_types(), col_id(16, F.col("k")), const(cid(10, TYPES))),
                link(part, col_id(17, F.col("p_partkey")), col_id(15, F.col("b"))),
                link(part.join(F.broadcast(self.part_types()), "p_type"), col_id(17, F.col("p_partkey")), col_id(16, F.col("k"))),
                link(self.statuses(), col_id(18, F.col("k")), const(cid(10, STATUSES))),
                link(orders.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("p")).distinct(), col_id(19, F.col("p")), const(cid(10, PRIORITIES))),
                link(by_status, col_id(20, F.col("o_orderkey")), col_id(18, F.col("k"))),
                link(orders, col_id(20, F.col("o_orderkey")), col_id(19, F.substring("o_orderpriority", 1, 1).cast("int"))),
                link(self.sources(), col_id(22, F.col("k")), const(cid(10, DOCUMENTS))),
                link(docs, col_id(23, F.col("doc_id")), col_id(22, F.col("k"))),
                link(self.t("events").select("user_id").distinct(), col_id(24, F.col("user_id")), const(cid(10, USERS))),
            ],
        ).distinct()

    def concept(self) -> DataFrame:
        """Every end of a link, the root and the inactive copies of documents; orders carry their own date, module and status."""
        isa = self.isa_table()
        ends = isa.select(F.col("child").alias("concept_id")).unionByName(isa.select(F.col("parent").alias("concept_id"))).distinct()
        orders = self.t("orders").join(F.broadcast(self.statuses()), "o_orderstatus").select(col_id(20, F.col("o_orderkey")), col_id(32, F.col("k") % 3).alias("module_id"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("effective_time"), F.lit(True).alias("active"), F.col("o_orderpriority").startswith("1").alias("defined"))
        ends = ends.withColumn("c", F.floor(F.col("concept_id") / 10**12)).filter("c <> 20")
        plain = ends.select("concept_id", F.lit(cid(32, 3)).cast("bigint").alias("module_id"), F.lit(None).cast("int").alias("effective_time"), F.lit(True).alias("active"), F.col("c").isin(13, 17).alias("defined"))
        copies = self.first_copies().filter("doc_id <> first").select(col_id(23, F.col("doc_id")), F.lit(cid(32, 3)).cast("bigint").alias("module_id"), F.lit(None).cast("int").alias("effective_time"), F.lit(False).alias("active"), F.lit(False).alias("defined"))
        return plain.unionByName(orders).unionByName(copies)

    def isa_table(self) -> DataFrame:
        if not hasattr(self, "_isa"):
            self._isa = cut(self.isa())
        return self._isa

    def relationship(self) -> DataFrame:
        orders, lines = self.t("orders"), self.t("lineitem")
        row = lambda df, s, g, k, target: df.select(s.alias("source"), g.cast("int").alias("grp"), F.lit(cid(30, k)).cast("bigint").alias("type"), target.alias("target"))
        order = col_id(20, F.col("l_orderkey"))
        return reduce(DataFrame.unionByName, [
            row(orders, col_id(20, F.col("o_orderkey")), F.lit(0), ORDERED_BY, col_id(13, F.col("o_custkey"))),
            row(lines, order, F.col("l_linenumber"), HAS_PART, col_id(17, F.col("l_partkey"))),
            row(lines, order, F.col("l_linenumber"), HAS_SUPPLIER, col_id(14, F.col("l_suppkey"))),
        ])

    def concrete(self) -> DataFrame:
        orders, lines = self.t("orders"), self.t("lineitem")

        def row(df, source, grp, k, kind, text):
            canon = decimals.canonical_column(text) if kind == "number" else text
            key = decimals.key_column(canon) if kind == "number" else F.lit(None).cast("string")
            return df.select(source.alias("source"), grp.cast("int").alias("grp"), F.lit(cid(30, k)).cast("bigint").alias("type"), F.lit(kind).alias("kind"), canon.alias("canon"), key.alias("num_key"))

        order, line = col_id(20, F.col("l_orderkey")), F.col("l_linenumber")
        exact = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
        numbers = [row(lines, order, line, k, "number", exact(c)) for k, c in ((QUANTITY, "l_quantity"), (PRICE, "l_extendedprice"), (DISCOUNT, "l_discount"), (TAX, "l_tax"))]
        texts = [row(lines, order, line, k, "text", F.col(c)) for k, c in ((RETURN_FLAG, "l_returnflag"), (LINE_STATUS, "l_linestatus"))]
        urgent = row(orders, col_id(20, F.col("o_orderkey")), F.lit(0), URGENT, "boolean", F.col("o_orderpriority").startswith("1").cast("string"))
        return reduce(DataFrame.unionByName, [*numbers, *texts, urgent])

    def member(self) -> DataFrame:
        def row(df, refset, no, date, active, referenced, fields: dict[str, Column]):
            cells = [x for n, c in fields.items() for x in (F.lit(n), F.coalesce(c.cast("string"), F.lit("")))]
            return df.select(F.lit(cid(31, refset)).cast("bigint").alias("refset"), no.cast("bigint").alias("row_no"), date.cast("int").alias("effective_time"), active.alias("active"), F.lit(cid(32, 3)).cast("bigint").alias("module_id"), referenced.alias("referenced"), F.create_map(*cells).alias("fields"))

        day = lambda c: F.date_format(c, "yyyyMMdd")
        events, docs, orders = self.t("events"), self.t("documents"), self.t("orders")
        return reduce(DataFrame.unionByName, [
            row(events, EVENTS, F.col("event_id"), day("ts"), F.col("event_type") != "error", col_id(24, F.col("user_id")), {"eventType": F.col("event_type"), "value": F.col("value").cast("decimal(18,2)"), "eventDate": day("ts"), "props": F.col("props")}),
            row(docs, REVIEWS, F.col("doc_id"), day("review_date"), F.col("rating").isNotNull(), col_id(23, F.col("doc_id")), {"rating": F.col("rating"), "itemCode": F.col("item_id"), "reviewedOn": day("review_date"), "verified": F.coalesce("verified", F.lit(False))}),
            row(orders, BUYERS, F.col("o_orderkey"), day("o_orderdate"), F.lit(True), col_id(20, F.col("o_orderkey")), {"targetComponentId": col_id(13, F.col("o_custkey"))}),
        ])

    def member_schema(self) -> DataFrame:
        fields = {EVENTS: [("eventType", "text"), ("value", "number"), ("eventDate", "time"), ("props", "text")], REVIEWS: [("rating", "integer"), ("itemCode", "text"), ("reviewedOn", "time"), ("verified", "boolean")], BUYERS: [("targetComponentId", "id")]}
        return self.spark.createDataFrame([(cid(31, r), i, f, k) for r, fs in fields.items() for i, (f, k) in enumerate(fs)], fixed.SCHEMAS["member_schema"])

    def refset_domain(self) -> DataFrame:
        return self.spark.createDataFrame([(cid(31, r), True) for r in (EVENTS, REVIEWS, BUYERS)], fixed.SCHEMAS["refset_domain"])

    def description(self) -> DataFrame:
        def row(df, concept, key, term, suffix):
            pair = lambda r, a: F.struct(F.lit(r).cast("bigint").alias("refset"), F.lit(a).cast("bigint").alias("acceptability"))
            even = F.when(key % 2 == 0, F.array(pair(fixed.GB_ENGLISH, fixed.PREFERRED))).otherwise(F.array(pair(fixed.US_ENGLISH, fixed.ACCEPTABLE)))
            both = F.array(pair(fixed.GB_ENGLISH, fixed.PREFERRED), pair(fixed.US_ENGLISH, fixed.PREFERRED))
            kinds = F.array(F.struct(F.lit(10).alias("add"), F.lit(fixed.SYNONYM).cast("bigint").alias("type_id"), term.alias("term"), even.alias("dialects")), F.struct(F.lit(110).alias("add"), F.lit(fixed.FSN).cast("bigint").alias("type_id"), F.concat(term, F.lit(f" ({suffix})")).alias("term"), both.alias("dialects")))
            each = df.select(concept.alias("concept_id"), F.explode(kinds).alias("x"))
            return each.select((F.col("concept_id") + F.col("x.add")).alias("description_id"), "concept_id", F.lit(cid(32, 3)).cast("bigint").alias("module_id"), "x.type_id", F.lit(None).cast("int").alias("effective_time"), F.lit(True).alias("active"), F.lit("en").alias("language"), "x.term", "x.dialects")

        docs = self.t("documents").filter("coalesce(title, '') <> ''")
        lang = F.when(F.lower("lang").rlike("^[a-z]{2}$"), F.lower("lang")).otherwise("en")
        none = F.array().cast("array<struct<refset:bigint,acceptability:bigint>>")
        titles = docs.select((col_id(23, F.col("doc_id")) + 10).alias("description_id"), col_id(23, F.col("doc_id")), F.lit(cid(32, 3)).cast("bigint").alias("module_id"), F.lit(fixed.SYNONYM).cast("bigint").alias("type_id"), F.date_format("review_date", "yyyyMMdd").cast("int").alias("effective_time"), F.coalesce(F.col("rating") != 1, F.lit(False)).alias("active"), lang.alias("language"), F.col("title").alias("term"), none.alias("dialects"))
        return reduce(DataFrame.unionByName, [
            row(self.t("customer"), col_id(13, F.col("c_custkey")), F.col("c_custkey"), F.col("c_name"), "customer"),
            row(self.t("part"), col_id(17, F.col("p_partkey")), F.col("p_partkey"), F.col("p_name"), "part"),
            row(self.t("nation"), col_id(12, F.col("n_nationkey")), F.col("n_nationkey"), F.col("n_name"), "nation"),
            row(self.t("region"), col_id(11, F.col("r_regionkey")), F.col("r_regionkey"), F.col("r_name"), "region"),
            titles,
        ])

    def association(self) -> DataFrame:
        return self.first_copies().filter("doc_id <> first").select(F.lit(fixed.SAME_AS).cast("bigint").alias("refset"), col_id(23, F.col("doc_id")).alias("source"), col_id(23, F.col("first")).alias("target"))

    def identifier(self) -> DataFrame:
        return self.t("customer").select(F.lit(cid(10, SCHEME)).cast("bigint").alias("scheme"), F.col("c_name").alias("code"), col_id(13, F.col("c_custkey")).alias("component"), F.lit(cid(32, 3)).cast("bigint").alias("module_id"), F.lit(None).cast("int").alias("effective_time"), F.lit(True).alias("active"))

    def catalog(self, stored: bool = True) -> Catalog:
        """``stored`` tables are written once, for many readers; else only those are that others are made of."""
        sources = {n: getattr(self, n) for n in ("member", "member_schema", "refset_domain", "association", "identifier")}
        sources |= {"isa": self.isa_table, "concept": lambda: cut(self.concept()), "description": lambda: cut(self.description()) if stored else self.description()}
        # written once, as an index would be: row groups in type order let scans skip other attributes
        sources |= {n: (lambda n=n: cut(getattr(self, n)().sortWithinPartitions("type")) if stored else getattr(self, n)()) for n in ("relationship", "concrete")}
        return Catalog(self.spark, sources, Config(schemes={"demo": cid(10, SCHEME)}), {"edition": "star"})


_catalogs: dict[tuple[str, str], Catalog] = {}


def star_catalog(spark: SparkSession, directory: str) -> Catalog:
    """The directory's catalog, built once per application."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _catalogs:
        _catalogs[key] = Star(spark, directory).catalog()
    return _catalogs[key]

"""Evaluate expressions as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog as fixed
from .catalog import Catalog, is_concept_id
from .ecl import parse, tree as t
from .functions import decimals, terms

# Order of the kinds of typed values
CONCEPT, COMPONENT, NUMBER, BOOLEAN, TIME, STRING = range(6)
METADATA = {"effectivetime": ("effectiveTime", "time"), "active": ("active", "boolean"), "moduleid": ("moduleId", "id"), "referencedcomponentid": ("referencedComponentId", "id")}
MAX_LONG = (1 << 63) - 1
#: Ids that are written into a filter; more are joined.
FEW = 256


@dataclass
class Result:
    """``kind`` is concepts (concept_id), values (kind, text) or rows (one column per field). Nothing is sorted before it is asked for."""

    kind: str
    df: DataFrame
    #: rows with the columns of their order
    sortable: DataFrame | None = None

    def ordered(self) -> DataFrame:
        if self.kind == "rows":
            return self.sortable.orderBy("_order_refset", "_order_referenced", "_order_row_no").select(self.df.columns)
        return self.df.orderBy("concept_id") if self.kind == "concepts" else self.df.orderBy("kind", "text")

    def window(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        df = self.ordered()
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)


class Engine:
    def __init__(self, catalog: Catalog):
        self.c, self.spark = catalog, catalog.spark

    # -- entry

    def evaluate(self, expression: str | t.Node, max_results: int | None = None) -> Result:
        """The result of an expression; with ``max_results`` a larger one raises ResultLimit instead of running on."""
        node = parse(expression) if isinstance(expression, str) else expression
        check_tree(node)
        made = self.result(node)
        if max_results is not None and made.df.limit(max_results + 1).count() > max_results:
            raise t.ResultLimit(f"more than {max_results} results")
        return made

    def concepts(self, expression: str) -> DataFrame:
        """The concept set of an expression that yields concepts."""
        return self.set_of(parse(expression))

    def evaluate_many(self, expressions: dict[str, str]) -> DataFrame:
        """(name, concept_id) of many concept-valued expressions as one plan, so that a corpus costs few jobs and equal parts are shared."""
        parts = [self.concepts(x).select(F.lit(name).alias("name"), "concept_id") for name, x in expressions.items()]
        if not parts:
            return self.spark.createDataFrame([], "name string, concept_id bigint")
        return reduce(DataFrame.unionByName, parts)

    # -- kinds

    def kind(self, node: t.Node) -> str:
        if isinstance(node, t.Members) and node.fields is not None:
            return "rows" if len(node.fields) > 1 or node.fields == ("*",) else "maybe"
        if isinstance(node, t.Dotted):
            return "maybe"
        if isinstance(node, (t.And, t.Or)):
            kinds = {self.kind(p) for p in node.parts}
        elif isinstance(node, t.Minus):
            kinds = {self.kind(node.left), self.kind(node.right)}
        else:
            return "concepts"
        if "rows" in kinds:
            raise t.TypeMismatch("rows cannot be operands of a set operator")
        return "maybe" if "maybe" in kinds else "concepts"

    def result(self, node: t.Node) -> Result:
        kind = self.kind(node)
        if kind == "rows":
            rows = self.member_rows(node)
            return Result("rows", rows.drop("_order_refset", "_order_referenced", "_order_row_no"), rows)
        if kind == "concepts":
            return Result("concepts", self.set_of(node))
        values = self.values_of(node)
        # concepts if every value is a concept of the edition, otherwise typed values
        known = self.c.concept.select(F.col("concept_id").cast("string").alias("text"))
        others = values.filter(F.col("kind") != CONCEPT).select("text").unionByName(values.filter(F.col("kind") == CONCEPT).select("text").join(known, "text", "left_anti"))
        if others.limit(1).count():
            return Result("values", values)
        return Result("concepts", values.select(F.col("text").cast("bigint").alias("concept_id")))

    def values_of(self, node: t.Node) -> DataFrame:
        """(kind, text), distinct."""
        kind = self.kind(node)
        if kind == "rows":
            raise t.TypeMismatch("rows where values are needed")
        if kind == "concepts":
            return self.set_of(node).select(F.lit(CONCEPT).cast("tinyint").alias("kind"), F.col("concept_id").cast("string").alias("text"))
        if isinstance(node, t.Dotted):
            return self.dotted(node)
        if isinstance(node, t.Members):
            return self.member_values(node)
        if isinstance(node, t.Minus):
            return self.values_of(node.left).join(self.values_of(node.right), ["kind", "text"], "left_anti")
        sides = [self.values_of(p) for p in node.parts]
        if isinstance(node, t.Or):
            return reduce(DataFrame.unionByName, sides).distinct()
        return reduce(lambda a, b: a.join(b, ["kind", "text"], "left_semi"), sides)

    def set_of(self, node: t.Node) -> DataFrame:
        """(concept_id), distinct."""
        ids = literals(node)
        if ids is not None:
            return self.known(ids)
        if isinstance(node, t.Any):
            return self.c.concept.select("concept_id")
        if isinstance(node, t.Identifier):
            return self.identified(node)
        if isinstance(node, t.Hierarchy):
            return self.hierarchy(node.op, node.of)
        if isinstance(node, t.Members) and node.fields is None:
            return self.members(node)
        if isinstance(node, t.Refined):
            focus = self.set_of(node.of).withColumnRenamed("concept_id", "source")
            return self.satisfied(node.refinement, focus, ["source"]).select(F.col("source").alias("concept_id"))
        if isinstance(node, t.Filtered):
            return self.filtered(node)
        if isinstance(node, t.History):
            return self.history(node)
        kind = self.kind(node)
        if kind == "concepts" and isinstance(node, t.And):
            return reduce(lambda a, b: a.join(b, "concept_id", "left_semi"), map(self.set_of, node.parts))
        if kind == "concepts" and isinstance(node, t.Or):
            plain = [p for p in node.parts if literals(p) is not None]
            same: dict[str, list[int]] = {}
            rest = []
            for p in node.parts:  # hierarchies of literals by the same operator share one seed list
                seeds = literals(p.of) if isinstance(p, t.Hierarchy) and p.op not in ("!!>", "!!<") else None
                if seeds is not None:
                    same.setdefault(p.op, []).extend(seeds)
                elif p not in plain:
                    rest.append(self.set_of(p))
            sets = rest + [self.hierarchy(op, t.Or(tuple(map(t.Concept, ids)))) for op, ids in same.items()]
            if plain:
                sets.append(self.known([i for p in plain for i in literals(p)]))
            return reduce(DataFrame.unionByName, sets).distinct()
        if kind == "concepts" and isinstance(node, t.Minus):
            return self.set_of(node.left).join(self.set_of(node.right), "concept_id", "left_anti")
        if kind == "rows":
            raise t.TypeMismatch("rows where concepts are needed")
        values = self.values_of(node)
        if values.filter(F.col("kind") != CONCEPT).limit(1).count():
            raise t.TypeMismatch("values other than concepts where concepts are needed")
        ids = values.select(F.col("text").cast("bigint").alias("concept_id"))
        lost = ids.join(self.c.concept, "concept_id", "left_anti").limit(1).collect()
        if lost:
            raise t.MissingReference(f"{lost[0][0]} is no concept of the edition")
        return ids

    def known(self, ids: list[int]) -> DataFrame:
        return self.c.concept.filter(F.col("concept_id").isin(sorted(set(ids)))).select("concept_id")

    def identified(self, node: t.Identifier) -> DataFrame:
        scheme = self.c.config.schemes.get(node.scheme.lower())
        if scheme is None:
            raise t.UnknownAlias(f"identifier scheme {node.scheme}")
        found = self.c.identifier.filter((F.col("scheme") == scheme) & (F.col("code") == node.code) & F.col("active") & is_concept_id(F.col("component")))
        return found.select(F.col("component").alias("concept_id")).distinct().join(self.c.concept, "concept_id", "left_semi")

    # -- hierarchy

    def keep(self, df: DataFrame, column: str, node: t.Node, anti: bool = False) -> DataFrame:
        """Rows whose ``column`` is in the set of ``node``, or not: a literal filter where that is known, else a semi- or anti-join."""
        if isinstance(node, t.Any) and not anti:
            return df.join(self.c.concept.select(F.col("concept_id").alias(column)), column, "left_semi")
        ids = literals(node)
        if ids is not None:
            inside = F.col(column).isin(sorted(set(ids)))
            return df.filter(~inside if anti else inside)
        chosen = self.set_of(node).select(F.col("concept_id").alias(column))
        return df.join(chosen, column, "left_anti" if anti else "left_semi")

    def within(self, df: DataFrame, column: str, ids: list[int]) -> DataFrame:
        """Rows whose ``column`` is one of ``ids``: a filter that reaches the scan while they are few, else a semi-join."""
        if len(ids) <= FEW:
            return df.filter(F.col(column).isin(ids))
        chosen = self.spark.createDataFrame([(i,) for i in ids], f"{column} bigint")
        return df.join(chosen, column, "left_semi")

    def hierarchy(self, op: str, of: t.Node) -> DataFrame:
        if op in ("!!>", "!!<"):
            inside = self.set_of(of)
            above, below = ("ancestor", "descendant") if op == "!!>" else ("descendant", "ancestor")
            # members that have another member on the far side
            dominated = self.c.closure.join(inside.withColumnRenamed("concept_id", above), above, "left_semi").select(F.col(below).alias("concept_id")).distinct()
            return inside.join(dominated, "concept_id", "left_anti")
        table = self.c.isa.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")) if "!" in op else self.c.closure.select("ancestor", "descendant")
        seed, found = ("ancestor", "descendant") if op[0] == "<" else ("descendant", "ancestor")
        reached = self.keep(table, seed, of).select(F.col(found).alias("concept_id"))
        if op.startswith(("<<", ">>")):
            reached = reached.unionByName(self.set_of(of))
        return reached.distinct()

    # -- refinements

    def satisfied(self, node: t.Node, domain: DataFrame, keys: list[str]) -> DataFrame:
        """The domain rows (by ``keys``: source, or source and grp) that satisfy a refinement."""
        if isinstance(node, t.AllOf):
            for p in node.parts:
                domain = self.satisfied(p, domain, keys)
            return domain
        if isinstance(node, t.AnyOf):
            return reduce(DataFrame.unionByName, [self.satisfied(p, domain, keys) for p in node.parts]).distinct()
        if isinstance(node, t.Group) and needs_rows(node.of):
            return self.counted(domain, self.groups_of(node.of).select("source"), ["source"], node.least, node.most)
        if isinstance(node, t.Group):
            pairs = self.c.relationship.select("source", "grp").unionByName(self.c.concrete.select("source", "grp")).filter("grp <> 0").join(domain.select("source"), "source", "left_semi").distinct()
            inner = self.satisfied(node.of, pairs, ["source", "grp"])
            return self.counted(domain, inner.select("source"), ["source"], node.least, node.most)
        if node.reverse:
            if keys != ["source"] or isinstance(node.value, t.Value):
                raise t.SemanticError("a reverse flag here")
            return self.counted(domain, self.reversed_rows(node), keys, node.least, node.most)
        return self.counted(domain, self.attribute_rows(node, keys), keys, node.least, node.most)

    def groups_of(self, node: t.Node) -> DataFrame:
        """Distinct (source, grp) that satisfy a refinement which no group without rows can: found from the rows, without the list of all groups."""
        keys = ["source", "grp"]
        if isinstance(node, t.AnyOf):
            return reduce(DataFrame.unionByName, [self.groups_of(p) for p in node.parts]).distinct()
        if isinstance(node, t.AllOf):
            at = next(i for i, p in enumerate(node.parts) if needs_rows(p))
            found = self.groups_of(node.parts[at])
            for i, p in enumerate(node.parts):
                found = found if i == at else self.satisfied(p, found, keys)
            return found
        if node.reverse:
            raise t.SemanticError("a reverse flag here")
        rows = self.attribute_rows(node, keys).filter("grp <> 0")
        if node.least == 1 and node.most is None:
            return rows.distinct()
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        least, most = min(node.least, MAX_LONG), MAX_LONG if node.most is None else min(node.most, MAX_LONG)
        return counts.filter(F.col("_n").between(least, most)).select(*keys)

    def counted(self, domain: DataFrame, rows: DataFrame, keys: list[str], least: int, most: int | None) -> DataFrame:
        """Domain rows whose number of ``rows`` is within the bounds; rows are counted only where the bounds need it."""
        least, most = min(least, MAX_LONG), None if most is None else min(most, MAX_LONG)
        if least == 0 and most is None:
            return domain
        if least == 1 and most is None:
            return domain.join(rows.select(*keys), keys, "left_semi")
        if least == 0 and most == 0:
            return domain.join(rows.select(*keys), keys, "left_anti")
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        within = F.col("_n") >= least if most is None else F.col("_n").between(least, most)
        if least >= 1:
            return domain.join(counts.filter(within), keys, "left_semi")
        return domain.join(counts.filter(F.col("_n") > most), keys, "left_anti")

    def named(self, df: DataFrame, name: t.Node) -> DataFrame:
        return df if isinstance(name, t.Any) else self.keep(df, "type", name)

    def attribute_rows(self, node: t.Attribute, keys: list[str]) -> DataFrame:
        if isinstance(node.value, t.Value):
            return self.named(self.c.concrete.filter(concrete_test(node.op, node.value)), node.name).select(*keys)
        rows = self.c.relationship.select("source", "grp", "type", "target")
        if keys == ["source"]:
            rows = rows.unionByName(self.parents_as_rows())
        rows = self.named(rows, node.name)
        if isinstance(node.value, t.Any):
            return rows.filter(F.lit(node.op == "=")).select(*keys)
        return self.keep(rows, "target", node.value, anti=node.op == "!=").select(*keys)

    def parents_as_rows(self) -> DataFrame:
        return self.c.isa.select(F.col("child").alias("source"), F.lit(0).alias("grp"), F.lit(fixed.IS_A).cast("bigint").alias("type"), F.col("parent").alias("target"))

    def reversed_rows(self, node: t.Attribute) -> DataFrame:
        """One row per target and distinct active source."""
        rows = self.named(self.c.relationship.select("source", "type", "target").unionByName(self.parents_as_rows().drop("grp")), node.name)
        if isinstance(node.value, t.Any):
            rows = rows.filter(F.lit(node.op == "="))
        else:
            rows = self.keep(rows, "source", node.value, anti=node.op == "!=")
        rows = rows.join(self.c.concept.filter("active").select(F.col("concept_id").alias("source")), "source", "left_semi")
        return rows.select(F.col("target").alias("source"), F.col("source").alias("from")).distinct()

    def dotted(self, node: t.Dotted) -> DataFrame:
        focus = self.set_of(node.of).withColumnRenamed("concept_id", "source")
        rows = self.named(self.c.relationship.select("source", "type", "target").unionByName(self.parents_as_rows().drop("grp")), node.attribute)
        active = self.c.concept.filter("active").select(F.col("concept_id").alias("target"))
        targets = rows.join(focus, "source", "left_semi").select("target").distinct().join(active, "target", "left_semi")
        literal = self.named(self.c.concrete, node.attribute).join(focus, "source", "left_semi")
        kind = F.when(F.col("kind") == "number", NUMBER).when(F.col("kind") == "boolean", BOOLEAN).otherwise(STRING).cast("tinyint")
        return targets.select(F.lit(CONCEPT).cast("tinyint").alias("kind"), F.col("target").cast("string").alias("text")).unionByName(literal.select(kind.alias("kind"), F.col("canon").alias("text")).distinct())

    # -- filters

    def concept_test(self, df: DataFrame, column: str, op: str, node: t.Node) -> DataFrame:
        """Rows whose concept-valued metadata is in the set, or is a concept of the edition that is not."""
        if op == "=":
            return df.join(self.set_of(node).select(F.col("concept_id").alias(column)), column, "left_semi")
        known = df.join(self.c.concept.select(F.col("concept_id").alias(column)), column, "left_semi")
        return self.keep(known, column, node, anti=True)

    def shared_filter(self, df: DataFrame, f: t.Filter) -> DataFrame:
        if f.field == "active":
            if f.value is None:
                return df if f.op == "=" else df.filter(F.lit(False))
            return df.filter(F.col("active") == (f.value == (f.op == "=")))
        if f.field == "moduleId":
            return self.concept_test(df, "module_id", f.op, f.value)
        return df.filter(date_test(F.col("effective_time"), f.op, f.value))

    def filtered(self, node: t.Filtered) -> DataFrame:
        focus = self.set_of(node.of)
        if node.kind == "C":
            rows = self.c.concept.join(focus, "concept_id", "left_semi")
            for f in node.filters:
                if f.field == "definitionStatus":
                    rows = rows.filter(F.when(F.col("defined"), "defined").otherwise("primitive").isin(list(f.value)) == (f.op == "="))
                elif f.field == "definitionStatusId":
                    status = F.when(F.col("defined"), fixed.DEFINED).otherwise(fixed.PRIMITIVE).cast("bigint")
                    rows = self.concept_test(rows.withColumn("status_id", status), "status_id", f.op, f.value).drop("status_id")
                else:
                    rows = self.shared_filter(rows, f)
            return rows.select("concept_id")
        rows = self.c.description
        if not any(f.field == "active" for f in node.filters):
            rows = rows.filter("active")
        for f in node.filters:
            rows = self.description_filter(rows, f)
        return focus.join(rows.select("concept_id"), "concept_id", "left_semi")

    def description_filter(self, rows: DataFrame, f: t.Filter) -> DataFrame:
        positive = f.op == "="
        if f.field == "term":
            hits = [terms.matches_wild(F.col("term"), x.text, F.col("language")) if x.kind == "wild" else terms.matches_words(F.col("term"), x.text, F.col("language")) for x in f.value]
            return rows.filter(reduce(Column.__or__, hits) == positive)
        if f.field == "language":
            return rows.filter(F.col("language").isin(list(f.value)) == positive)
        if f.field == "id":
            return rows.filter(F.col("description_id").isin(list(f.value)) == positive)
        if f.field == "type":
            ids = [{"syn": fixed.SYNONYM, "fsn": fixed.FSN, "def": fixed.DEFINITION}[x] for x in f.value]
            return rows.filter(F.col("type_id").isin(ids) == positive)
        if f.field == "typeId":
            return self.concept_test(rows, "type_id", f.op, f.value)
        if f.field == "dialect":
            return rows.filter(F.exists("dialects", lambda d: reduce(Column.__or__, [self.dialect_test(d, x) for x in f.value])) == positive)
        return self.shared_filter(rows, f)

    def dialect_test(self, d: Column, dialect: t.Dialect) -> Column:
        if isinstance(dialect.refset, str):
            refset = self.c.config.dialects.get(dialect.refset)
            if refset is None:
                raise t.UnknownAlias(f"dialect {dialect.refset}")
            refsets = [refset]
        else:
            refsets = literals(dialect.refset)
            if refsets is None:  # dialect reference sets are few: metadata
                refsets = [r[0] for r in self.set_of(dialect.refset).limit(10_001).collect()]
                if len(refsets) > 10_000:
                    raise t.ResultLimit("more than 10000 dialects")
        test = d["refset"].isin(refsets)
        if dialect.acceptability:
            ids = [{"accept": fixed.ACCEPTABLE, "prefer": fixed.PREFERRED}.get(x, x) for x in dialect.acceptability]
            test = test & d["acceptability"].isin(ids)
        return test

    # -- reference sets

    def check_domain(self, of: t.Node) -> None:
        """Selected reference sets of which none holds concepts make the expression meaningless."""
        domain = self.c.refset_domain if isinstance(of, t.Any) else self.keep(self.c.refset_domain, "refset", of)
        if domain.agg(F.max("concept_based")).first()[0] is False:
            raise t.SemanticError("none of the reference sets refers to concepts")

    def members(self, node: t.Members) -> DataFrame:
        if node.filters:
            selected, rows = self.member_table(node, [] if node.reverse else ["referencedComponentId"])
            if node.reverse:
                return rows.select(F.col("refset").alias("concept_id")).distinct().join(self.c.concept, "concept_id", "left_semi")
            return rows.select(F.col("referenced").alias("concept_id")).distinct().join(self.c.concept, "concept_id", "left_semi")
        if node.reverse:
            found = self.c.membership if isinstance(node.of, t.Any) else self.keep(self.c.membership, "member", node.of)
            return found.select(F.col("refset").alias("concept_id")).distinct().join(self.c.concept, "concept_id", "left_semi")
        self.check_domain(node.of)
        found = self.c.membership if isinstance(node.of, t.Any) else self.keep(self.c.membership, "refset", node.of)
        return found.select(F.col("member").alias("concept_id")).distinct()

    def member_table(self, node: t.Members, wanted: list[str]) -> tuple[dict[str, tuple[str, str]], DataFrame]:
        """Fields in use and the rows of the selected tables that have them all, filtered."""
        schema = {r: self.c.schema_of.get(r, {}) for r in self.c.refsets}
        if node.reverse:
            selected = list(schema)
        else:
            self.check_domain(node.of)
            ids = literals(node.of)
            if ids is None and not isinstance(node.of, t.Any):
                ids = [r[0] for r in self.keep(self.c.refset_domain.select("refset"), "refset", node.of).collect()]
            selected = list(schema) if ids is None else [i for i in ids if i in schema]
        needed = [n.lower() for n in wanted] + [f.field.lower() for f in node.filters]
        fields: dict[str, tuple[str, str]] = {}
        for n in needed:
            owners = [schema[r][n] for r in selected if n in schema[r]]
            if n in METADATA and selected:
                owners = [METADATA[n]]
            if not owners:
                raise t.InvalidField(f"no selected reference set has the field {n}")
            fields[n] = owners[0]
        kept = [r for r in selected if all(n in METADATA or n in schema[r] for n in needed)]
        whole = len(kept) == len(schema)
        for f in node.filters:
            for kind in {METADATA[f.field.lower()][1]} if f.field.lower() in METADATA else {schema[r][f.field.lower()][1] for r in selected if f.field.lower() in schema[r]}:
                allowed = {"concept": {"id"}, "number": {"integer", "number"}, "boolean": {"boolean"}, "active": {"boolean"}, "date": {"time"}, "text": {"text", "uuid"}, "dateortext": {"time", "text", "uuid"}}[f.kind]
                if kind not in allowed:
                    raise t.TypeMismatch(f"{f.field} is of the type {kind}")
        rows = self.c.member if whole else self.within(self.c.member, "refset", kept)
        if node.reverse:
            rows = self.keep(rows, "referenced", node.of)
        if not any(f.field.lower() == "active" for f in node.filters):
            rows = rows.filter("active")
        for f in node.filters:
            rows = self.member_filter(rows, f, fields[f.field.lower()])
        return fields, rows

    def member_column(self, field: tuple[str, str]) -> Column:
        stored = {"effectiveTime": "effective_time", "active": "active", "moduleId": "module_id", "referencedComponentId": "referenced"}
        if field[0] in stored:
            return F.col(stored[field[0]]).cast("string")
        return F.try_element_at("fields", F.lit(field[0]))

    def member_filter(self, rows: DataFrame, f: t.MemberFilter, field: tuple[str, str]) -> DataFrame:
        column, kind = self.member_column(field), field[1]
        positive = f.op == "="
        if f.kind == "active":
            return rows if f.value is None and positive else rows.filter(F.lit(False)) if f.value is None else rows.filter(column == ("true" if f.value == positive else "false"))
        if f.kind == "boolean":
            return rows.filter(F.lower(column).isin("true", "1") == (f.value == positive))
        if f.kind == "number":
            return rows.filter(F.coalesce(column, F.lit("")) != "").filter(compare(decimals.key_column(decimals.canonical_column(column)), f.op, F.lit(decimals.key(f.value))))
        if f.kind == "concept":
            tested = rows.withColumn("_id", column.try_cast("bigint"))
            return self.keep(tested, "_id", f.value, anti=not positive).drop("_id")
        if kind == "time":
            return rows.filter(date_test(F.when(column != "", column).cast("int"), f.op, f.value))
        told = [t.Term("match", str(v)) for v in f.value] if f.kind == "dateortext" else f.value
        if kind == "uuid":
            return rows.filter(F.lower(column).isin([x.text.lower() for x in told]) == positive)
        language = F.lit(self.c.config.language)
        hits = [terms.matches_wild(column, x.text, language) if x.kind == "wild" else terms.matches_words(column, x.text, language) for x in told]
        return rows.filter(F.coalesce(reduce(Column.__or__, hits), F.lit(False)) == positive)

    def own_fields(self, node: t.Members) -> list[str]:
        """referencedComponentId and the own fields of the selected tables."""
        schema = self.c.schema_of
        ids = literals(node.of)
        chosen = ids if ids is not None else [r[0] for r in self.keep(self.c.member_schema.select("refset").distinct(), "refset", node.of).collect()]
        names = list(dict.fromkeys(f for r in chosen for f, _ in schema.get(r, {}).values()))
        return ["referencedComponentId", *names]

    def member_rows(self, node: t.Members) -> DataFrame:
        names = self.own_fields(node) if node.fields == ("*",) else list(node.fields)
        fields, rows = self.member_table(node, names)
        shown = [fields[n.lower()] for n in names]
        cells = [F.coalesce(self.member_column(f), F.lit("")).alias(f[0]) for f in shown]
        return rows.select(*cells, *[F.col(c).alias(f"_order_{c}") for c in ("refset", "referenced", "row_no")])

    def member_values(self, node: t.Members) -> DataFrame:
        fields, rows = self.member_table(node, list(node.fields))
        field = fields[node.fields[0].lower()]
        column = self.member_column(field)
        if field[0] == "referencedComponentId":
            ids = rows.select(F.col("referenced").alias("concept_id")).distinct().join(self.c.concept, "concept_id", "left_semi")
            return ids.select(F.lit(CONCEPT).cast("tinyint").alias("kind"), F.col("concept_id").cast("string").alias("text"))
        kind = field[1]
        if kind == "id":
            tag, text = F.when(is_concept_id(column.try_cast("bigint")), CONCEPT).otherwise(COMPONENT), column
            rows = rows.filter(F.coalesce(column, F.lit("")) != "")
        elif kind in ("integer", "number"):
            tag, text = F.lit(NUMBER), decimals.canonical_column(column)
            rows = rows.filter(F.coalesce(column, F.lit("")) != "")
        elif kind == "boolean":
            tag, text = F.lit(BOOLEAN), F.when(F.lower(column).isin("true", "1"), "true").otherwise("false")
        elif kind == "time":
            tag, text = F.lit(TIME), F.coalesce(column, F.lit(""))
        else:
            tag, text = F.lit(STRING), F.lower(column) if kind == "uuid" else F.coalesce(column, F.lit(""))
        return rows.select(tag.cast("tinyint").alias("kind"), text.alias("text")).distinct()

    # -- history

    def association_kinds(self, profile: str | t.Node) -> DataFrame:
        if isinstance(profile, str) and profile in ("MIN", "MOD"):
            ids = [fixed.SAME_AS] if profile == "MIN" else [fixed.SAME_AS, fixed.REPLACED_BY, fixed.WAS_A, fixed.PARTIALLY_EQUIVALENT]
            return self.known(ids)
        if profile == "MAX" or isinstance(profile, t.Any):
            return self.hierarchy("<", t.Concept(fixed.ASSOCIATIONS))
        return self.set_of(profile)

    def history(self, node: t.History) -> DataFrame:
        """The focus and the one-step predecessors of it: sources of associations that target it, targets of MOVED FROM rows of it."""
        focus = self.set_of(node.of)
        kinds = self.association_kinds(node.profile)
        if not isinstance(node.profile, str) and not isinstance(node.profile, t.Any):
            self.check_associations(kinds)
        implied = kinds.filter(F.col("concept_id") == fixed.SAME_AS).select(F.lit(fixed.MOVED_FROM).cast("bigint").alias("concept_id"))
        kinds = kinds.filter(F.col("concept_id") != fixed.MOVED_TO).unionByName(implied).distinct().withColumnRenamed("concept_id", "refset")
        rows = self.c.association.select("refset", "source", "target").join(kinds, "refset", "left_semi")
        if not isinstance(node.profile, str) and not isinstance(node.profile, t.Any):
            rows = rows.unionByName(self.other_associations(kinds))
        back = rows.filter(F.col("refset") != fixed.MOVED_FROM).join(focus.withColumnRenamed("concept_id", "target"), "target", "left_semi").select(F.col("source").alias("concept_id"))
        moved = rows.filter(F.col("refset") == fixed.MOVED_FROM).join(focus.withColumnRenamed("concept_id", "source"), "source", "left_semi").select(F.col("target").alias("concept_id"))
        return focus.unionByName(back).unionByName(moved).distinct()

    def other_associations(self, kinds: DataFrame) -> DataFrame:
        """(refset, source, target) of chosen reference sets that are no association reference sets but have targets: their active member rows."""
        names = sorted({fields["targetcomponentid"][0] for fields in self.c.schema_of.values() if "targetcomponentid" in fields})
        if not names:
            return self.c.association.select("refset", "source", "target").limit(0)
        others = kinds.join(self.hierarchy("<", t.Concept(fixed.ASSOCIATIONS)).withColumnRenamed("concept_id", "refset"), "refset", "left_anti")
        target = F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names]).try_cast("bigint")
        rows = self.c.member.filter("active").join(others, "refset", "left_semi").select("refset", F.col("referenced").alias("source"), target.alias("target"))
        known = self.c.concept.select(F.col("concept_id").alias("source"))
        return rows.filter(F.col("target").isNotNull()).join(known, "source", "left_semi")

    def check_associations(self, kinds: DataFrame) -> None:
        """A chosen reference set with a table but without targetComponentId cannot give history."""
        tables = self.c.member_schema.select("refset", "field").join(kinds.withColumnRenamed("concept_id", "refset"), "refset", "left_semi")
        lacking = tables.groupBy("refset").agg(F.max((F.lower("field") == "targetcomponentid").cast("int")).alias("has")).filter("has = 0").limit(1).collect()
        if lacking:
            raise t.InvalidField(f"{lacking[0][0]} has no field targetComponentId")

    def successors(self, concept: int) -> DataFrame:
        return self.c.association.filter(F.col("source") == concept).select("refset", F.col("target").alias("concept_id"))

    def predecessors(self, concept: int) -> DataFrame:
        return self.c.association.filter(F.col("target") == concept).select("refset", F.col("source").alias("concept_id"))

    # -- labels, search, lookup, comparison

    def labelled(self, found: DataFrame) -> DataFrame:
        """(concept_id, display, active)."""
        return found.join(self.c.concept.select("concept_id", "active"), "concept_id").join(self.c.display.withColumnRenamed("term", "display"), "concept_id", "left").select("concept_id", "display", "active")

    def search_matches(self, text: str) -> DataFrame:
        """Concepts with every word of the text, the last one as a prefix."""
        import re

        low = text.lower().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO))
        asked = re.findall("[0-9a-z]+", low)
        if not asked:
            return self.c.concept.select("concept_id").filter(F.lit(False))
        found = None
        for i, w in enumerate(asked):
            test = F.col("word").startswith(w) if i == len(asked) - 1 else F.col("word") == w
            hits = self.c.word.filter(test).select("concept_id")
            found = hits.distinct() if found is None else found.join(hits, "concept_id", "left_semi")
        return found

    def search_candidates(self, text: str, within: str | None = None, include_inactive: bool = False) -> DataFrame:
        """(concept_id, display, active) of all concepts that match."""
        found = self.search_matches(text)
        if within is not None:
            found = found.join(self.concepts(within), "concept_id", "left_semi")
        labels = self.labelled(found)
        return labels if include_inactive else labels.filter("active")

    def search(self, text: str, within: str | None = None, limit: int = 50, include_inactive: bool = False, pool: int = 400) -> DataFrame:
        """(concept_id, display, active, score): the best of the ``pool`` shortest labels that match; concepts without a label come last."""
        labels = self.search_candidates(text, within, include_inactive).withColumn("size", F.octet_length("display"))
        short = labels.orderBy(F.col("size").asc_nulls_last(), "concept_id").limit(max(pool, limit))
        score = F.when(F.col("display").isNull(), F.lit(LEAST_SCORE)).otherwise(search_score(F.col("display"), text))
        return short.withColumn("score", score.cast("int")).orderBy(F.col("score").desc(), F.coalesce("size", F.lit(0)), "concept_id").limit(limit).drop("size")

    def lookup(self, concept: int) -> dict:
        """All that the edition says of one concept."""
        own = self.c.concept.filter(F.col("concept_id") == concept).collect()
        if not own:
            raise t.MissingReference(f"{concept} is no concept of the edition")
        label = lambda df: [r.asDict() for r in self.labelled(df).orderBy("concept_id").collect()]
        groups: dict[int, list] = {}
        rows = self.c.relationship.filter(F.col("source") == concept).select("grp", "type", F.col("target").cast("string").alias("value"), F.lit("concept").alias("kind"))
        rows = rows.unionByName(self.c.concrete.filter(F.col("source") == concept).select("grp", "type", F.col("canon").alias("value"), "kind"))
        for r in rows.orderBy("grp", "type", "kind", "value").collect():
            groups.setdefault(r["grp"], []).append({"type": r["type"], "kind": r["kind"], "value": r["value"]})
        return {
            **own[0].asDict(),
            "descriptions": [r.asDict(True) for r in self.c.description.filter(F.col("concept_id") == concept).orderBy("description_id").collect()],
            "parents": label(self.hierarchy(">!", t.Concept(concept))),
            "children": label(self.hierarchy("<!", t.Concept(concept))),
            "groups": [{"group": g, "attributes": a} for g, a in sorted(groups.items())],
            "refsets": [r[0] for r in self.c.membership.filter(F.col("member") == concept).select("refset").distinct().orderBy("refset").collect()],
        }


def needs_rows(node: t.Node) -> bool:
    """Whether only groups with rows of their own can satisfy the refinement."""
    if isinstance(node, t.AllOf):
        return any(map(needs_rows, node.parts))
    if isinstance(node, t.AnyOf):
        return all(map(needs_rows, node.parts))
    return isinstance(node, t.Attribute) and node.least >= 1


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def concrete_test(op: str, value: t.Value) -> Column:
    if value.kind == "number":
        return (F.col("kind") == "number") & compare(F.col("num_key"), op, F.lit(decimals.key(value.values[0])))
    if value.kind == "boolean":
        return (F.col("kind") == "boolean") & ((F.col("canon") == ("true" if value.values[0] else "false")) == (op == "="))
    return (F.col("kind") == "text") & (F.col("canon").isin(list(value.values)) == (op == "="))


def date_test(column: Column, op: str, dates: tuple) -> Column:
    """``=`` and ``!=`` are membership; the others hold for any of the dates. The empty date, NULL, equals only itself."""
    real = [d for d in dates if d is not None]
    empty = None in dates
    if op in ("=", "!="):
        inside = F.coalesce(column.isin(real), F.lit(False)) if real else F.lit(False)
        inside = inside | (column.isNull() if empty else F.lit(False))
        return inside if op == "=" else ~inside
    test = F.lit(False)
    for d in real:
        test = test | F.coalesce(compare(column, op, F.lit(d)), F.lit(False))
    return test | (column.isNull() if empty and op in ("<=", ">=") else F.lit(False))


# The points of a search result
POINTS = {"equal": 1000, "begins": 200, "word": 60, "place": 20, "word_prefix": 25, "further_word": -3}
LEAST_SCORE = -(1 << 31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def search_score(label: Column, text: str) -> Column:
    """Points for a label against what was asked.

    Equality and prefix disregard the case of ASCII letters only; words are compared as the word index folds them. A whole word
    counts more where its first place in the label is its place in the question.
    """
    import re

    asked_text = text.strip().translate(str.maketrans(UPPER, LOWER))
    asked = re.findall("[0-9a-z]+", text.lower().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO)))
    plain = F.translate(label, UPPER, LOWER)
    found = F.regexp_extract_all(fixed.folded(label), F.lit("([0-9a-z]+)"), 1)
    score = F.when(plain == asked_text, POINTS["equal"]).otherwise(0) + F.when(plain.startswith(asked_text), POINTS["begins"]).otherwise(0)
    for i, w in enumerate(asked):
        at = F.array_position(found, w)
        begun = F.exists(found, lambda x: x.startswith(w))  # noqa: B023
        score = score + F.when(at == i + 1, POINTS["word"] + POINTS["place"]).when(at > 0, POINTS["word"]).when(begun, POINTS["word_prefix"]).otherwise(0)
    return score + POINTS["further_word"] * F.greatest(F.size(found) - len(asked), F.lit(0))


def literals(node: t.Node) -> list[int] | None:
    """The ids of a literal or a union of literals."""
    if isinstance(node, t.Concept):
        return [node.id]
    if isinstance(node, t.Or):
        parts = [literals(p) for p in node.parts]
        return None if any(p is None for p in parts) else [i for p in parts for i in p]
    return None


def check_tree(node: t.Node, depth: int = 0) -> int:
    """Refuse constructed trees that the parser would not make; the number of nodes."""
    if depth > 192:
        raise t.InvalidTree("nested too deep")
    if isinstance(node, (t.And, t.Or, t.AllOf, t.AnyOf)) and len(node.parts) < 2:
        raise t.InvalidTree("a set operator needs two operands")
    total = 1
    for v in vars(node).values():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, t.Node):
                total += check_tree(x, depth + 1)
            elif isinstance(x, (t.Filter, t.MemberFilter)) and isinstance(x.value, t.Node):
                total += check_tree(x.value, depth + 1)
            elif isinstance(x, (t.Filter, t.MemberFilter)) and x.value == ():
                raise t.InvalidTree("an empty list")
    if total > 4096:
        raise t.InvalidTree("too many nodes")
    return total


def diff(expression: str, old: Engine, new: Engine) -> DataFrame:
    """(concept_id, change) of the concepts that one edition has and the other has not, or that both have."""
    for engine in (old, new):
        if engine.kind(parse(expression)) != "concepts":
            raise t.TypeMismatch("only concept sets can be compared")
    a, b = old.concepts(expression), new.concepts(expression)
    sides = a.withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionByName(b.withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    tagged = sides.groupBy("concept_id").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return tagged.select("concept_id", F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("unchanged").alias("change"))


__all__ = ["Engine", "Result", "diff"]

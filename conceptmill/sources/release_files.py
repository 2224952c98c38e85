"""Write a catalog as release files (an extracted Snapshot archive), one tab-separated file per kind of row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..catalog import Catalog
from ..operators.schema_drift import STANDARD
from ..session import _delete
from .snapshot import COLUMNS, CONCEPT_TYPE, DATATYPES, IDENTIFIER_ORDERS, MODULE_DEPENDENCY, PACKAGE, Archive, _package_date, _start, inspected, local

# Fixed value: the reference set of descriptors
DESCRIPTORS = 900000000000456007
#: Name of the part that holds a file's header line.
HEADER = "part-header.txt"
LETTER_OF = {"id": "c", "integer": "i"}
TYPE_OF = {kind: type_ for kind, type_ in DATATYPES} | {"boolean": 1119460002}


def _told(df: DataFrame, header: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(b) for a, b in zip(df.columns, header)])


def _file(df: DataFrame, header: list[str], path: str) -> None:
    """One file with a header line, as the format wants it: one task writes it, row by row."""
    spark = df.sparkSession
    part = f"{path}.part"
    _told(df, header).coalesce(1).write.options(sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(part)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(part).getFileSystem(spark._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in fs.listStatus(at(part)) if f.getPath().getName().startswith("part-"))
    fs.rename(made, at(path))
    fs.delete(at(part), True)


def _put(spark: SparkSession, path: str, text: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(text.encode())
    out.close()


def _parts(df: DataFrame, header: list[str], path: str) -> None:
    """The same lines as a folder of compressed parts, which all tasks write, with the header line in a part of its own."""
    _told(df, header).select(F.concat_ws("\t", *header).alias("value")).write.options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(path)
    _put(df.sparkSession, f"{path}/{HEADER}", "\t".join(header) + "\n")


def _uuid(*parts: Column) -> Column:
    """A UUID made of the row's place, the same in every run."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def release_files(catalog: Catalog, date: int, module: int, further: list[int] = ()) -> dict[str, Callable[[], tuple[DataFrame, list[str]]]]:
    """Rows and header of each file, by its place in the archive: concepts, relationships, concrete values, descriptions, identifiers and reference sets.

    ``module`` holds what has no module of its own and becomes the edition's; ``further`` ids become concepts. Rows that
    refer to no concept, and tabs and line breaks within texts, have no place in the format and are left out or become blanks.
    """
    c, spark = catalog, catalog.spark
    lit = lambda x: F.lit(x).cast("bigint")
    active = F.lit(1)
    at = lambda kind, name: f"Snapshot/{kind}/{name}_INT_{date}.txt"
    out: dict[str, Callable[[], tuple[DataFrame, list[str]]]] = {}
    flag = lambda x: F.when(F.col(x), 1).otherwise(0)
    ids = c.concept.select("concept_id")

    extra = spark.createDataFrame([(i,) for i in {*further, MODULE_DEPENDENCY, DESCRIPTORS}], "concept_id bigint").join(ids, "concept_id", "left_anti")
    known = ids.unionByName(extra)
    concept = c.concept.select("concept_id", "effective_time", flag("active"), "module_id", F.when(F.col("defined"), fixed.DEFINED).otherwise(fixed.PRIMITIVE))
    concept = concept.union(extra.select("concept_id", F.lit(None).cast("int"), active, lit(module), lit(fixed.PRIMITIVE)))
    out[at("Terminology", "sct2_Concept_Snapshot")] = lambda: (concept, COLUMNS["sct2_Concept_"].split())

    def relationship(df: DataFrame, value: str, names: str, first: int) -> DataFrame:
        # kinds of rows have ranges of ids of their own
        row = {"id": F.monotonically_increasing_id() + (first << 58), "effectiveTime": F.lit(""), "active": active, "moduleId": lit(module), "sourceId": F.col("source"), value: F.col("value"), "relationshipGroup": F.col("grp"), "typeId": F.col("type"), "characteristicTypeId": lit(fixed.INFERRED), "modifierId": lit(fixed.SOME_MODIFIER)}
        return df.select(*[row[n].alias(n) for n in names.split()])

    def relationships() -> tuple[DataFrame, list[str]]:
        names = COLUMNS["sct2_Relationship_"]
        links = c.isa.select(F.col("child").alias("source"), F.col("parent").alias("value"), F.lit(0).alias("grp"), lit(fixed.IS_A).alias("type"))
        return relationship(links, "destinationId", names, 0).unionByName(relationship(c.relationship.withColumnRenamed("target", "value"), "destinationId", names, 1)), names.split()

    def concretes() -> tuple[DataFrame, list[str]]:
        names = COLUMNS["sct2_RelationshipConcreteValues_"]
        text = F.concat(F.lit('"'), F.regexp_replace("canon", r'(["\\])', r"\\$1"), F.lit('"'))
        told = F.when(F.col("kind") == "number", F.concat(F.lit("#"), "canon")).when(F.col("kind") == "text", text).otherwise(F.col("canon"))
        return relationship(c.concrete.withColumn("value", told), "value", names, 2), names.split()

    out[at("Terminology", "sct2_Relationship_Snapshot")] = relationships
    out[at("Terminology", "sct2_RelationshipConcreteValues_Snapshot")] = concretes

    plain = lambda x: F.regexp_replace(x, "[\t\r\n]", " ")
    described = lambda: c.description.join(known, "concept_id", "left_semi")
    out[at("Terminology", "sct2_Description_Snapshot-en")] = lambda: (described().select("description_id", "effective_time", flag("active"), "module_id", "concept_id", "language", "type_id", plain("term"), F.lit("")), COLUMNS["sct2_Description_"].split())
    out[at("Terminology", "sct2_Identifier_Snapshot")] = lambda: (c.identifier.select("code", "effective_time", flag("active"), "module_id", "scheme", "component"), IDENTIFIER_ORDERS[0].split())

    def members(rows: Callable[[], DataFrame], own: list[str], file: str, refset: Column, referenced: Column, cells: list[Column], *row: Column, time: Column | None = None, on: Column = active) -> None:
        shown = lambda: rows().select(_uuid(refset, *row).alias("id"), (time if time is not None else F.lit("")).alias("t"), on.alias("a"), lit(module).alias("m"), refset.alias("r"), referenced.alias("c"), *[x.alias(f"x{i}") for i, x in enumerate(cells)])
        out[at("Refset", file)] = lambda: (shown(), [*STANDARD, *own])

    members(lambda: described().select("description_id", F.explode("dialects").alias("d")), ["acceptabilityId"], "der2_cRefset_LanguageSnapshot-en", F.col("d.refset"), F.col("description_id"), [F.col("d.acceptability")], F.col("description_id"))
    members(lambda: c.concept.select("module_id").distinct(), ["sourceEffectiveTime", "targetEffectiveTime"], "der2_ssRefset_ModuleDependencySnapshot", lit(MODULE_DEPENDENCY), F.col("module_id"), [F.lit(date), F.lit(date)], F.col("module_id"))
    members(lambda: c.association, ["targetComponentId"], "der2_cRefset_AssociationSnapshot", F.col("refset"), F.col("source"), [F.col("target")], F.col("source"), F.col("target"))
    declared = []
    for refset, fields in c.schema_of.items():
        fields = list(fields.values())
        letters = "".join(LETTER_OF.get(kind, "s") for _, kind in fields)
        rows = lambda refset=refset: c.member.filter(F.col("refset") == refset).join(known.withColumnRenamed("concept_id", "referenced"), "referenced", "left_semi")
        members(rows, [f for f, _ in fields], f"der2_{letters}Refset_Own{refset}Snapshot", F.col("refset"), F.col("referenced"), [plain(F.try_element_at("fields", F.lit(f))) for f, _ in fields], F.col("row_no"), time=F.col("effective_time"), on=flag("active"))
        declared += [(refset, CONCEPT_TYPE, 0), *[(refset, TYPE_OF[kind], i + 1) for i, (_, kind) in enumerate(fields)]]
    descriptors = spark.createDataFrame(declared, "refset bigint, type bigint, pos int")
    members(lambda: descriptors, ["attributeDescription", "attributeType", "attributeOrder"], "der2_cciRefset_RefsetDescriptorSnapshot", lit(DESCRIPTORS), F.col("refset"), [F.col("type"), F.col("type"), F.col("pos")], F.col("refset"), F.col("pos"))
    return out


def write_release(catalog: Catalog, folder: str, date: int, module: int, further: list[int] = ()) -> None:
    """An extracted archive below ``folder``, of the files of :func:`release_files`."""
    for name, rows in release_files(catalog, date, module, further).items():
        _file(*rows(), f"{folder}/{name}")
    _put(catalog.spark, f"{folder}/{PACKAGE}", json.dumps({"effectiveTime": str(date)}))


class ReleaseArchive(Archive):
    """A catalog's release files below ``folder``, each written when the import comes to it and deleted when its rows are stored.

    So a release that is imported once need not lie on disk as a whole. A file is a folder of compressed parts.
    """

    def __init__(self, catalog: Catalog, folder: str, date: int, module: int, further: list[int] = ()):
        self.spark, self.path, self.zip = catalog.spark, folder, None
        self.files, self.written = release_files(catalog, date, module, further), set()
        _put(self.spark, f"{folder}/{PACKAGE}", json.dumps({"effectiveTime": str(date)}))
        self.seen = inspected([*self.files, PACKAGE], "", lambda name: _package_date(local(folder), name))

    def first_line(self, name: str) -> str:
        return _start(local(self.place(name)), HEADER)

    def place(self, name: str) -> str:
        if name not in self.written:
            _parts(*self.files[name](), f"{self.path}/{name}")
            self.written.add(name)
        return f"{self.path}/{name}"

    def stored(self, names: Iterable[str]) -> None:
        for name in self.written & {*names}:
            _delete(self.spark, f"{self.path}/{name}")
            self.written.remove(name)


__all__ = ["ReleaseArchive", "release_files", "write_release"]

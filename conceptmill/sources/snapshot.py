"""Import a terminology Snapshot archive (RF2 files in a ZIP, or an extracted folder) into a catalog."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as fixed
from ..catalog import Catalog, Config, build_closure, is_concept_id
from ..functions import decimals
from ..operators.schema_drift import STANDARD
from ..session import _delete, cut as stored_cut, drop, lookup_join, run_folder, sweep

# Columns of the core files and identifiers of the descriptor model
COLUMNS = {
    "sct2_Concept_": "id effectiveTime active moduleId definitionStatusId",
    "sct2_Relationship_": "id effectiveTime active moduleId sourceId destinationId relationshipGroup typeId characteristicTypeId modifierId",
    "sct2_RelationshipConcreteValues_": "id effectiveTime active moduleId sourceId value relationshipGroup typeId characteristicTypeId modifierId",
    "sct2_Description_": "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId",
    "sct2_TextDefinition_": "id effectiveTime active moduleId conceptId languageCode typeId term caseSignificanceId",
}
REQUIRED = ["sct2_Concept_", "sct2_Relationship_", "sct2_RelationshipConcreteValues_", "sct2_Description_", "der2_cRefset_Language", "der2_ssRefset_ModuleDependency"]
PACKAGE = "release_package_information.json"
SIMPLE_REFSET, DEPENDENCIES, MODULE_DEPENDENCY = "der2_Refset_", "der2_ssRefset_ModuleDependency", 900000000000534007
LINE_LIMIT = 16 << 20
#: Runs of growing ids in one task's rows, and suspects of :meth:`Checks.once`, up to which the quicker proof is tried.
RUNS, FEW = 256, 1000
IDENTIFIER_ORDERS = ["alternateIdentifier effectiveTime active moduleId identifierSchemeId referencedComponentId", "identifierSchemeId alternateIdentifier effectiveTime active moduleId referencedComponentId"]
DATATYPES = [("number", 1119403002), ("time", 900000000000475002), ("uuid", 900000000000474003), ("uuid", 900000000000464001), ("integer", 900000000000476001), ("text", 1119460002), ("id", 900000000000460005)]
CONCEPT_TYPE, DESCRIPTION_TYPE, RELATIONSHIP_TYPE = 900000000000461009, 900000000000462002, 900000000000463007
LETTERS = {"c": "id", "i": "integer", "s": "text"}
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


class ImportFailure(Exception):
    """The archive breaks a rule; the message names the file and the rule."""


@dataclass
class Inspection:
    """What an archive holds, before anything is imported: ``date`` is the package's, ``missing`` and ``duplicated`` are file kinds."""

    checksum: str
    date: int | None
    files: dict[str, list[str]]
    missing: list[str]
    duplicated: list[str]

    @property
    def importable(self) -> bool:
        return not self.missing and not self.duplicated


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _far(path: str) -> bool:
    """Whether a folder lies in another file system than the driver's."""
    return "://" in path and not path.startswith("file://")


def _opened(path: str, name: str | None = None):
    """A far file system and a path in it."""
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path if name is None else f"{path}/{name}")
    return spark._jvm, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(path: str) -> list[str]:
    if _far(path):
        _, fs, at = _opened(path)
        found, out, root = fs.listFiles(at, True), [], fs.makeQualified(at).toString()
        while found.hasNext():
            out.append(found.next().getPath().toString()[len(root) + 1 :])
        return out
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            return [n for n in z.namelist() if not n.endswith("/")]
    root = Path(path)
    return [p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()]


def _start(path: str, name: str) -> str:
    """The first line of a file of the archive; of a far one without a limit to its length."""
    if _far(path):
        jvm, fs, at = _opened(path, name)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
        line = reader.readLine() or ""
        reader.close()
        return line.removeprefix("\ufeff")
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z, z.open(name) as f:
            line = f.readline(LINE_LIMIT)
    else:
        with open(Path(path) / name, "rb") as f:
            line = f.readline(LINE_LIMIT)
    return line.decode("utf-8-sig").rstrip("\r\n")


def _package_date(path: str, name: str) -> int | None:
    if _far(path):
        text = _start(path, name)
    elif zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z, z.open(name) as f:
            text = f.read(1 << 20)
    else:
        text = (Path(path) / name).read_bytes()[: 1 << 20]
    try:
        return int(json.loads(text)["effectiveTime"])
    except (ValueError, KeyError, TypeError):
        return None


def local(path: str) -> str:
    return path.removeprefix("file://")


def inspect(path: str) -> Inspection:
    """File names by kind, the release date that the package states, and what is missing or there twice."""
    checksum = sha256_of(path) if not _far(path) and Path(path).is_file() else ""
    return inspected(_names(path), checksum, lambda name: _package_date(path, name))


def inspected(every: list[str], checksum: str, dated: Callable[[str], int | None]) -> Inspection:
    """As :func:`inspect`, of file names; ``dated`` reads the date of the package's description."""
    snapshot = [n for n in every if "/Snapshot/" in "/" + n and n.endswith(".txt")]
    files: dict[str, list[str]] = {p: sorted(n for n in snapshot if PurePosixPath(n).name.startswith(p)) for p in [*COLUMNS, *REQUIRED, "sct2_Identifier_"]}
    files["refset"] = sorted(n for n in snapshot if re.match(r"der2_[cis]*Refset_", PurePosixPath(n).name))
    files[PACKAGE] = sorted(n for n in every if PurePosixPath(n).name == PACKAGE)
    date = dated(files[PACKAGE][0]) if len(files[PACKAGE]) == 1 else None
    needed = [*REQUIRED, PACKAGE]
    return Inspection(checksum, date, files, [p for p in needed if not files[p]], [p for p in needed if len(files[p]) > 1])


class Archive:
    """Files of an archive, members of a ZIP copied to the shared folder, one at a time, so that executors can read them."""

    def __init__(self, spark: SparkSession, path: str, work: str | None = None):
        self.spark, self.path, self.work = spark, path, work or f"{run_folder(spark)}/import-{uuid.uuid4().hex}"
        self.zip = zipfile.ZipFile(path) if not _far(path) and zipfile.is_zipfile(path) else None

    def first_line(self, name: str) -> str:
        return _start(self.path, name)

    def copy(self, name: str) -> str:
        return f"{self.work}/{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}.txt"

    def stored(self, names: Iterable[str]) -> None:
        """The rows of these files are in tables: their copies go."""
        for name in names if self.zip else ():
            _delete(self.spark, self.copy(name))

    def place(self, name: str) -> str:
        if _far(self.path):
            return f"{self.path}/{name}"
        if not self.zip:
            return f"file://{Path(self.path).absolute() / name}"
        target = self.copy(name)
        jvm = self.spark._jvm
        to = jvm.org.apache.hadoop.fs.Path(target)
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(to):
            with tempfile.NamedTemporaryFile() as out:  # on the driver only, for the copy
                with self.zip.open(name) as source:
                    shutil.copyfileobj(source, out, 1 << 20)
                out.flush()
                fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{out.name}"), to)
        return target

    def rows(self, name: str, columns: list[str]) -> DataFrame:
        """Rows of a tab-separated file as text columns; a line with another number of columns, or an overlong one, fails the job."""
        header = self.first_line(name)
        v = F.col("value")
        lines = self.spark.read.text(self.place(name)).withColumn("value", F.when(v.startswith("\ufeff") | v.endswith("\r"), F.regexp_replace(v, "^\\x{feff}|\\r$", "")).otherwise(v))
        lines = lines.filter((v != header) & (v != "")).select("value", F.split(v, "\t", -1).alias("cells"))
        fault = F.when(F.octet_length(v) > LINE_LIMIT, "a line is too long: ").otherwise(f"{len(columns)} columns expected: ")
        sound = (F.octet_length(v) <= LINE_LIMIT) & (F.size("cells") == len(columns))
        checked = F.when(sound, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), fault, F.substring(v, 1, 200))))
        return lines.select(checked.alias("c")).select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])

    def core(self, prefix: str, name: str) -> DataFrame:
        want = COLUMNS[prefix].split()
        if self.first_line(name).split("\t") != want:
            raise ImportFailure(f"{name}: the header is not {' '.join(want)}")
        return self.rows(name, want)


def cut(df: DataFrame) -> DataFrame:
    return stored_cut(df, compression="zstd")


def _long(name: str) -> Column:
    return F.col(name).cast("bigint")


def _date(name: str) -> Column:
    """YYYYMMDD as a number; empty is NULL, an impossible date fails."""
    text = F.col(name)
    return F.when(text == "", F.lit(None)).when(F.try_to_date(text, "yyyyMMdd").isNotNull(), text.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no such date: "), text))).cast("int")


def _active() -> Column:
    return F.when(F.col("active") == "1", True).when(F.col("active") == "0", False).otherwise(F.raise_error(F.concat(F.lit("active is neither 0 nor 1: "), F.col("active"))))


def _check(df: DataFrame, message: str) -> None:
    bad = df.limit(1).collect()
    if bad:
        raise ImportFailure(f"{message}: {bad[0][0]}")


class Checks:
    """Rules of one stage, looked at together in one job: rows that should not be there, with what they mean.

    ``known`` has (concept_id, active); all ids that must be there are looked up in it by one join.
    """

    def __init__(self):
        self.waiting: list[tuple[str, DataFrame | None]] = []
        self.named: list[DataFrame] = []
        self.known: DataFrame | None = None

    def __call__(self, df: DataFrame, message: str) -> None:
        self.waiting.append((message, df))

    def concepts(self, df: DataFrame, column: str, message: str, active: bool = False) -> None:
        """Each value of the column must be a concept, or an active one."""
        self.named.append(df.select(F.col(column).alias("concept_id")).distinct().select(F.lit(len(self.waiting)).alias("rule"), F.lit(active).alias("alive"), "concept_id"))
        self.waiting.append((message, None))

    def once(self, df: DataFrame, column: str, message: str) -> None:
        """No text stands twice: only those of equal 64-bit hashes are compared."""
        hashed = F.xxhash64(column)
        suspects = [r[0] for r in df.groupBy(hashed.alias("h")).count().filter("count > 1").select("h").limit(FEW + 1).collect()]
        if suspects:
            few = df if len(suspects) > FEW else df.filter(hashed.isin(suspects))
            self(few.groupBy(column).count().filter("count > 1"), message)

    def settle(self) -> None:
        """Refuse the archive for all rules, in the order they were given, that any row breaks, each with one such row."""
        parts = [df.select(F.lit(i).alias("rule"), F.col(df.columns[0]).cast("string").alias("row")).limit(1) for i, (_, df) in enumerate(self.waiting) if df is not None]
        if self.named:
            looked_up = reduce(DataFrame.unionByName, self.named).join(self.known.select("concept_id", F.col("active").alias("is_active")), "concept_id", "left")
            wrong = looked_up.filter(F.col("is_active").isNull() | (F.col("alive") & ~F.col("is_active")))
            parts.append(wrong.groupBy("rule").agg(F.min("concept_id").cast("string").alias("row")))
        broken = reduce(DataFrame.unionByName, parts).collect() if parts else []
        if broken:
            raise ImportFailure("; ".join(f"{self.waiting[rule][0]}: {row}" for rule, row in sorted(broken, key=lambda r: r[0])))
        self.waiting, self.named = [], []


def _runs(batches):
    """(lo, hi) of the runs of growing numbers in a task's rows, or one NULL row if there are too many, or NULL among them."""
    import numpy as np
    import pyarrow as pa

    out: list[list[int]] = []
    broken = False
    for batch in batches:
        if broken or not batch.num_rows:
            continue
        if batch.column(0).null_count:
            broken = True
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(ids[1:] <= ids[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(ids)])) - 1
        if len(out) + len(starts) > RUNS:
            broken = True
            continue
        runs = [[int(ids[a]), int(ids[b])] for a, b in zip(starts, ends)]
        if out and out[-1][1] < runs[0][0]:
            out[-1][1] = runs.pop(0)[1]
        out += runs
    schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array([None] if broken else [x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)


def grow_apart(ids: DataFrame) -> bool:
    """Whether the numbers, as they lie in their files, are runs of growing ones with no overlap, so that none stands twice. Nothing is shuffled."""
    runs = ids.mapInArrow(_runs, "lo bigint, hi bigint").collect()
    if any(r.lo is None for r in runs):
        return False
    runs = sorted((r.lo, r.hi) for r in runs)
    return all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def header_of(archive: Archive, name: str, repairs: list[str]) -> list[str]:
    """The own fields of a reference set file; the first six columns stand by position and may differ in case, or be called mapSource."""
    header = archive.first_line(name).split("\t")
    if len(header) < len(STANDARD):
        raise ImportFailure(f"{name}: fewer than six columns")
    for want, got in zip(STANDARD, header):
        if got != want:
            if got.lower() != want.lower() and not (want == "referencedComponentId" and got.lower() == "mapsource"):
                raise ImportFailure(f"{name}: {got} where {want} belongs")
            repairs.append(f"{PurePosixPath(name).name}: read {got} as {want}")
    own = [re.sub(r"\s", "", c) for c in header[len(STANDARD) :]]
    letters = re.match(r"der2_([cis]*)Refset", PurePosixPath(name).name).group(1)
    if len(letters) != len(own):
        raise ImportFailure(f"{name}: the name promises {len(letters)} own fields, the header has {len(own)}")
    if len(own) > 64 or len({c.lower() for c in own}) < len(own) or not all(re.fullmatch("[A-Za-z]+", c) for c in own):
        raise ImportFailure(f"{name}: field names are not letters only, unique, and 64 at most")
    return own


def _members(archive: Archive, names: Iterable[str], repairs: list[str]) -> tuple[DataFrame | None, list[tuple[str, list[str]]]]:
    """All member rows of the files as one table, and the own fields of each file."""
    parts, fields = [], []
    for name in names:
        own = header_of(archive, name, repairs)
        rows = archive.rows(name, [*STANDARD, *(f"f_{c}" for c in own)])
        cells = [x for c in own for x in (F.lit(c), F.col(f"f_{c}"))]
        told = F.create_map(*cells) if cells else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        parts.append(rows.select(F.lower("id").alias("member_id"), F.lit(PurePosixPath(name).name).alias("file"), _long("refsetId").alias("refset"), F.monotonically_increasing_id().alias("row_no"), _date("effectiveTime").alias("effective_time"), _active().alias("active"), _long("moduleId").alias("module_id"), _long("referencedComponentId").alias("referenced"), told.alias("fields")))
        fields.append((PurePosixPath(name).name, own))
    return (reduce(DataFrame.unionByName, parts) if parts else None), fields


def nearest_descriptors(refsets: DataFrame, descriptors: DataFrame, closure: DataFrame, check: Callable = _check) -> DataFrame:
    """(refset, pos, type): what the nearest descriptor at or above each reference set declares; disagreeing ones are refused.

    ``descriptors`` has (refset, type, pos).
    """
    near = descriptors.select(F.col("refset").alias("ancestor")).distinct()
    reach = refsets.select("refset").join(near.withColumnRenamed("ancestor", "refset"), "refset", "left_semi").select("refset", F.col("refset").alias("ancestor"), F.lit(0).alias("depth"))
    reach = reach.unionByName(closure.join(near, "ancestor", "left_semi").select(F.col("descendant").alias("refset"), "ancestor", "depth").join(refsets.select("refset"), "refset", "left_semi"))
    least = reach.groupBy("refset").agg(F.min("depth").alias("depth"))
    owners = reach.join(least, ["refset", "depth"]).select("refset", "ancestor")
    typed = cut(owners.join(descriptors.select(F.col("refset").alias("ancestor"), "type", "pos"), "ancestor").groupBy("refset", "pos").agg(F.collect_set("type").alias("types")))
    check(typed.filter(F.size("types") > 1).select("refset"), "nearest descriptors disagree for the reference set")
    return typed.select("refset", "pos", F.col("types")[0].alias("type"))


def _under(closure: DataFrame, bases: DataFrame) -> DataFrame:
    """``bases`` (base, ...) with (type) of everything at or below them."""
    below = closure.select(F.col("ancestor").alias("base"), F.col("descendant").alias("type")).unionByName(bases.select("base", F.col("base").alias("type")))
    return below.join(bases, "base")


def member_kinds(spark: SparkSession, tables: DataFrame, declared: DataFrame, closure: DataFrame, files: list[tuple[str, list[str]]], check: Callable = _check) -> DataFrame:
    """(refset, pos, field, kind): kinds by the nearest descriptor above, else by the letters of the file name.

    ``tables`` has (refset, file), one row per reference set; ``declared`` is of :func:`nearest_descriptors`.
    """
    kinds = spark.createDataFrame([(k, i) for k, i in DATATYPES], "kind string, base bigint")
    named = _under(closure, kinds).groupBy("type").agg(F.min("kind").alias("kind"))
    described = declared.filter("pos > 0").select("refset", (F.col("pos") - 1).alias("pos"), "type").join(named, "type", "left").select("refset", "pos", F.col("kind").alias("described"))
    own = [(f, i, c, LETTERS[re.match(r"der2_([cis]*)Refset", f).group(1)[i : i + 1]]) for f, cs in files for i, c in enumerate(cs)]
    letters = spark.createDataFrame(own, "file string, pos int, field string, letter string")
    counts = spark.createDataFrame([(f, len(cs)) for f, cs in files], "file string, n int")
    entries = declared.groupBy("refset").agg(F.count(F.lit(1)).alias("entries"))
    check(tables.join(counts, "file").join(entries, "refset").filter("entries <> n + 1").select("refset"), "descriptor and column count differ for the reference set")
    joined = tables.join(letters, "file").join(described, ["refset", "pos"], "left")
    kind = F.when(F.lower("field") == "grouped", "boolean").when(F.lower("field").isin("sourceeffectivetime", "targeteffectivetime"), "time").otherwise(F.coalesce("described", "letter"))
    return joined.select("refset", "pos", "field", kind.alias("kind"))


def refset_domains(kinds_of_rows: DataFrame, descriptors: DataFrame, declared: DataFrame, closure: DataFrame) -> DataFrame:
    """(refset, concept_based) by what the nearest descriptor declares of referenced components; a generic type, or none, leaves it to the rows.

    ``kinds_of_rows`` has (refset, of_concepts, of_others), numbers of rows of every status. A declared reference set without rows counts.
    """
    bases = descriptors.sparkSession.createDataFrame([(CONCEPT_TYPE, True), (DESCRIPTION_TYPE, False), (RELATIONSHIP_TYPE, False)], "base bigint, says boolean")
    said = declared.filter("pos = 0").join(_under(closure, bases).select("type", "says"), "type").groupBy("refset").agg(F.min("says").alias("says"))
    every = kinds_of_rows.select("refset").unionByName(descriptors.select("refset")).distinct()
    both = every.join(kinds_of_rows, "refset", "left").join(said, "refset", "left")
    by_rows = F.coalesce((F.col("of_concepts") > 0) | (F.col("of_others") == 0), F.lit(True))
    return both.select("refset", F.coalesce("says", by_rows).alias("concept_based"))


def edition_uris(catalog_concept: DataFrame, dependencies: DataFrame, date: int | None) -> tuple[list[str], int]:
    """Edition URIs that the module dependencies support, those first that no other module depends on, and the number of these.

    A module stands for an edition if its own dependency row carries the package's date.
    """
    rows = dependencies.filter("active").select("module_id", "referenced", F.col("source_time").cast("int").alias("t")).distinct()
    own = rows.filter(F.col("t") == F.lit(date)).select("module_id").distinct()
    needed = rows.filter("module_id <> referenced").select(F.col("referenced").alias("module_id")).distinct().withColumn("needed", F.lit(True))
    found = own.join(needed, "module_id", "left").join(catalog_concept.select(F.col("concept_id").alias("module_id")), "module_id", "left_semi").orderBy(F.col("needed").isNotNull(), "module_id").limit(1000).collect()
    return [f"http://snomed.info/sct/{r['module_id']}/version/{date}" for r in found], sum(r["needed"] is None for r in found)


EDITION = re.compile(r"http://snomed\.info/sct/([0-9]+)/version/([0-9]{8})")


def import_snapshot(spark: SparkSession, path: str | Archive, work: str | None = None, config: Config | None = None, expected_date: int | None = None, expected_checksum: str | None = None, progress: Callable[[str], None] = lambda stage: None, edition: str | None = None, base: Catalog | None = None) -> Catalog:
    """A catalog of the archive's rows, every rule of the release format checked.

    Files of a ZIP are copied to ``work``, by default a folder in the shared checkpoint folder. The result is
    written with :func:`conceptmill.catalog.save`. ``edition`` is a versioned edition URI, whose date must be the package's.
    With a ``base`` the archive is a supplement: it need not have all files or a package date (``expected_date`` says it), may
    refer to the base's concepts, and holds simple reference sets and the concepts, is-a links and descriptions that define them;
    :func:`add_refsets` puts both together.
    """
    progress("inspect")
    a = path if isinstance(path, Archive) else Archive(spark, local(path), work)
    seen = a.seen if a is path else inspect(a.path)
    if base is None and not seen.importable:
        raise ImportFailure(f"missing: {seen.missing}; more than once: {seen.duplicated}; merged packages cannot be imported")
    if base is not None and not any(PurePosixPath(n).name.startswith(SIMPLE_REFSET) for n in seen.files["refset"]):
        raise ImportFailure("a supplement needs a simple reference set file")
    if expected_checksum and seen.checksum != expected_checksum:
        raise ImportFailure("the checksum differs")
    date = expected_date if base is not None else seen.date
    if date is None:
        raise ImportFailure("the release states no date")
    if expected_date and date != expected_date:
        raise ImportFailure(f"the release is of {seen.date}")
    if edition and (not (told_edition := EDITION.fullmatch(edition)) or int(told_edition.group(2)) != date):
        raise ImportFailure(f"{edition} is no edition of {date}")
    check = Checks()
    every = lambda prefix: reduce(DataFrame.unionByName, [a.core(prefix, n) for n in seen.files[prefix]]) if seen.files[prefix] else spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[prefix].split()))

    def not_newer(df: DataFrame, what: str, column: str = "effective_time") -> None:
        check(df.filter(F.col(column) > date), f"{what} newer than the release")

    progress("concepts")
    concept = every("sct2_Concept_").select(_long("id").alias("concept_id"), _long("moduleId").alias("module_id"), _date("effectiveTime").alias("effective_time"), _active().alias("active"), F.when(_long("definitionStatusId").isin(fixed.DEFINED, fixed.PRIMITIVE), _long("definitionStatusId") == fixed.DEFINED).otherwise(F.raise_error(F.concat(F.lit("no definition status: "), F.col("definitionStatusId")))).alias("defined"))
    concept = cut(concept)
    a.stored(seen.files["sct2_Concept_"])
    check(concept.groupBy("concept_id").count().filter("count > 1"), "a concept has two rows")
    not_newer(concept, "a concept is")
    known = concept.select("concept_id", "active")
    if base is not None:
        check(concept.select("concept_id").join(base.concept, "concept_id", "left_semi"), "the supplement has a concept of the base")
        known = known.unionByName(base.concept.select("concept_id", "active"))
    elif not concept.limit(1).count():
        raise ImportFailure("the release has no concepts")
    ids, check.known = known.select("concept_id"), known
    check.concepts(concept, "module_id", "a concept's module is no concept")
    if edition:
        check.concepts(spark.createDataFrame([(int(told_edition.group(1)),)], "concept_id bigint"), "concept_id", "the edition's module is no concept")

    progress("relationships")
    stated = every("sct2_Relationship_").filter("active = '1'").filter(F.col("characteristicTypeId") == str(fixed.INFERRED))
    rel = cut(stated.select(_long("id").alias("id"), _date("effectiveTime").alias("effective_time"), _long("sourceId").alias("source"), F.col("relationshipGroup").cast("int").alias("grp"), _long("typeId").alias("type"), _long("destinationId").alias("target"), _long("modifierId").alias("modifier")))
    a.stored(seen.files["sct2_Relationship_"])
    not_newer(rel.select("id", "effective_time"), "a relationship is")
    check(rel.filter(F.col("modifier") != fixed.SOME_MODIFIER).select("id"), "another modifier than existential")
    check(rel.filter((F.col("type") == fixed.IS_A) & (F.col("grp") != 0)).select("id"), "an is-a row in a group")
    isa = cut(rel.filter(F.col("type") == fixed.IS_A).select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct())
    for end in ("child", "parent"):
        check.concepts(isa, end, "an is-a row of a concept that is not active", active=True)
    relationship = rel.filter(F.col("type") != fixed.IS_A).select("source", "grp", "type", "target")
    check.concepts(relationship, "source", "attributes of a concept that is not active", active=True)
    if base is not None:
        check(relationship, "a supplement defines concepts by is-a rows only")
        check(isa.select(F.col("child").alias("concept_id")).join(base.concept, "concept_id", "left_semi"), "the supplement changes the parents of a concept of the base")
    for end in ("type", "target"):
        check.concepts(relationship, end, f"the {end} of an attribute is no concept")
    closure = build_closure(isa if base is None else base.isa.select("child", "parent").unionByName(isa))
    # on a cycle are only concepts with others below them
    inner = cut(lookup_join(closure.select("ancestor", "descendant"), closure.select(F.col("ancestor").alias("descendant")).distinct(), ["descendant"], "left_semi"))
    turned = inner.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"))
    check(inner.select("ancestor", "descendant").join(turned, ["ancestor", "descendant"], "left_semi"), "a concept is below itself")
    check(isa.filter("child = parent"), "a concept is below itself")

    progress("concrete values")
    raw = every("sct2_RelationshipConcreteValues_").filter("active = '1'").filter(F.col("characteristicTypeId") == str(fixed.INFERRED))
    if base is not None:
        check(raw.select("id"), "a supplement defines concepts by is-a rows only")
    v = F.col("value")
    kind = F.when(v.startswith("#"), "number").when(v.rlike('^".*"$'), "text").when(F.lower(v).isin("true", "false"), "boolean").otherwise(F.raise_error(F.concat(F.lit("no concrete value: "), v)))
    canon = F.when(v.startswith("#"), decimals.canonical_column(F.substring(v, 2, 1 << 20))).when(v.rlike('^".*"$'), F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r"\\(.)", "$1")).otherwise(F.lower(v))
    literal = raw.select(_long("id").alias("id"), _date("effectiveTime").alias("effective_time"), _long("modifierId").alias("modifier"), _long("sourceId").alias("source"), F.col("relationshipGroup").cast("int").alias("grp"), _long("typeId").alias("type"), kind.alias("kind"), canon.alias("canon"))
    literal = cut(literal.withColumn("num_key", F.when(F.col("kind") == "number", decimals.key_column(F.col("canon")))))
    a.stored(seen.files["sct2_RelationshipConcreteValues_"])
    not_newer(literal.select("id", "effective_time"), "a concrete value is")
    check(literal.filter(F.col("modifier") != fixed.SOME_MODIFIER).select("id"), "another modifier than existential")
    concrete = literal.select("source", "grp", "type", "kind", "canon", "num_key")
    both = rel.select("id").unionByName(literal.select("id"))
    if not grow_apart(both):
        check(both.groupBy("id").count().filter("count > 1"), "a relationship id is used twice")

    check.settle()
    drop(inner)
    sweep(spark)

    progress("reference sets")
    repairs: list[str] = []
    names = seen.files["refset"]
    language = [n for n in names if "Refset_Language" in n]
    dependency = [n for n in names if PurePosixPath(n).name.startswith(DEPENDENCIES)]
    chosen = [n for n in names if n not in language] if base is None else [n for n in names if PurePosixPath(n).name.startswith(SIMPLE_REFSET)]
    typed, files = _members(a, chosen, repairs)
    typed = cut(typed) if typed is not None else spark.createDataFrame([], "member_id string, file string, " + fixed.SCHEMAS["member"])
    a.stored(n for n in chosen if n not in dependency)
    check.once(typed, "member_id", "a member id is used twice")
    check(typed.filter(~F.col("member_id").rlike(UUID)).select("member_id"), "a member id is no UUID")
    not_newer(typed.select("member_id", "effective_time"), "a member is")
    tables = cut(typed.groupBy("refset").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file")))
    check(tables.filter("n > 1"), "a reference set is in two files")
    for end in ("refset", "module_id"):
        check.concepts(typed, end, f"the {end} of a member is no concept")
    if base is not None:
        check(tables.select("refset").join(base.member.select("refset").distinct(), "refset", "left_semi"), "the supplement has rows of a reference set of the base")
        check(typed.filter(~is_concept_id(F.col("referenced"))).select("member_id"), "a supplement holds reference sets of concepts only")
    check.concepts(typed.filter(F.col("active") & is_concept_id(F.col("referenced"))), "referenced", "a member refers to a concept that does not exist")
    value = lambda n: F.try_element_at("fields", F.lit(n))
    descriptors = cut(typed.filter(F.col("file").contains("RefsetDescriptor") & F.col("active")).select(F.col("referenced").alias("refset"), value("attributeType").cast("bigint").alias("type"), value("attributeOrder").cast("int").alias("pos")))
    declared = nearest_descriptors(tables.select("refset").unionByName(descriptors.select("refset")).distinct(), descriptors, closure, check)
    kinds = cut(member_kinds(spark, tables.select("refset", "file"), declared, closure, files, check))
    # rows that refer to other components than concepts count for the domain only
    member = typed.filter(is_concept_id(F.col("referenced"))).select("refset", "row_no", "effective_time", "active", "module_id", "referenced", "fields")
    component = F.pmod(F.floor(F.col("referenced") / 10), F.lit(10))
    counted = lambda test: F.count(F.when(test, 1))
    row_kinds = typed.groupBy("refset").agg(counted(is_concept_id(F.col("referenced"))).alias("of_concepts"), counted(~is_concept_id(F.col("referenced"))).alias("of_others"))

    progress("module dependencies")
    dependencies, _ = _members(a, dependency, [])
    if dependencies is not None:
        time = lambda n: F.coalesce(value(n), F.lit(""))
        dependencies = cut(dependencies.select("member_id", "effective_time", "active", "module_id", "referenced", time("sourceEffectiveTime").alias("source_time"), time("targetEffectiveTime").alias("target_time")))
        a.stored(dependency)
        not_newer(dependencies.select("member_id", "effective_time"), "a module dependency is")
        for end in ("module_id", "referenced"):
            check.concepts(dependencies.filter("active"), end, "the package is not self-contained: a module that another depends on is no concept")
        if base is not None and base.manifest.get("date"):
            check(dependencies.filter("active").filter(F.col("target_time").try_cast("int") > base.manifest["date"]).filter(F.col("module_id") != F.col("referenced")).select("member_id"), "the supplement depends on a newer base")

    check.settle()
    sweep(spark)

    progress("descriptions")
    raw = every("sct2_Description_").unionByName(every("sct2_TextDefinition_"))
    text = cut(raw.select(_long("id").alias("description_id"), _long("conceptId").alias("concept_id"), _long("moduleId").alias("module_id"), _long("typeId").alias("type_id"), _date("effectiveTime").alias("effective_time"), _active().alias("active"), F.col("languageCode").alias("language"), "term"))
    a.stored([*seen.files["sct2_Description_"], *seen.files["sct2_TextDefinition_"]])
    check(text.groupBy("description_id").count().filter("count > 1"), "a description has two rows")
    not_newer(text.select("description_id", "effective_time"), "a description is")
    check(text.filter("term = ''").select("description_id"), "an empty term")
    check(text.filter(~F.col("language").rlike("^[a-z]{2}$")).select("description_id"), "a language code is not two lower-case letters")
    check.concepts(text, "concept_id", "a description of no concept")
    if base is not None:
        check(text.select("concept_id").join(base.concept, "concept_id", "left_semi"), "the supplement changes the descriptions of a concept of the base")
    spoken, _ = _members(a, language, repairs)
    none = F.lit(None).cast("array<struct<refset:bigint,acceptability:bigint>>")
    if spoken is not None:
        spoken = cut(spoken)
        a.stored(language)
        check.once(spoken, "member_id", "a language member id is used twice")
        not_newer(spoken.select("member_id", "effective_time"), "a language member is")
        check(spoken.filter("active").select(F.col("referenced").alias("description_id")).join(text, "description_id", "left_anti"), "a language member of no description")
        tagged = spoken.filter("active").groupBy(F.col("referenced").alias("description_id")).agg(F.collect_set(F.struct("refset", value("acceptabilityId").cast("bigint").alias("acceptability"))).alias("dialects"))
        description = text.join(tagged, "description_id", "left")
        row_kinds = row_kinds.unionByName(spoken.groupBy("refset").agg(F.lit(0).cast("long").alias("of_concepts"), F.count(F.lit(1)).alias("of_others")))
    else:
        description = text.withColumn("dialects", none)
    description = description.withColumn("dialects", F.coalesce("dialects", F.array().cast("array<struct<refset:bigint,acceptability:bigint>>")))
    domain = cut(refset_domains(row_kinds, descriptors, declared, closure))

    progress("identifiers")
    parts = [spark.createDataFrame([], fixed.SCHEMAS["identifier"])]
    for name in seen.files["sct2_Identifier_"]:
        order = a.first_line(name).replace("\t", " ")
        if order not in IDENTIFIER_ORDERS:
            raise ImportFailure(f"{name}: the header has another order")
        parts.append(a.rows(name, order.split()).select(_long("identifierSchemeId").alias("scheme"), F.col("alternateIdentifier").alias("code"), _long("referencedComponentId").alias("component"), _long("moduleId").alias("module_id"), _date("effectiveTime").alias("effective_time"), _active().alias("active")))
    identifier = cut(reduce(DataFrame.unionByName, parts))
    a.stored(seen.files["sct2_Identifier_"])
    whole = identifier.select("scheme", "code") if base is None else identifier.select("scheme", "code").unionByName(base.identifier.select("scheme", "code"))
    check(whole.groupBy("scheme", "code").count().filter("count > 1").select("code"), "an identifier is there twice")
    check(identifier.filter(F.col("code").rlike("[\\x00-\\x1f\\x7f]")).select("code"), "an identifier with control characters")
    not_newer(identifier.select("code", "effective_time"), "an identifier is")
    for end in ("scheme", "module_id"):
        check.concepts(identifier, end, f"the {end} of an identifier is no concept")
    check.concepts(identifier.filter(F.col("active") & is_concept_id(F.col("component"))), "component", "an identifier refers to a concept that does not exist")

    check.settle()
    sweep(spark)

    progress("history")
    kinds_of_history = closure.filter(F.col("ancestor") == fixed.ASSOCIATIONS).select(F.col("descendant").alias("refset"))
    told = member.filter("active").join(kinds_of_history, "refset", "left_semi").select("refset", F.col("referenced").alias("source"), value("targetComponentId").cast("bigint").alias("target")).distinct()
    resolved = lambda df, end: df.join(ids.withColumnRenamed("concept_id", end), end, "left_semi")
    association = resolved(resolved(told, "source"), "target").select("refset", "source", "target")

    uris, roots = edition_uris(ids, dependencies, date) if dependencies is not None else ([], 0)
    rows_of = typed.agg(counted(is_concept_id(F.col("referenced"))), counted(component == 1), counted(component == 2)).first()
    manifest = {
        "date": date, "archive_sha256": seen.checksum, "header_repairs": repairs, "concept_count": concept.count(), "active_concept_count": concept.filter("active").count(), "history_skipped": told.count() - association.count(),
        "edition": edition or (uris[0] if roots == 1 else None), "edition_uris": uris, "root_editions": roots, "member_rows": dict(zip(("concept", "description", "relationship"), rows_of)),
    }
    made = {"concept": concept, "isa": isa, "relationship": relationship, "concrete": concrete, "member": member, "member_schema": kinds, "refset_domain": domain, "description": description, "association": association, "identifier": identifier}
    if base is None:
        made["closure"] = closure
    progress("done")
    return Catalog(spark, {k: (lambda v=v: v) for k, v in made.items()}, config, manifest)


def module_check(catalog: Catalog) -> DataFrame:
    """Modules that rows name but that are no concepts."""
    used = catalog.concept.select("module_id").unionByName(catalog.description.select("module_id")).distinct()
    return used.join(catalog.concept.select(F.col("concept_id").alias("module_id")), "module_id", "left_anti")


def edition_candidates(catalog: Catalog) -> DataFrame:
    """Modules with concepts that no other module's concept is the module of: the roots among the editions."""
    modules = catalog.concept.select("module_id").distinct()
    own = catalog.concept.select(F.col("concept_id").alias("module_id"), F.col("module_id").alias("holder")).join(modules, "module_id", "left_semi").filter("module_id <> holder")
    return modules.join(own.select(F.col("holder").alias("module_id")).distinct().join(modules, "module_id", "left_semi"), "module_id", "left_anti")


def add_refsets(base: Catalog, extra: Catalog) -> Catalog:
    """The base with the reference sets, new concepts and is-a links of a supplement; nothing of the base may change.

    A reference set, concept or description of both, or an archive that is in already, is a conflict; the closure is built anew.
    """
    checksum = extra.manifest.get("archive_sha256")
    if checksum and checksum in [base.manifest.get("archive_sha256"), *(s.get("archive_sha256") for s in base.manifest.get("supplements", []))]:
        raise ImportFailure("this supplement is in the base already")
    for name, key in (("concept", "concept_id"), ("description", "description_id")):
        _check(getattr(extra, name).select(key).join(getattr(base, name), key, "left_semi"), f"the supplement has a {name} of the base")
    _check(extra.member.select("refset").distinct().join(base.member.select("refset").distinct(), "refset", "left_semi"), "the supplement has rows of a reference set of the base")
    sources = {n: (lambda n=n: getattr(base, n).unionByName(getattr(extra, n))) for n in fixed.SCHEMAS if n != "isa"}
    ends = base.concept.filter("active").select("concept_id").unionByName(extra.concept.filter("active").select("concept_id"))
    isa = cut(base.isa.unionByName(extra.isa).distinct())
    for end in ("child", "parent"):
        _check(isa.select(F.col(end).alias("concept_id")).join(ends, "concept_id", "left_anti"), "an is-a row of a concept that is not active")
    sources["isa"] = lambda: isa
    supplements = [*base.manifest.get("supplements", []), {"date": extra.manifest.get("date"), "archive_sha256": checksum, "added_concepts": extra.manifest.get("concept_count")}]
    counts = {n: (base.manifest.get(n) or 0) + (extra.manifest.get(n) or 0) for n in ("concept_count", "active_concept_count") if n in base.manifest}
    return Catalog(base.spark, sources, base.config, base.manifest | counts | {"supplements": supplements})

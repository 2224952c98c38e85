"""Fields that are added, removed, renamed or retyped between the files of a series."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, skew_join, told
from .hierarchy import last_of_series

#: The standard names of the first six header columns, by position.
STANDARD = ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId"]
#: Registers of a column's value sketch.
REGISTERS = 16
#: The bits of a register that are the member's hash; the rest are the value's.
MEMBER_BITS = -256
#: Characters of all header columns that may be broadcast.
HEADER_CHARS = 4_000_000
#: Candidate edges that may be broadcast, by number: some 20 MB.
EDGES = 100_000
TYPES = ["integer", "decimal", "boolean", "text"]


@dataclass
class Drift:
    """``columns``: file, series, position, name. ``steps``: file, previous.
    ``matches``: file, previous, name, old_name. ``profiles``: file, name, type. ``changes``: file, change_kind, field_name, old_name."""

    columns: DataFrame
    steps: DataFrame
    matches: DataFrame
    profiles: DataFrame
    changes: DataFrame


def headers(files: DataFrame) -> DataFrame:
    """(file, position, written): the header as written, without a byte-order mark. ``files`` has (file, header)."""
    cells = files.select("file", F.posexplode("header").alias("position", "written"))
    return cells.withColumn("written", F.when(F.col("position") == 0, F.regexp_replace("written", "^﻿", "")).otherwise(F.col("written")))


def repaired(cells: DataFrame) -> DataFrame:
    standard = F.element_at(F.array(*map(F.lit, STANDARD)), F.col("position") + 1)
    fixed = cells.filter(F.col("position") < len(STANDARD)).withColumn("field_name", standard)
    return fixed.filter(~F.col("written").eqNullSafe(F.col("field_name"))).select("file", F.lit("repaired").alias("change_kind"), "field_name", F.coalesce("written", F.lit("")).alias("old_name"))


def own_columns(cells: DataFrame) -> DataFrame:
    """(file, position, name): the own fields; of equal names in one header the first holds."""
    own = cells.filter(F.col("position") >= len(STANDARD)).select("file", "position", F.lower(F.regexp_replace(F.coalesce("written", F.lit("")), r"(?U)\s", "")).alias("name"))
    return own.groupBy("file", "name").agg(F.min("position").alias("position"))


def _strip(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _cells(lines: DataFrame, *further: str) -> DataFrame:
    """(file, further, cells, member) of the lines that hold anything."""
    cells = lines.filter(F.col("line").isNotNull()).select("file", *further, F.split("line", "\t").alias("cells"))
    return cells.withColumn("member", _strip(F.get("cells", F.lit(0)))).filter((F.col("member") != "") | (F.size("cells") > 1))


def _value(position) -> Column:
    return _strip(F.coalesce(F.get("cells", position), F.lit("")))


def cell_values(lines: DataFrame, last: int) -> DataFrame:
    """(file, position, member, value) of the own cells up to position ``last``, and for every line an empty one at position 0. ``lines`` has (file, line): tab-separated, unparsed.

    Blank lines hold nothing. Headers aren't needed, so no line is moved; what a line lacks at its end is settled by :func:`filled`.
    """
    own = F.slice("cells", len(STANDARD) + 1, max(0, last + 1 - len(STANDARD)))
    each = _cells(lines).select("file", "member", F.posexplode(F.concat(F.array(F.lit("")), own)).alias("n", "value"))
    return each.select("file", F.when(F.col("n") > 0, F.col("n") + (len(STANDARD) - 1)).otherwise(0).alias("position"), "member", _strip(F.col("value")).alias("value"))


def profile(values: DataFrame, column: str = "name") -> DataFrame:
    """(file, column, sketch, type) in one hash aggregation of numbers, of which each task sends one row per column.

    Register j of the sketch holds the least member hash among the members of register j, its
    last bits replaced by the value's hash. As members choose the register, the sketches of two columns hold values of
    the same members wherever the files share them: a differing value under an equal member disproves equality. A member
    with several values is no proof of a rename, so any of them may stand in the sketch.
    """
    hm, v = F.xxhash64("member"), F.col("value")
    kept = _member(hm).bitwiseOR(F.xxhash64("value").bitwiseAND(F.lit(~MEMBER_BITS).cast("long")))
    fits = F.when(v == "", None).when(v.rlike(r"^[+-]?[0-9]+$"), 3).when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), 2).when(v.rlike("^(?i)(true|false)$"), 4).otherwise(0)
    rows = values.select("file", column, F.pmod(hm, F.lit(REGISTERS)).alias("register"), kept.alias("kept"), fits.alias("fits"))
    registers = [F.min(F.when(F.col("register") == j, F.col("kept"))).alias(f"r{j}") for j in range(REGISTERS)]
    profiled = rows.groupBy("file", column).agg(*registers, F.bit_and("fits").alias("fits"))
    bit = lambda b: F.col("fits").bitwiseAND(F.lit(b)) != 0
    kind = F.when(bit(1), "integer").when(bit(2), "decimal").when(bit(4), "boolean").when(F.col("fits").isNotNull(), "text")
    return profiled.select("file", column, F.array(*[f"r{j}" for j in range(REGISTERS)]).alias("sketch"), kind.alias("type"))


def _member(register: Column) -> Column:
    return register.bitwiseAND(F.lit(MEMBER_BITS).cast("long"))


def filled(sketch: str, base: str) -> Column:
    """The sketch in which cells that lines lack count as empty; ``base`` is the file's sketch of an empty column, with every member."""
    return F.zip_with(sketch, base, lambda r, b: F.when(_member(r) == _member(b), r).otherwise(b))


def profile_columns(lines: DataFrame, columns: DataFrame, edges: DataFrame, last: int) -> DataFrame:
    """(file, name, sketch, type) of the columns that any line reaches; only those of ``edges`` have their sketch. The row without a name is the file's empty column."""
    sides = edges.select("file", "name").unionByName(edges.select(F.col("previous").alias("file"), F.col("old_name").alias("name"))).distinct()
    wanted = columns.select("file", "position", "name").join(sides.withColumn("asked", F.lit(True)), ["file", "name"], "left")
    bases = sides.select("file").distinct().select("file", F.lit(0).alias("position"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("asked"))
    profiled = profile(cell_values(lines, last), "position").join(wanted.unionByName(bases), ["file", "position"])
    return profiled.select("file", "name", F.when(F.col("asked"), F.col("sketch")).alias("sketch"), "type")


def name_similarity(a, b):
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def best_assignment(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight bipartite matching by successive best augmenting paths; all weights are positive."""
    left = sorted({a for a, _ in weights})
    mate: dict[str, str] = {}
    while True:
        # Bellman-Ford over alternating paths from all free left nodes
        gain = {("l", a): (0.0, None) for a in left if a not in mate.values()}
        changed = True
        while changed:
            changed = False
            for (a, b), w in weights.items():
                if ("l", a) in gain and mate.get(b) != a and gain[("l", a)][0] + w > gain.get(("r", b), (float("-inf"), None))[0] + 1e-12:
                    gain[("r", b)] = (gain[("l", a)][0] + w, ("l", a))
                    changed = True
            for b, a in mate.items():
                if ("r", b) in gain and gain[("r", b)][0] - weights[(a, b)] > gain.get(("l", a), (float("-inf"), None))[0] + 1e-12:
                    gain[("l", a)] = (gain[("r", b)][0] - weights[(a, b)], ("r", b))
                    changed = True
        free = [(g[0], b) for (side, b), g in gain.items() if side == "r" and b not in mate]
        if not free or max(free)[0] <= 0:
            return sorted((a, b) for b, a in mate.items())
        b = max(free)[1]
        while True:
            a = gain[("r", b)][1][1]
            came = gain[("l", a)][1]
            mate[b] = a
            if came is None:
                break
            b = came[1]


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    chosen = set(best_assignment({(o, n): w for o, n, w in zip(pdf.old_name, pdf.name, pdf.weight)}))
    return pdf[[(o, n) in chosen for o, n in zip(pdf.old_name, pdf.name)]][["file", "previous", "name", "old_name"]]


def possible_edges(columns: DataFrame, steps: DataFrame) -> DataFrame:
    """(file, previous, name, old_name): names only in the later with names only in the earlier header; their number is bounded by the header widths."""
    names = columns.groupBy("file").agg(F.collect_set("name").alias("names"))
    sides = steps.filter(F.col("previous").isNotNull()).join(names, "file", "left").join(names.select(F.col("file").alias("previous"), F.col("names").alias("old_names")), "previous", "left")
    empty = F.array().cast("array<string>")
    only = sides.select("file", "previous", F.array_except(F.coalesce("names", empty), F.coalesce("old_names", empty)).alias("new"), F.array_except(F.coalesce("old_names", empty), F.coalesce("names", empty)).alias("old"))
    return only.select("file", "previous", "old", F.explode("new").alias("name")).select("file", "previous", "name", F.explode("old").alias("old_name"))


def match_columns(columns: DataFrame, edges: DataFrame, profiles: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, previous, name, old_name): renamed fields of consecutive files.

    An edge needs agreeing
    sketches and then, exactly, equal values for every member of both files, one of them not
    empty. Edges weigh name similarity, type and sketch support; a maximum-weight matching per pair
    of headers settles ambiguous ones.
    """
    bases = profiles.filter(F.col("name").isNull()).select("file", F.col("sketch").alias("base"))
    slim = profiles.filter(F.col("type").isNotNull() & F.col("name").isNotNull() & F.col("sketch").isNotNull()).join(bases, "file").select("file", "name", filled("sketch", "base").alias("sketch"), "type")
    sketched = edges.join(slim, ["file", "name"]).join(slim.select(F.col("file").alias("previous"), F.col("name").alias("old_name"), F.col("sketch").alias("old_sketch"), F.col("type").alias("old_type")), ["previous", "old_name"])
    alike = lambda a, b: F.coalesce(_member(a) == _member(b), F.lit(False))
    shared = F.size(F.filter(F.zip_with("sketch", "old_sketch", alike), lambda x: x))
    sketched = sketched.withColumn("shared", shared).filter(~F.exists(F.zip_with("sketch", "old_sketch", lambda a, b: alike(a, b) & (a != b)), lambda x: x))
    weight = 1 + name_similarity(F.col("name"), F.col("old_name")) + F.when(F.col("type") == F.col("old_type"), 0.5).otherwise(0.0) + F.col("shared") / F.lit(4 * REGISTERS)
    candidates = cut(sketched.select("file", "previous", "name", "old_name", weight.alias("weight"), F.monotonically_increasing_id().alias("edge")), told={"n": F.count(F.lit(1))})
    # only the columns with candidates are read again, each value tagged with its edges by number and side; each side of an edge is some 16 bytes
    sides = candidates.select("file", "name", F.lit(True).alias("is_new"), "edge").unionByName(candidates.select(F.col("previous").alias("file"), F.col("old_name").alias("name"), F.lit(False).alias("is_new"), "edge"))
    asked = sides.join(columns, ["file", "name"]).groupBy("file").agg(F.collect_list(F.struct("position", "is_new", "edge")).alias("fields"))
    # beyond EDGES the lines are moved once, unparsed, those of files with very many lines apart
    tagged = lines.join(F.broadcast(asked), "file") if told(candidates, "n") <= EDGES else skew_join(lines, asked, "file", how="inner")
    sent = _cells(tagged, "fields").select("member", "cells", F.explode("fields").alias("f")).select("member", "f.is_new", "f.edge", _value(F.col("f.position")).alias("value"))
    new, old = F.when(F.col("is_new"), F.col("value")), F.when(~F.col("is_new"), F.col("value"))
    per_member = sent.groupBy("edge", "member").agg(F.min(new).alias("n0"), F.max(new).alias("n1"), F.min(old).alias("o0"), F.max(old).alias("o1")).filter(F.col("n0").isNotNull() & F.col("o0").isNotNull())
    same = (F.col("n0") == F.col("n1")) & (F.col("o0") == F.col("o1")) & (F.col("n0") == F.col("o0"))
    proven = per_member.groupBy("edge").agg(F.min(same.cast("int")).alias("same"), F.max((F.col("n0") != "").cast("int")).alias("some")).filter((F.col("same") == 1) & (F.col("some") == 1)).select("edge")
    weighted = cut(candidates.join(proven, "edge", "left_semi").drop("edge"))
    # where no column has two edges the matching is all of them; only the other headers are searched for the best one
    shared = weighted.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("new"), F.count_distinct("old_name").alias("old")).filter("n > new OR n > old").select("file")
    matched = weighted.select("file", "previous", "name", "old_name")
    settled = weighted.join(shared, "file", "left_semi").groupBy("file").applyInPandas(_assign, matched.schema)
    return matched.join(shared, "file", "left_anti").unionByName(settled)


def find_drift(files: DataFrame, lines: DataFrame) -> Drift:
    """Profile, match and compare the files of every series.

    ``files`` has (file, series, ordering, header), ``lines`` (file, line). Each file but the first of
    its series (by ordering, then file) is compared with the one before it.

    Defined cases: a NULL or short header has no own fields; equal own names of one header count
    once, by the first position; files without lines have columns without a type and cannot prove a rename; repeated
    lines count once; several values of one member must all be equal for a rename.
    """
    cells = headers(files)
    columns = cut(own_columns(cells).join(files.select("file", "series"), "file"), told={"last": F.max("position")})
    w = Window.partitionBy("series").orderBy("ordering", "file")
    steps = cut(files.select("file", F.lag("file").over(w).alias("previous")))
    edges = cut(possible_edges(columns, steps))
    sketched = cut(profile_columns(lines, columns, edges, told(columns, "last")))
    profiles = sketched.filter(F.col("name").isNotNull()).select("file", "name", "type")
    matches = cut(match_columns(columns, edges, sketched, lines))
    pairs = steps.filter(F.col("previous").isNotNull())
    new = pairs.join(columns.select("file", "name"), "file")
    old = pairs.join(columns.select(F.col("file").alias("previous"), "name"), "previous")
    later = new.join(matches.select("file", "name", "old_name"), ["file", "name"], "left")
    kept = old.select("file", "name", F.lit(True).alias("kept"))
    later = later.join(kept, ["file", "name"], "left")
    gone = old.join(new.select("file", "name"), ["file", "name"], "left_anti").join(matches.select("file", F.col("old_name").alias("name")), ["file", "name"], "left_anti")
    out = ["file", "change_kind", "field_name", "old_name"]
    renamed = matches.select("file", F.lit("renamed").alias("change_kind"), F.col("name").alias("field_name"), "old_name")
    added = later.filter(F.col("kept").isNull() & F.col("old_name").isNull()).select("file", F.lit("added").alias("change_kind"), F.col("name").alias("field_name"), F.lit("").alias("old_name"))
    removed = gone.select("file", F.lit("removed").alias("change_kind"), F.col("name").alias("field_name"), F.lit("").alias("old_name"))
    typed = profiles.filter(F.col("type").isNotNull()).select("file", "name", "type")
    same = later.filter(F.col("kept").isNotNull() | F.col("old_name").isNotNull()).withColumn("before", F.coalesce("old_name", "name"))
    retyped = same.join(typed, ["file", "name"]).join(typed.select(F.col("file").alias("previous"), F.col("name").alias("before"), F.col("type").alias("old_type")), ["previous", "before"]).filter(F.col("type") != F.col("old_type"))
    retyped = retyped.select("file", F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.lit("").alias("old_name"))
    changes = repaired(cells).select(out).unionByName(renamed.select(out)).unionByName(added).unionByName(removed).unionByName(retyped)
    return Drift(columns, steps, matches, profiles, changes)


def lineage(drift: Drift) -> DataFrame:
    """(file, series, position, name, field, type): the consistent field name of every own column.

    A field carries the name it has in the last file of its line of matches. Two lines of one series
    that would share a name within one file are told apart by the last file, name#file.
    """
    at = lambda f, n: F.concat_ws("\t", F.col(f).cast("string"), F.col(n))
    new = drift.steps.filter(F.col("previous").isNotNull()).join(drift.columns.select("file", "name"), "file")
    before = new.join(drift.matches.select("file", "name", "old_name"), ["file", "name"], "left").withColumn("before", F.coalesce("old_name", "name"))
    onward = before.select(at("previous", "before").alias("node"), at("file", "name").alias("following"))
    nodes = drift.columns.select("*", at("file", "name").alias("node")).join(onward, "node", "left")
    ends = last_of_series(nodes, "node", "following")
    named = drift.columns.withColumn("node", at("file", "name")).join(ends, "node").withColumn("field", F.split("last", "\t")[1])
    clash = named.groupBy("file", "field").agg(F.count(F.lit(1)).alias("n"), F.collect_list("last").alias("lasts")).filter("n > 1").select(F.explode("lasts").alias("last")).distinct().withColumn("clash", F.lit(True))
    named = named.join(clash, "last", "left").withColumn("field", F.when(F.col("clash"), F.concat("field", F.lit("#"), F.split("last", "\t")[0])).otherwise(F.col("field")))
    return named.join(drift.profiles.select("file", "name", "type"), ["file", "name"], "left").select("file", "series", "position", "name", "field", "type")


def unified_types(named: DataFrame) -> DataFrame:
    """(series, field, type, n_files): integer and decimal widen to decimal, other mixtures to text; a field without values is text."""
    kinds = named.groupBy("series", "field").agg(F.collect_set("type").alias("k"), F.count_distinct("file").alias("n_files"))
    kind = F.when(F.size("k") == 1, F.col("k")[0]).when((F.size("k") == 2) & ~F.array_contains("k", "text") & ~F.array_contains("k", "boolean"), "decimal").otherwise("text")
    return kinds.select("series", "field", kind.alias("type"), "n_files")


def unified_rows(lines: DataFrame, named: DataFrame) -> DataFrame:
    """Every line as (file, line_no, id, effectiveTime, active, moduleId, refsetId, referencedComponentId, fields).

    ``fields`` maps the consistent field name to the trimmed value. Blank lines are left out, all others kept, repeated ones too.
    """
    fields = named.groupBy("file").agg(F.collect_list(F.struct("position", "field")).alias("fields"))
    chars = named.agg(F.coalesce(F.sum(F.length("field") + 16), F.lit(0)).alias("n")).first()["n"]
    lines = lines.select("file", "line_no", "line")
    joined = lines.join(F.broadcast(fields), "file", "left") if chars <= HEADER_CHARS else skew_join(lines, fields, "file", how="left")
    joined = joined.filter(F.col("line").isNotNull() & (_strip(F.col("line")) != "")).select("file", "line_no", "fields", F.split("line", "\t").alias("cells"))
    value = lambda i: _strip(F.coalesce(F.get("cells", i), F.lit("")))
    pairs = F.transform(F.coalesce("fields", F.array().cast("array<struct<position:int,field:string>>")), lambda f: F.struct(f["field"], value(f["position"])))
    return joined.select("file", "line_no", *[value(F.lit(i)).alias(n) for i, n in enumerate(STANDARD)], F.map_from_entries(pairs).alias("fields"))

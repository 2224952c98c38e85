import random
from itertools import pairwise

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptmill.operators import hierarchy, schema_drift
from conceptmill.operators.orphan_references import find_orphans
from conceptmill.operators.snapshot_changes import consecutive, delivery_status, snapshot_changes
from conceptmill.operators.tree_aggregate import tree_count_distinct
from conceptmill.session import lookup_join, skew_join

CLASH = ", _h string, node string, jump string, change_kind string, _chunk string, key2 string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- snapshot changes


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(1)
    data = [(d, rng.choice([1, 2, None]), f"c{rng.randint(0, 9)}", rng.choice([1, 2, None]), rng.choice([None, 20200101])) for d in range(6) for _ in range(12)]
    data = list({(d, s, c): (d, s, c, v, t) for d, s, c, v, t in data}.values())
    copies = data + data[::2]
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in copies], "d long, s long, c string, v long, t int" + CLASH)
    order = spark.createDataFrame([(d, d % 2, 10 - d) for d in range(6)], "d long, series long, n long")
    pairs = consecutive(order, "series", ["n"], "d")
    got = rows(snapshot_changes(df, pairs, "d", ["s", "c"], ["v", "t"]), "d", "s", "c", "change_kind")
    want = []
    for series in (0, 1):
        for old, new in pairwise(sorted((d for d in range(6) if d % 2 == series), key=lambda d: -d)):
            a, b = ({(s, c): (v, t) for d, s, c, v, t in data if d == x} for x in (old, new))
            want += [(new, *k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    assert got == sorted(want, key=repr)
    assert snapshot_changes(df.limit(0), pairs, "d", ["s", "c"], ["v", "t"]).count() == 0
    assert snapshot_changes(df, pairs.limit(0), "d", ["s", "c"], ["v", "t"]).count() == 0


def test_delivery_status(spark):
    m = spark.createDataFrame([(1, "e", 1, "a", 2), (2, "e", 2, "a", 2), (3, "e", 3, "b", 5), (4, "e", 4, None, None), (5, "e", 5, "c", 0)], "d long, e string, n int, sha string, declared long")
    r = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7), (2, 9), (3, None)], "d long, k long")
    got = rows(delivery_status(m, r, "d", "k", "declared", "sha", "e", ["n"]), "d", "n_found", "complete", "repeats")
    assert got == [(1, 2, True, None), (2, 2, True, 1), (3, 0, False, None), (4, 0, False, None), (5, 0, True, None)]


# ---- hierarchies


def brute_forest(links):
    parent, ends = {}, set()
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
            ends |= {c, p}
    out = {}
    for n in ends:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            out[n] = (min(ring), -1 if n in ring else -2)
        else:
            out[n] = (at, len(seen))
    return parent, out


SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_forest_against_brute_force(spark, links):
    check_forest(spark, links)


def check_forest(spark, links):
    parent, want = brute_forest(links)
    df = spark.createDataFrame([(c, p, *["x"] * 6) for c, p in links + links[::3]], "c long, p long" + CLASH)
    assert rows(hierarchy.roots_and_depths(df, "c", "p"), "node", "root", "depth") == sorted(((n, *v) for n, v in want.items()), key=repr)
    forest = hierarchy.heavy_paths(df, "c", "p")
    nodes = {r.node: r for r in forest.nodes.collect()}
    trees = {n for n, (_, d) in want.items() if d >= 0}
    full = {}
    for n in trees:
        full[n] = [n]
        while full[n][0] in parent:
            full[n].insert(0, parent[full[n][0]])
    assert {r.node: r.path for r in hierarchy.paths(forest).collect()} == full
    for n in trees:
        under = {m for m in trees if n in full[m]}
        r = nodes[n]
        assert r["size"] == len(under)
        assert under == {m for m in trees if nodes[m].root == r.root and r.first <= nodes[m].first < r.first + r["size"]}
    pairs = rows(hierarchy.descendants(forest), "ancestor", "descendant", "distance")
    assert pairs == sorted(((a, n, len(p) - 1 - i) for n, p in full.items() for i, a in enumerate(p[:-1])), key=repr)


@pytest.mark.parametrize("links", [[], [(1, None), (None, 2)], [(1, 1)], [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7)], [(i, 0) for i in range(1, 200)], [(i, i - 1) for i in range(1, 90)] + [(200 + i, i) for i in range(60)], [(1, 5), (1, 3), (3, 9)]])
def test_forest_shapes(spark, links):
    check_forest(spark, links)


def test_descendants_come_from_intervals(spark, monkeypatch):
    def refused(forest):
        raise AssertionError("full paths")

    monkeypatch.setattr(hierarchy, "paths", refused)
    links = [(i, i - 1) for i in range(1, 70)] + [(100 + i, 30) for i in range(150)] + [(1000 + i, 2000) for i in range(70)] + [(5001, 5000), (5000, 5001), (5002, 5001)]
    parent = dict(links[:-3])
    want = []
    for n in parent:
        at, steps = n, 0
        while at in parent:
            at, steps = parent[at], steps + 1
            want.append((at, n, steps))
    df = spark.createDataFrame(links, "c long, p long")
    assert rows(hierarchy.descendants(hierarchy.heavy_paths(df, "c", "p")), "ancestor", "descendant", "distance") == sorted(want, key=repr)
    with pytest.raises(ValueError, match="numbers"):
        hierarchy.descendants(hierarchy.heavy_paths(df, "c", "p", numbers=False))


# ---- hot keys


def test_tree_count_distinct(spark):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["a", "a", "b", None]), f"m{rng.randint(0, 40)}" if rng.random() > 0.1 else None) for _ in range(800)]
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in data], "k long, g string, m string" + CLASH)
    want = {}
    for k, g, m in data:
        if m is not None:
            want.setdefault((k, g), set()).add(m)
    for chunks in (None, 1, 3, 64):
        assert rows(tree_count_distinct(df, ["k", "g"], ["m"], "n", chunks, fan_in=2), "k", "g", "n") == sorted(((k, g, len(m)) for (k, g), m in want.items()), key=repr)
    two = {}
    for k, g, m in data:
        if g is not None or m is not None:
            two.setdefault(k, set()).add((g, m))
    assert rows(tree_count_distinct(df, ["k"], ["g", "m"], "n"), "k", "n") == sorted(((k, len(v)) for k, v in two.items()), key=repr)
    assert tree_count_distinct(df.limit(0), ["k"], ["m"], "n").count() == 0


def test_joins_with_hot_keys(spark, monkeypatch):
    import conceptmill.session as session

    monkeypatch.setattr(session, "HOT_FLOOR", 10)
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 90)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 50)], "k long, w long")
    assert session.hot_keys(left, "k") == [1]
    for how in ("left", "inner"):
        assert rows(skew_join(left, right, "k", how), "k", "v", "w") == rows(left.join(right, "k", how), "k", "v", "w")
        assert rows(lookup_join(left, right, ["k"], how, max_rows=0), "k", "v", "w") == rows(left.join(right, "k", how), "k", "v", "w")


# ---- orphan references


def test_orphans_against_brute_force(spark, monkeypatch):
    import conceptmill.session as session

    rng = random.Random(4)
    states = [(rng.randint(0, 12), rng.choice([None, *range(1, 9)]), rng.randint(0, 1)) for _ in range(30)]
    refs = [(rng.choice([0, 0, 0, *range(16), None]), rng.choice([*range(0, 10), None]), f"r{i}") for i in range(300)]
    want = []
    at = {}
    for k, d, a in states:
        at[k, d or 0] = max(a, at.get((k, d or 0), 0))
    for k, d, name in refs:
        if k is None or d is None:
            continue
        own = sorted((t, a) for (q, t), a in at.items() if q == k)
        past = [a for t, a in own if t <= d]
        reason = "missing" if not own else "late" if not past else "deleted" if not past[-1] else None
        if reason:
            want.append((k, d, name, reason))
    df = spark.createDataFrame([(*r, "x") for r in refs], "key long, at int, name string, seen string")
    s = spark.createDataFrame([(*r, "x") for r in states], "id long, t int, on int, refs string")
    for floor in (10, 10**9):
        monkeypatch.setattr(session, "HOT_FLOOR", floor)
        assert rows(find_orphans(df, s, "id", "t", "on"), "key", "at", "name", "reason") == sorted(want, key=repr)
    assert find_orphans(df.limit(0), s, "id", "t", "on").count() == 0
    assert {r.reason for r in find_orphans(df, s.limit(0), "id", "t", "on").collect()} == {"missing"}


# ---- schema drift


STD = schema_drift.STANDARD


def drift_of(spark, files, lines):
    f = spark.createDataFrame([(*x, "clash") for x in files], "file long, series long, ordering int, header array<string>, name string")
    l = spark.createDataFrame([(*x, "clash") for x in lines], "file long, line_no int, line string, value string")  # noqa: E741
    return schema_drift.find_drift(f, l), l


def line(member, *cells, end=""):
    return "\t".join([member, "20200101", "1", "7", "8", "9", *cells]) + end


def test_drift(spark):
    files = [
        (1, 5, 1, [*STD, "a", "b", "gone", "n"]),
        (2, 5, 2, ["﻿Id", *STD[1:5], "mapSource", " A", "bNew", "n", "fresh"]),
        (3, 6, 1, None),
        (4, 6, 2, ["id", "active"]),
        (5, 6, 3, [*STD, "x", "x "]),
    ]
    lines = [
        (1, 2, line("m1", "x", "5", "q", "1", end="\r")), (1, 3, line("m2", "y", "", "q", "2")), (1, 3, line("m2", "y", "", "q", "2")), (1, 4, ""), (1, 5, None), (1, 6, line("m9", "y", "7", "q", "2")),
        (2, 2, line("m1", " x ", "5", "1.5")), (2, 3, line("m2", "z", "")), (2, 4, line("m3", "z", "8", "3", "true")),
        (5, 2, line("m1", "1", "2", "3", "4", "5")), (77, 1, line("m1", "no such file")),
    ]
    drift, l = drift_of(spark, files, lines)  # noqa: E741
    got = rows(drift.changes, "file", "change_kind", "field_name", "old_name")
    assert got == sorted([(2, "repaired", "id", "Id"), (2, "repaired", "referencedComponentId", "mapSource"), (2, "renamed", "bnew", "b"), (2, "removed", "gone", ""), (2, "added", "fresh", ""), (2, "retyped", "n", ""), (4, "repaired", "effectiveTime", "active"), (5, "added", "x", "")], key=repr)
    named = schema_drift.lineage(drift)
    assert {(r.file, r.name, r.field) for r in named.collect()} >= {(1, "b", "bnew"), (2, "bnew", "bnew"), (1, "gone", "gone")}
    unified = schema_drift.unified_rows(l, named)
    told = {(r.file, r.line_no, r.id): r.fields for r in unified.collect()}
    assert told[1, 2, "m1"] == {"a": "x", "bnew": "5", "gone": "q", "n": "1"} and told[2, 3, "m2"] == {"a": "z", "bnew": "", "n": "", "fresh": ""}
    assert unified.count() == 9
    assert {(r.field, r.type) for r in schema_drift.unified_types(named).collect() if r.series == 5} == {("a", "text"), ("bnew", "integer"), ("gone", "text"), ("n", "decimal"), ("fresh", "boolean")}


def test_drift_rename_needs_equal_values(spark):
    files = [(1, 5, 1, [*STD, "b", "e"]), (2, 5, 2, [*STD, "c", "f"])]
    drift, _ = drift_of(spark, files, [(1, 1, line("m1", "5", "")), (1, 2, line("m2", "6", "")), (2, 1, line("m1", "5", "")), (2, 2, line("m2", "7", ""))])
    assert {r.change_kind for r in drift.changes.collect()} == {"added", "removed"}
    drift, _ = drift_of(spark, files, [(1, 1, line("m1", "5", "")), (2, 1, line("m3", "5", ""))])
    assert {r.change_kind for r in drift.changes.collect()} == {"added", "removed"}
    drift, _ = drift_of(spark, [], [])
    assert drift.changes.count() == 0


def test_drift_names_meet_again(spark):
    files = [(1, 5, 1, [*STD, "x", "p"]), (2, 5, 2, [*STD, "p"]), (3, 5, 3, [*STD, "x"])]
    cells = [(1, 1, line("m1", "1", "7")), (2, 1, line("m1", "7")), (3, 1, line("m1", "7"))]
    drift, l = drift_of(spark, files, cells)  # noqa: E741
    assert (3, "renamed", "x", "p") in rows(drift.changes, "file", "change_kind", "field_name", "old_name")
    fields = {r.file: r.fields for r in schema_drift.unified_rows(l, schema_drift.lineage(drift)).collect()}
    assert fields == {1: {"x#1": "1", "x#3": "7"}, 2: {"x#3": "7"}, 3: {"x#3": "7"}}


def test_drift_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(schema_drift, "HEADER_CHARS", 0)
    monkeypatch.setattr(schema_drift, "EDGES", -1)
    test_drift(spark)
    test_drift_names_meet_again(spark)
    cells = {f"m{i}": "" if i % 3 else str(i) for i in range(60)}  # as many registers as there are, some with a short line as the least member's
    lines = [(1, i, line(m, *([c] if c else []))) for i, (m, c) in enumerate(cells.items())] + [(2, i, line(m, c)) for i, (m, c) in enumerate(cells.items())]
    drift, _ = drift_of(spark, [(1, 5, 1, [*STD, "old"]), (2, 5, 2, [*STD, "new"])], lines)
    assert rows(drift.changes, "file", "change_kind", "field_name", "old_name") == [(2, "renamed", "new", "old")]


def test_drift_moves_no_lines(spark, monkeypatch):
    """Columns are profiled where their lines lie: beyond the broadcast only one row per column is shuffled."""
    def written():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        each = [found.next() for _ in iter(found.hasNext, False)]
        return {f.getName(): f.length() for f in each if f.getName().startswith("shuffle_")}

    monkeypatch.setattr(schema_drift, "HEADER_CHARS", 0)
    lines = [(f, i, line(f"{f * i * 2654435761:x}", *(f"{f * i * p:x}" for p in (40503, 69069, 1664525)))) for f in range(1, 5) for i in range(5000)]
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drift, _ = drift_of(spark, [(f, f, 1, [*STD, "a", "b", "c"]) for f in range(1, 5)], lines)
        assert drift.changes.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(n for name, n in written().items() if name not in before)
    assert 0 < moved < sum(len(x[2]) for x in lines) / 10


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz")), st.integers(1, 9), min_size=1))
def test_assignment_is_the_heaviest(weights):
    def best(left, used):
        if not left:
            return 0
        return max([best(left[1:], used)] + [w + best(left[1:], used | {b}) for (a, b), w in weights.items() if a == left[0] and b not in used])

    chosen = schema_drift.best_assignment({k: float(v) for k, v in weights.items()})
    assert len({a for a, _ in chosen}) == len({b for _, b in chosen}) == len(chosen)
    assert sum(weights[p] for p in chosen) == best(sorted({a for a, _ in weights}), frozenset())


def test_profile_types(spark):
    data = [("i", "+1"), ("i", ""), ("d", "1"), ("d", "-2.50"), ("b", "TRUE"), ("b", "false"), ("t", "1."), ("e", "")]
    df = spark.createDataFrame([(1, n, f"m{i}", v) for i, (n, v) in enumerate(data)], "file long, name string, member string, value string")
    assert {r.name: r.type for r in schema_drift.profile(df).collect()} == {"i": "integer", "d": "decimal", "b": "boolean", "t": "text", "e": None}
    assert df.filter(F.lit(False)).count() == 0


def test_running_counts_go_on_from_stored_ones(spark):
    """Two periods one after the other report what both at once do; a reference counts at its own date only."""
    from conceptmill.operators.orphan_references import counts_after, existence_deltas, orphan_keys, reference_deltas, running_counts

    states = [("a", 10, 1), ("a", 30, 0), ("b", 25, 1), ("c", None, 1)]
    refs = [("a", 5), ("a", 10), ("a", 30), ("a", 30), ("b", 20), ("b", 30), ("c", 5), ("d", 20), ("d", 20), (None, 5), ("e", None)]
    frame = lambda data: spark.createDataFrame(data, "key string, at int")
    deltas = lambda data: existence_deltas(spark.createDataFrame(data, "key string, at int, active int"), "key", "at", "active")
    whole = {tuple(r) for r in orphan_keys(frame(refs), deltas(states)).collect()}
    assert whole == {("a", 5, 1, "late"), ("a", 30, 2, "deleted"), ("b", 20, 1, "late"), ("d", 20, 2, "missing")}
    every = running_counts(reference_deltas(frame(refs)), deltas(states)).collect()
    assert all(r.refs == 0 for r in every if r.step == 1) and {(r.key, r.at, r.refs) for r in every if r.step == 0 and r.refs} == {(k, t, sum(x == (k, t) for x in refs)) for k, t in refs if k and t}
    early = deltas([s for s in states if (s[1] or 0) <= 20])
    before = counts_after(reference_deltas(frame([x for x in refs if x[1] and x[1] <= 20])), early)
    assert {(r.key, r.refs, r.exists) for r in before.collect()} == {("a", 0, 1), ("b", 0, 0), ("c", 0, 1), ("d", 0, 0)}
    change = spark.createDataFrame([("a", 30, 1, -1), ("b", 25, 1, 1)], "key string, at long, seen int, exists int")
    later = {tuple(r) for r in orphan_keys(frame([x for x in refs if x[1] == 30]), change, before).collect()}
    assert later == {r for r in whole if r[1] == 30}


def test_arrived_rows_and_null_keys_spread(spark):
    """A forest of very many roots: rows without a parent go around the joins."""
    from conceptmill.session import skew_join

    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id END AS k")
    right = spark.range(0, 1000, 20).selectExpr("id AS k", "'x' AS v")
    got = skew_join(left, right, "k")
    assert got.count() == 1000 and got.filter("v = 'x'").count() == 50 and skew_join(left, right, "k", how="inner").count() == 50
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    links = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(500)], "c long, p long")
    assert {(r.node, r.root, r.depth) for r in hierarchy.roots_and_depths(links, "c", "p").collect()} == {x for i in range(500) for x in ((2 * i, 2 * i + 1, 1), (2 * i + 1, 2 * i + 1, 0))}


def test_chunks_follow_the_input(spark, monkeypatch):
    from conceptmill.operators import tree_aggregate

    monkeypatch.setattr(tree_aggregate, "CHUNK_ROWS", 64)
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id % 1500 AS m")
    want = {}
    for r in df.collect():
        want.setdefault(r.k, set()).add(r.m)
    assert rows(tree_count_distinct(df, ["k"], ["m"], "n"), "k", "n") == sorted(((k, len(v)) for k, v in want.items()), key=repr)

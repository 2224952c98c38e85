"""Every registered query runs; those with SQL give the same rows."""

import glob
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conceptmill.plans import expressions

SF = "/root/testdata/sf0.001"
TEXT = {n for n in entry.queries() if n.startswith(("p6_", "p7_", "p8_"))}


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - TEXT))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in entry.oracle_sql():
        want = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    if name.endswith("_found"):
        assert max(got.values(), default=1) == 1


def test_words_of_every_kind_are_checked(spark, db):
    ids = {r.concept_id for r in entry.queries()["words_of_all"](spark, SF).collect()}
    assert {i // 10**12 for i in ids} == {11, 12, 13, 17, 23}
    assert sum(i // 10**12 == 17 for i in ids) == db.execute("SELECT count(*) FROM part").fetchone()[0]


def test_every_concept_expression_is_in_a_corpus():
    assert all(f"'{name}' AS name" in entry.oracle_sql()["corpus_counts_all"] for name in expressions.CONCEPTS) and len(expressions.CONCEPTS) > len(expressions.CORPUS)


def test_entry(spark):
    assert entry.entry(spark).columns == ["concept_id"]


def test_nothing_else_needs_the_text_package():
    code = "import sys, builtins\nreal = builtins.__import__\ndef block(name, g=None, l=None, f=(), level=0):\n    if 'conceptmill.llm' in name or (level and f and 'llm' in f):\n        raise ImportError(name)\n    return real(name, g, l, f, level)\nbuiltins.__import__ = block\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p7_found' not in e.queries()"
    root = os.path.dirname(entry.__file__)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)

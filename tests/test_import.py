import zipfile

import pytest

from conceptmill import catalog as fixed
from conceptmill.engine import Engine
from conceptmill.sources import snapshot

ROOT, LEFT, RIGHT, LEAF, KIND, TARGET, OLD, MODULE, SIMPLE, MAP, DESC_REF = (1000000 + 1000 * i for i in range(11))
DESCRIPTOR, LANG = 900000000000456007, fixed.GB_ENGLISH
DATE = 20260826
INTEGER, STRING_TYPE, COMPONENT = 900000000000476001, 1119460002, 900000000000460005
ALL = [snapshot.MODULE_DEPENDENCY, ROOT, LEFT, RIGHT, LEAF, KIND, TARGET, MODULE, SIMPLE, MAP, DESC_REF, DESCRIPTOR, LANG, fixed.IS_A, fixed.ASSOCIATIONS, fixed.SAME_AS, INTEGER, STRING_TYPE, COMPONENT, fixed.PRIMITIVE, fixed.DEFINED]


def files(**changes):
    tsv = lambda head, rows: "\r\n".join("\t".join(map(str, r)) for r in [head, *rows]) + "\r\n"
    std = ["id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId"]
    member = lambda n, ref, c, *own, active=1: [f"{n:08d}-0000-4000-8000-000000000000", DATE, active, MODULE, ref, c, *own]
    rel = lambda n, s, d, g=0, k=fixed.IS_A, active=1: [n, DATE, active, MODULE, s, d, g, k, fixed.INFERRED, fixed.SOME_MODIFIER]
    isa = [(LEFT, ROOT), (RIGHT, ROOT), (LEAF, LEFT), (LEAF, RIGHT), (TARGET, ROOT), (KIND, ROOT), (fixed.SAME_AS, fixed.ASSOCIATIONS), (fixed.ASSOCIATIONS, ROOT)]
    out = {
        "sct2_Concept_Snapshot": tsv(snapshot.COLUMNS["sct2_Concept_"].split(), [[c, DATE, 1, MODULE, fixed.DEFINED if c == LEAF else fixed.PRIMITIVE] for c in ALL] + [[OLD, 20200131, 0, MODULE, fixed.PRIMITIVE]]),
        "sct2_Relationship_Snapshot": tsv(snapshot.COLUMNS["sct2_Relationship_"].split(), [rel(100 + i, s, d) for i, (s, d) in enumerate(isa)] + [rel(200, LEAF, TARGET, 1, KIND), rel(201, LEAF, TARGET, 2, KIND), rel(202, LEFT, TARGET, 1, KIND, active=0)]),
        "sct2_RelationshipConcreteValues_Snapshot": tsv(snapshot.COLUMNS["sct2_RelationshipConcreteValues_"].split(), [[300, DATE, 1, MODULE, LEAF, "#0.100000000000000001", 2, KIND, fixed.INFERRED, fixed.SOME_MODIFIER], [301, DATE, 1, MODULE, LEAF, '"a synthetic \\"value\\""', 3, KIND, fixed.INFERRED, fixed.SOME_MODIFIER]]),
        "sct2_Description_Snapshot-en": "﻿" + tsv(snapshot.COLUMNS["sct2_Description_"].split(), [[400010, DATE, 1, MODULE, LEAF, "en", fixed.SYNONYM, 'Leaf "term"', 0], [400110, DATE, 1, MODULE, LEAF, "en", fixed.FSN, "Leaf (thing)", 0]]),
        "sct2_Identifier_Snapshot": tsv(snapshot.IDENTIFIER_ORDERS[0].split(), [["L-1", DATE, 1, MODULE, SIMPLE, LEAF]]),
        "der2_cRefset_LanguageSnapshot-en": tsv([*std, "acceptabilityId"], [member(1, LANG, 400010, fixed.PREFERRED)]),
        "der2_Refset_SimpleSnapshot": tsv(["id", "EffectiveTime", "active", "moduleId", "refsetId", "mapSource"], [member(2, SIMPLE, LEAF), member(3, SIMPLE, LEAF), member(4, SIMPLE, LEFT, active=0), member(5, SIMPLE, OLD)]),
        "der2_isRefset_MapSnapshot": tsv([*std, "mapGroup", "map Target"], [member(6, MAP, LEAF, 7, "X1"), member(7, MAP, LEFT, 8, "")]),
        "der2_cRefset_AssociationSnapshot": tsv([*std, "targetComponentId"], [member(8, fixed.SAME_AS, OLD, LEAF), member(9, fixed.SAME_AS, OLD, 10_000_004)]),
        "der2_cciRefset_RefsetDescriptorSnapshot": tsv([*std, "attributeDescription", "attributeType", "attributeOrder"], [member(10, DESCRIPTOR, MAP, KIND, COMPONENT, 0), member(11, DESCRIPTOR, MAP, KIND, INTEGER, 1), member(12, DESCRIPTOR, MAP, KIND, STRING_TYPE, 2)]),
    }
    out["der2_ssRefset_ModuleDependencySnapshot"] = tsv([*std, "sourceEffectiveTime", "targetEffectiveTime"], [member(13, snapshot.MODULE_DEPENDENCY, MODULE, DATE, DATE)])
    return out | changes


def archive(path, package=f'{{"effectiveTime": "{DATE}"}}', **changes):
    with zipfile.ZipFile(path, "w") as z:
        if package:
            z.writestr("Release/release_package_information.json", package)
        for name, text in files(**changes).items():
            if text is not None:
                z.writestr(f"Release/Snapshot/{'Refset/' if name.startswith('der2') else 'Terminology/'}{name}_INT_{DATE}.txt", text)
    return str(path)


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("import")
    path = archive(folder / "a.zip")
    stages = []
    made = snapshot.import_snapshot(spark, path, str(folder / "work"), expected_checksum=snapshot.inspect(path).checksum, progress=stages.append)
    return path, made, stages


def test_import(imported):
    path, made, stages = imported
    seen = snapshot.inspect(path)
    assert seen.date == DATE and seen.importable
    assert made.manifest["edition"] == f"http://snomed.info/sct/{MODULE}/version/{DATE}" and made.manifest["member_rows"]["concept"] > 5
    assert stages[-1] == "done" and made.manifest["history_skipped"] == 1 and made.manifest["concept_count"] == len(ALL) + 1
    assert any("mapSource" in r for r in made.manifest["header_repairs"]) and any("EffectiveTime" in r for r in made.manifest["header_repairs"])
    engine = Engine(made)
    get = lambda x: sorted(r[0] for r in engine.evaluate(x).df.collect())
    assert get(f"<< {ROOT}") == sorted([ROOT, LEFT, RIGHT, LEAF, TARGET, KIND, fixed.ASSOCIATIONS, fixed.SAME_AS])
    assert get(f"* : [2..2] {{ {KIND} = {TARGET} }}") == [LEAF]
    assert get(f"* : {KIND} > #0.1") == [LEAF] and get(f'* : {KIND} = "a synthetic \\"value\\""') == [LEAF]
    assert get(f"^ {SIMPLE}") == [LEAF, OLD] and get(f"^ {MAP} {{{{ M mapGroup >= #8 }}}}") == [LEFT]
    assert get(f'^ {MAP} {{{{ M mapTarget = "x1" }}}}') == [LEAF]
    assert get(f"{LEAF} {{{{ +HISTORY-MIN }}}}") == [LEAF, OLD]
    assert get('* {{ term = "leaf", dialect = en-gb (prefer) }}') == [LEAF]
    assert get("* {{C definitionStatus = defined}}") == [LEAF]
    assert {(r.field, r.kind) for r in made.member_schema.collect() if r.refset == MAP} == {("mapGroup", "integer"), ("mapTarget", "text")}
    assert made.display.filter(f"concept_id = {LEAF}").first().term == 'Leaf "term"'
    assert snapshot.module_check(made).count() == 0


def test_every_identifier_file_counts(spark, tmp_path):
    other = lambda code: {"sct2_Identifier_Extension": "\t".join(snapshot.IDENTIFIER_ORDERS[1].split()) + f"\r\n{SIMPLE}\t{code}\t{DATE}\t1\t{MODULE}\t{LEFT}\r\n", "sct2_Identifier_Third": "\t".join(snapshot.IDENTIFIER_ORDERS[0].split()) + "\r\n"}
    made = snapshot.import_snapshot(spark, archive(tmp_path / "i.zip", **other("L-2")), str(tmp_path / "work"))
    assert sorted((r.scheme, r.code, r.component) for r in made.identifier.collect()) == [(SIMPLE, "L-1", LEAF), (SIMPLE, "L-2", LEFT)]


def test_edition_and_assessment(imported):
    from conceptmill.sources import editions

    made = imported[1]
    assert editions.edition_module(made) == MODULE and editions.edition_module(made, MODULE) == MODULE
    with pytest.raises(snapshot.ImportFailure):
        editions.edition_module(made, 5)
    assert editions.broken_dependencies(made).count() == 0
    mine = {"date": 20260826, "archive_sha256": "a"}
    cases = {"up_to_date": [mine], "reissued": [{"date": 20260826, "archive_sha256": "b"}], "behind(2)": [mine, {"date": 20260901}, {"date": 20261001}], "unknown": [{"date": 20250101}]}
    for want, published in cases.items():
        assert editions.assess(mine, published) == want


def concept_file(*rows):
    return "\r\n".join("\t".join(map(str, r)) for r in [snapshot.COLUMNS["sct2_Concept_"].split(), *rows]) + "\r\n"


@pytest.mark.parametrize(
    "changes,message",
    [
        ({"sct2_Concept_Snapshot": concept_file(*[[ROOT, DATE, 1, ROOT, fixed.PRIMITIVE]] * 2)}, "two rows"),
        ({"sct2_Concept_Snapshot": concept_file([ROOT, 20270101, 1, ROOT, fixed.PRIMITIVE])}, "newer"),
        ({"sct2_Concept_Snapshot": concept_file([ROOT, DATE, 1, ROOT, 1])}, "no definition status"),
        ({"sct2_Concept_Snapshot": "id\tactive\r\n"}, "header"),
        ({"der2_Refset_SimpleSnapshot": "id\teffectiveTime\tactive\tmoduleId\tother\treferencedComponentId\r\n"}, "belongs"),
        ({"sct2_Relationship_Snapshot": files()["sct2_Relationship_Snapshot"] + f"900\t{DATE}\t1\t{MODULE}\t{ROOT}\t{LEAF}\t0\t{fixed.IS_A}\t{fixed.INFERRED}\t{fixed.SOME_MODIFIER}\r\n"}, "below itself"),
    ],
)
def test_broken_archives(spark, tmp_path, changes, message):
    with pytest.raises(Exception, match=message):
        snapshot.import_snapshot(spark, archive(tmp_path / "b.zip", **changes), str(tmp_path / "work"))


def test_bad_lines_and_missing_files(spark, tmp_path):
    path = archive(tmp_path / "c.zip", **{"sct2_Concept_Snapshot": concept_file([ROOT, DATE])})
    with pytest.raises(Exception, match="5 columns expected"):
        snapshot.import_snapshot(spark, path, str(tmp_path / "work"))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.txt", "")
    with pytest.raises(snapshot.ImportFailure, match="missing"):
        snapshot.import_snapshot(spark, str(tmp_path / "d.zip"), str(tmp_path / "work"))
    with pytest.raises(snapshot.ImportFailure, match="checksum"):
        snapshot.import_snapshot(spark, path, str(tmp_path / "work"), expected_checksum="0")


@pytest.mark.parametrize(
    "options,changes,message",
    [
        ({}, {"package": None}, "missing"),
        ({}, {"package": '{"effectiveTime": "soon"}'}, "no date"),
        ({"edition": f"http://snomed.info/sct/{MODULE}/version/20250101"}, {}, "no edition of"),
        ({"edition": f"http://snomed.info/sct/5000000/version/{DATE}"}, {}, "module is no concept"),
        ({}, {"sct2_RelationshipConcreteValues_Snapshot": None}, "missing"),
        ({}, {"der2_ssRefset_ModuleDependencySnapshot": None}, "missing"),
        ({}, {"sct2_Description_Second": files()["sct2_Description_Snapshot-en"]}, "more than once"),
        ({}, {"der2_isRefset_MapSnapshot": files()["der2_isRefset_MapSnapshot"].replace("\tmap Target", "", 1)}, "promises 2"),
    ],
)
def test_strictness(spark, tmp_path, options, changes, message):
    with pytest.raises(snapshot.ImportFailure, match=message):
        snapshot.import_snapshot(spark, archive(tmp_path / "s.zip", **changes), **options)


def test_every_broken_rule_of_a_stage_is_named(spark, tmp_path):
    simple, words = files()["der2_Refset_SimpleSnapshot"], files()["sct2_Description_Snapshot-en"]
    members = {
        "der2_Refset_SimpleSnapshot": simple.replace(str(DATE), "20270101", 1).replace("00000003-0000", "0000000x-0000").replace(str(OLD), "5000000"),
        "der2_ssRefset_ModuleDependencySnapshot": files()["der2_ssRefset_ModuleDependencySnapshot"].replace(f"\t{MODULE}\t{DATE}\t{DATE}", f"\t5000000\t{DATE}\t{DATE}"),
    }
    with pytest.raises(snapshot.ImportFailure) as e:
        snapshot.import_snapshot(spark, archive(tmp_path / "m.zip", **members))
    for message in ("a member is newer", "no UUID", "a concept that does not exist", "self-contained"):
        assert message in str(e.value), message
    texts = {
        "sct2_Description_Snapshot-en": words.replace(str(DATE), "20270101", 1),
        "der2_cRefset_LanguageSnapshot-en": files()["der2_cRefset_LanguageSnapshot-en"].replace(str(DATE), "20270101").replace("400010", "400999"),
        "sct2_Identifier_Snapshot": files()["sct2_Identifier_Snapshot"].replace(str(DATE), "20270101"),
        "sct2_Identifier_Second": files()["sct2_Identifier_Snapshot"],
    }
    with pytest.raises(snapshot.ImportFailure) as e:
        snapshot.import_snapshot(spark, archive(tmp_path / "t.zip", **texts))
    for message in ("a description is newer", "a language member is newer", "a language member of no description", "an identifier is newer", "an identifier is there twice"):
        assert message in str(e.value), message


def test_domains_are_inherited(spark):
    """Own descriptor, that of a parent, none with rows of either kind, and a descriptor without rows."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    closure = frame([(1, 11, 1), (1, 12, 2), (11, 12, 1), (2, 13, 1)], "ancestor long, descendant long, depth int")
    of = {"concepts": snapshot.CONCEPT_TYPE, "descriptions": snapshot.DESCRIPTION_TYPE, "anything": COMPONENT}
    descriptors = frame([(1, of["descriptions"], 0), (11, of["concepts"], 0), (2, of["anything"], 0), (14, of["descriptions"], 0)], "refset long, type long, pos int")
    counts = frame([(1, 3, 0), (12, 0, 5), (13, 0, 4), (15, 2, 4), (16, 0, 1)], "refset long, of_concepts long, of_others long")
    every = frame([(i,) for i in (1, 2, 11, 12, 13, 14, 15, 16)], "refset long")
    declared = snapshot.nearest_descriptors(every, descriptors, closure)
    got = {r.refset: r.concept_based for r in snapshot.refset_domains(counts, descriptors, declared, closure).collect()}
    assert got == {1: False, 2: True, 11: True, 12: True, 13: False, 14: False, 15: True, 16: False}


NEW_SET, NEW_MODULE = 2000001009, 2000002001


def supplement(path, **changes):
    std = "id effectiveTime active moduleId refsetId referencedComponentId".split()
    tsv = lambda head, *rows: "\n".join("\t".join(map(str, r)) for r in [head, *rows]) + "\n"
    uuid = lambda n: f"5{n:07d}-0000-4000-8000-00000000000a"
    when = 20260701
    made = {
        "Terminology/sct2_Concept_Snapshot_X": tsv(snapshot.COLUMNS["sct2_Concept_"].split(), *[[c, when, 1, NEW_MODULE, fixed.PRIMITIVE] for c in (NEW_SET, NEW_MODULE)]),
        "Terminology/sct2_Relationship_Snapshot_X": tsv(snapshot.COLUMNS["sct2_Relationship_"].split(), [880001, when, 1, NEW_MODULE, NEW_SET, ROOT, 0, fixed.IS_A, fixed.INFERRED, fixed.SOME_MODIFIER]),
        "Terminology/sct2_Description_Snapshot-en_X": tsv(snapshot.COLUMNS["sct2_Description_"].split(), [880010, when, 1, NEW_MODULE, NEW_SET, "en", fixed.FSN, "Pantry list (set)", 0]),
        "Refset/der2_Refset_SimpleSnapshot_X": tsv(std, [uuid(1), when, 1, NEW_MODULE, NEW_SET, LEAF], [uuid(2), when, 1, NEW_MODULE, NEW_SET, OLD], [uuid(3), when, 0, NEW_MODULE, NEW_SET, RIGHT]),
        "Refset/der2_ssRefset_ModuleDependencySnapshot_X": tsv([*std, "sourceEffectiveTime", "targetEffectiveTime"], [uuid(4), when, 1, NEW_MODULE, snapshot.MODULE_DEPENDENCY, MODULE, when, DATE]),
    } | changes
    with zipfile.ZipFile(path, "w") as z:
        for name, text in made.items():
            z.writestr(f"Extra/Snapshot/{name}_20260701.txt", text)
    return str(path)


def test_supplement(spark, imported, tmp_path):
    base = imported[1]
    path = supplement(tmp_path / "x.zip")
    extra = snapshot.import_snapshot(spark, path, expected_date=20260701, base=base)
    whole = snapshot.add_refsets(base, extra)
    both, before = Engine(whole), Engine(base)
    get = lambda e, x: sorted(r[0] for r in e.evaluate(x).df.collect())
    assert get(both, f"^ {NEW_SET}") == [LEAF, OLD] and get(both, f"^ {NEW_SET} {{{{ M active = 0 }}}}") == [RIGHT]
    assert get(both, f"< {ROOT}") == sorted([*get(before, f"< {ROOT}"), NEW_SET]) and get(both, f"^ {SIMPLE}") == get(before, f"^ {SIMPLE}")
    assert whole.manifest["supplements"][0]["added_concepts"] == 2 and whole.manifest["concept_count"] == base.manifest["concept_count"] + 2
    assert whole.manifest["edition"] == base.manifest["edition"] and get(both, '* {{ term = "pantry" }}') == [NEW_SET]
    with pytest.raises(snapshot.ImportFailure, match="already"):
        snapshot.add_refsets(whole, extra)
    concept = lambda c: "\t".join(snapshot.COLUMNS["sct2_Concept_"].split()) + f"\n{c}\t20260701\t1\t{MODULE}\t{fixed.PRIMITIVE}\n"
    for change, message in [
        ({"Terminology/sct2_Concept_Snapshot_X": concept(LEAF)}, "concept of the base"),
        ({"Terminology/sct2_Relationship_Snapshot_X": "\t".join(snapshot.COLUMNS["sct2_Relationship_"].split()) + f"\n880001\t20260701\t1\t{MODULE}\t{LEFT}\t{RIGHT}\t0\t{fixed.IS_A}\t{fixed.INFERRED}\t{fixed.SOME_MODIFIER}\n"}, "changes the parents"),
        ({"Refset/der2_Refset_SimpleSnapshot_X": files()["der2_Refset_SimpleSnapshot"].replace(str(DATE), "20260701")}, "reference set of the base"),
    ]:
        with pytest.raises(snapshot.ImportFailure, match=message):
            snapshot.import_snapshot(spark, supplement(tmp_path / "y.zip", **change), expected_date=20260701, base=base)


def test_release_is_written_by_many_tasks_and_leaves_no_files(spark, tmp_path):
    from conceptmill.plans.imports import DATE as RELEASED
    from conceptmill.sources import release_files, star

    made = star.Star(spark, "/root/testdata/sf0.001").catalog(stored=False)
    assert not hasattr(made.concrete, "_cut_path")
    archive = release_files.ReleaseArchive(made, str(tmp_path / "release"), RELEASED, star.cid(32, 3), [star.cid(10, star.SCHEME)])
    name = next(n for n in archive.files if "ConcreteValues" in n)
    assert archive.first_line(name).split("\t") == snapshot.COLUMNS["sct2_RelationshipConcreteValues_"].split()
    assert len([p for p in (tmp_path / "release" / name).iterdir() if p.name.endswith(".gz")]) > 1
    rows = archive.core("sct2_RelationshipConcreteValues_", name)
    assert rows.count() == made.concrete.count() and snapshot.grow_apart(rows.select(rows.id.cast("long")))
    archive.stored([name])
    assert not (tmp_path / "release" / name).exists()


def test_ids_that_stand_twice(spark, tmp_path):
    ids = lambda *parts: spark.sparkContext.parallelize([(i,) for p in parts for i in p], len(parts)).toDF("id long")
    assert snapshot.grow_apart(ids([4, 5, 6], [1, 2, 3]))
    assert not snapshot.grow_apart(ids([1, 2, 3], [3, 4, 5])) and not snapshot.grow_apart(ids([1, 5, 9], [2, 3, 4]))
    assert not snapshot.grow_apart(ids([1, 2, 2], [7, 8, 9])) and not snapshot.grow_apart(ids([*range(0, -600, -1)], [1] * 600))
    name = "sct2_RelationshipConcreteValues_Snapshot"
    with pytest.raises(snapshot.ImportFailure, match="a relationship id is used twice: 200"):
        snapshot.import_snapshot(spark, archive(tmp_path / "r.zip", **{name: files()[name].replace("300\t", "200\t", 1)}))
    with pytest.raises(snapshot.ImportFailure, match="a member id is used twice: 00000003-"):
        snapshot.import_snapshot(spark, archive(tmp_path / "u.zip", der2_Refset_SimpleSnapshot=files()["der2_Refset_SimpleSnapshot"].replace("00000002-", "00000003-")))


def test_decimals_lose_their_zeros_as_by_patterns(spark):
    from pyspark.sql import functions as F

    from conceptmill.functions import decimals

    texts = ["0", "-0", "0.0", "-0.00", "10", "100.00", "17.50", "007.10", "+1.0", "-0.10", "5.", "1.2.30", "x0", "", "-", ".50", "12\n", "1.0\n", "0.000000000000000000010"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decimals.canonical_column(F.col("t")).alias("a"), decimals._by_patterns(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]

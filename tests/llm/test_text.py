import bisect
import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptmill.llm import encoding, leakage, packing
from conceptmill.llm import queries as registered

SF = "/root/testdata/sf0.01"


def grams(ws, n=13):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


# ---- leakage


def test_words_follow_the_definition():
    assert leakage.words("Ｆｕｌｌ <b class=x>na​ïve</b> co­op 12,5 — ﬂat") == ["full", "naïve", "coop", "12", "5", "flat"]
    assert leakage.words(None) == [] and leakage.words("") == [] and leakage.words("— !") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=6), st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=4))
def test_shard_matches_equal_brute_force(docs, items):
    runs = [[str(w) for w in d] for d in docs]
    known = leakage.Items([(i, " ".join(str(w) for w in t)) for i, t in enumerate(items)], 3)
    found = leakage.shard_matches(list(range(len(runs))), runs, known) if runs else pd.DataFrame(columns=["id", "item", "n_words"])
    got = {(int(a), int(b)): int(n) for a, b, n in zip(found.id, found.item, found.n_words)}
    want = {}
    for a, d in enumerate(runs):
        for b, t in enumerate(items):
            t = [str(w) for w in t]
            best = max((n for n in range(1, len(t) + 1) if grams(d, n) & grams(t, n)), default=0)
            if best >= 3:
                want[a, b] = best
    assert got == want


def test_suffix_array_order():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 300)
    order = leakage.suffix_array(text, 400)
    assert list(order) == sorted(range(300), key=lambda i: tuple(text[i:]))


def test_a_repeated_word_is_no_burden():
    known = leakage.Items([("a", "na " * 200)], 13)
    began = time.perf_counter()
    found = leakage.shard_matches(["d", "e"], [["na"] * 40_000, ["x", *["na"] * 150, "y"]], known)
    assert sorted(zip(found.id, found.item, found.n_words, found.place, found.item_place)) == [("d", "a", 200, 0, 0), ("e", "a", 150, 1, 0)]
    assert time.perf_counter() - began < 2


def test_item_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(7)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "eval_id string, text string")
    monkeypatch.setattr(leakage, "ITEM_CHARS", 60)
    got = {(r.doc_id, r.eval_id, r.n_words) for r in leakage.find_leaks(docs, items).collect()}
    assert got >= {(i, f"i{i}", 20) for i in range(7)}


def test_leaks_across_shards_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    long_text = [rng.choice(vocabulary) for _ in range(500)]
    rows = [(1, " ".join(passage[:13])), (2, " ".join(passage[:12])), (3, None), (4, ""), (5, " ".join(long_text[:237] + passage + long_text[237:])), (5, " ".join(passage)), (6, "x")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, item string")
    items = spark.createDataFrame([(7, " ".join(passage)), (8, None), (9, "too short")], "eval_id long, text string")
    got = {(r.doc_id, r.eval_id, r.n_words, r.place) for r in leakage.find_leaks(docs, items, shard_words=50).collect()}
    assert got == {(1, 7, 13, 0), (5, 7, 40, 0)}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0
    kept = leakage.without_leaks(docs, leakage.find_leaks(docs, items))
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 6}


def test_found_leaks_equal_brute_force(spark):
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/eval_item.parquet")
    of = {}
    for i, t in zip(items.eval_id, items.text):
        for g in grams(leakage.words(t)):
            of.setdefault(g, set()).add(i)
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for g in grams(leakage.words(t)) for i in of.get(g, ())}
    assert {tuple(r) for r in registered.p7_found(spark, SF).collect()} == want and want
    runs = dict(zip(docs.doc_id, map(leakage.words, docs.text)))
    asked = dict(zip(items.eval_id, map(leakage.words, items.text)))
    longest = {}
    for d, i in want:
        n = 13
        while n < len(asked[i]) and grams(runs[d], n + 1) & grams(asked[i], n + 1):
            n += 1
        longest[d, i] = n
    matches = registered.p7_matches(spark, SF).collect()
    assert {(r.doc_id, r.eval_id): r.n_words for r in matches} == longest
    for r in matches:
        assert runs[r.doc_id][r.place : r.place + r.n_words] == asked[r.eval_id][r.item_place : r.item_place + r.n_words]
    assert {r.doc_id for r in registered.p7_kept(spark, SF).collect()} == set(docs.doc_id) - {d for d, _ in want}


def test_encoding_queries(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    restored = {r.doc_id: r.restored for r in registered.p8_restored(spark, SF).collect()}
    assert {r.doc_id for r in registered.p8_found(spark, SF).collect()} == set(restored) and restored
    for d, y in restored.items():
        assert y != docs[d] or encoding.LOST in y or encoding.CONTROL.search(y)


def test_container_queries(spark):
    packed = registered.p6_containers(spark, SF).toPandas()
    filled = {r.container: (r.n_pieces, r.n_tokens) for r in registered.p6_fill(spark, SF).collect()}
    assert filled == {c: (len(g), g["size"].sum()) for c, g in packed.groupby("container")}


# ---- encoding


@pytest.fixture(scope="module")
def model(spark):
    return encoding.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_garbled_forms_are_restored(model):
    restorer = encoding.Restorer(model)
    text = "Der Griff ist hübsch anzusehen, während der Deckel größer als gedacht war und übermäßig schwer."
    for chain in [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp437")]:
        garbled = encoding.misread(text, *chain)
        assert restorer.text(garbled) == (text, True), chain
    twice = encoding.misread(encoding.misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restorer.text(twice) == (text, True)
    assert restorer.text(text) == (text, False)


def test_every_stretch_is_restored(model):
    restorer = encoding.Restorer(model)
    text = "Der Griff ist hübsch anzusehen, während der Deckel größer als gedacht war und übermäßig schwer."
    garbled = encoding.misread(text, "cp1252", "mac_roman")
    for n in (9, 40):
        assert restorer.text(" 日本語 ".join([garbled] * n)) == (" 日本語 ".join([text] * n), True), n
    assert restorer.text(" 日本語 ".join([garbled, text] * 12)) == (" 日本語 ".join([text] * 24), True)


def test_long_runs_are_cut_between_sequences(model):
    restorer = encoding.Restorer(model)
    text = "привет—мир…да" * 80
    once = encoding.misread(text, "utf-8", "cp1252")
    for garbled in (once, encoding.misread(once, "utf-8", "cp1252")):
        assert restorer.text(garbled) == (text, True)
        pieces = list(encoding._pieces(garbled))
        assert len(pieces) > 3 and "".join(garbled[a:b] for a, b in pieces) == garbled


def test_lost_characters_misread_again(model):
    restorer = encoding.Restorer(model)
    for name in encoding.READ_AS:
        if name != encoding.UNPROVEN:
            again = encoding.misread("caf�", "utf-8", name)
            assert not encoding.is_clean(f"a {again} tray"), name
            assert restorer.text(f"a {again} tray") == ("a caf� tray", True), name
    assert restorer.text("ï¿½") == ("�", True) and restorer.text("gut ï¿½brig hÃ¼bsch") == ("gut �brig hübsch", True)


def test_unseen_characters_of_long_sequences(model):
    restorer = encoding.Restorer(model)
    rare = "🦕"
    assert model._n(rare) == 0
    assert restorer.text("nice " + encoding.misread(rare, "utf-8", "cp1252")) == ("nice " + rare, True)
    assert restorer.text(f"nice {rare}") == (f"nice {rare}", False)
    assert all(restorer.utf8(form)[1] <= model.margin for form in "┌──┐ │ok│ └──┘ ╔══╗ ╚══╝ ░▒▓█ ═╝".split())


def test_odd_but_correct_texts_are_left(model):
    restorer = encoding.Restorer(model)
    for text in ["", "plain", "ATENÇÃO, DECEPÇÃO!", "£9 – 11 € ½ lb ±0.2 90 °C", "Ｇｒｅａｔ 🙂", "caf́e jusqu’à l’été", "NÃO COMPREM", "Nº 2"]:
        assert restorer.text(text) == (text, False), text
    assert restorer.text("caf� tray") == ("caf� tray", True)


def test_held_out_accuracy(spark, model):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    restorer = encoding.Restorer(model)
    clean = [t for t in docs.text if encoding.is_clean(t) and not t.isascii() and not restorer.text(t)[1]][:200]
    right = found = n = 0
    for i, t in enumerate(clean):
        garbled = encoding.misread(t, *encoding.VALIDATION_CHAINS[i % 5])
        if garbled != t and encoding.LOST not in garbled:
            y, g = restorer.text(garbled)
            n, found, right = n + 1, found + g, right + (y == t)
    assert found >= 0.97 * n and right >= 0.9 * n, (found, right, n)


def test_precision_and_every_single_byte_chain(spark, model):
    """Recall over all texts of two and more foreign forms, whichever pair of encodings; precision over all that are clean by their form."""
    texts = [t for t in pd.read_parquet(f"{SF}/documents.parquet").text if encoding.is_clean(t) and not t.isascii()]
    restorer = encoding.Restorer(model)
    flagged = sum(restorer.garbled(t) for t in texts)
    assert flagged <= 0.03 * len(texts), flagged  # garbled ones that read single-byte by single-byte are among them
    texts = [t for t in texts if not restorer.garbled(t) and len({f for f in t.split() if not f.isascii()}) >= 4][:40]
    lost = {}
    for written in encoding.READ_AS:
        for read in encoding.READ_AS:
            made = [(t, encoding.misread(t, written, read)) for t in texts if written != read and encoding.to_bytes(t, written)]
            made = [(t, g) for t, g in made if g != t and not encoding.CONTROL.search(g)]
            if made:
                lost[written, read] = 1 - sum(restorer.text(g)[1] for _, g in made) / len(made)
    assert len(lost) > 60 and np.mean(list(lost.values())) < 0.1, {k: v for k, v in lost.items() if v > 0.1}


def test_restore_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "so hübsch"), (4, "Ich wÃ¼rde es kaufen"), (4, "Ich wÃ¼rde es kaufen"), (5, "x " * 50_000 + "wÃ¼rde " + "ü" * 3000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, restored string")
    got = [(r.doc_id, r.restored[:20]) for r in encoding.restore(docs, model).collect()]
    assert sorted(got) == [(4, "Ich würde es kaufen"), (4, "Ich würde es kaufen"), (5, "x " * 10)]
    assert encoding.restore(docs.limit(0), model).count() == 0


def test_held_out_records_are_counted_in_the_end(spark):
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(encoding.HELD_OUT)) == 0
    n = docs.filter(held).count()
    model = encoding.train(docs.withColumn("text", F.when(held, "ein žlutý kůň").otherwise("ein hübscher Griff")))
    assert n > 3 and model._n("ž") == n - 1 and model._n("ü") == 200 - n - 1


def test_training_on_nothing(spark):
    model = encoding.train(spark.createDataFrame([], "doc_id long, text string"))
    assert encoding.Restorer(model).text("naïve") == ("naïve", False)


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_fill_keeps_capacity(sizes):
    part = packing.fill(np.array(sizes), 50)
    sums = np.bincount(part, weights=sizes)
    assert len(part) == len(sizes) and sums.max() <= 50
    assert len(sums) <= 2 * -(-sum(sizes) // 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_least_containers_is_a_bound(sizes):
    def fewest(rest, loads):
        if not rest:
            return len(loads)
        options = [loads[:i] + [load + rest[0]] + loads[i + 1 :] for i, load in enumerate(loads) if load + rest[0] <= 12] + [[*loads, rest[0]]]
        return min(fewest(rest[1:], o) for o in options)

    best = fewest(sorted(sizes, reverse=True), [])
    assert packing.least_containers(np.array(sizes), 12) <= best <= packing.fill(np.array(sizes), 12).max() + 1


def best_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(room, s)
        bisect.insort(room, (room.pop(at) if at < len(room) else capacity) - s)
    return len(room)


@pytest.mark.parametrize("low, high, n", [(400, 1400, 580), (300, 700, 1050), (600, 1100, 620), (100, 2000, 500), (1, 200, 5000), (1025, 1025, 512), (683, 683, 768)])
def test_fill_is_near_best_fit(low, high, n):
    sizes = np.random.default_rng(5).integers(low, high + 1, n)
    began = time.perf_counter()
    used = packing.fill(sizes, 2048).max() + 1
    assert used <= 1.02 * best_fit_decreasing(sizes, 2048) and time.perf_counter() - began < 5


def test_differencing_balances():
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    sizes = np.random.default_rng(2).integers(1, 400, 3000)
    sums = np.bincount(packing.differencing(sizes, 64), weights=sizes)
    assert sums.max() - sums.min() <= 2


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = packing.token_counts(docs).toPandas()
    packed = packing.pack(spark.createDataFrame(sized)).toPandas()
    assert packed.groupby("container")["size"].sum().max() <= packing.CAPACITY
    assert packed.groupby("doc_id")["size"].sum().to_dict() == sized[sized.n_tokens > 0].set_index("doc_id").n_tokens.to_dict()
    small = set(sized[sized.n_tokens <= packing.CAPACITY].doc_id)
    assert not packed[packed.doc_id.isin(small)].duplicated("doc_id").any()
    used = packed["size"].sum() / (packed.container.nunique() * packing.CAPACITY)
    assert used > 0.98, used
    assert not packed.duplicated(["container", "place"]).any()


def test_pack_odd_rows(spark):
    sized = spark.createDataFrame([(1, None), (2, 0), (3, 10), (4, 25), (5, 10)], "doc_id long, n_tokens long")
    got = {(r.doc_id, r.piece, r.start, r.size) for r in packing.pack(sized, capacity=10).collect()}
    assert got == {(3, 0, 0, 10), (4, 0, 0, 10), (4, 1, 10, 10), (4, 2, 20, 5), (5, 0, 0, 10)}
    assert packing.pack(sized.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sized, capacity=0)

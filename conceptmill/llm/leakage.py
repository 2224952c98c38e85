"""Find evaluation passages in training text with suffix arrays over the training text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Consecutive words that make a leak.
LEAK_WORDS = 13
#: Words of one training shard, whose suffix array is built in memory at once.
SHARD_WORDS = 400_000
#: Characters of evaluation items that are broadcast at once; further items take further passes.
ITEM_CHARS = 32_000_000

_MARKUP = regex.compile(r"<[^<>]*>")
_DROPPED = regex.compile("[​-‍﻿­]")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, markup to spaces, invisible characters out, lower case."""
    if not text:
        return []
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if "<" in t:
        t = _MARKUP.sub(" ", t)
    return _WORD.findall((t if t.isascii() else _DROPPED.sub("", t)).lower())


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over at least ``depth`` words, by prefix doubling."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else 0
        rank = new
        k *= 2
        if n and rank.max() == n:
            break
    return order


def _bound(text: np.ndarray, order: np.ndarray, items: np.ndarray, at: np.ndarray, length: int, upper: bool) -> np.ndarray:
    """For each item suffix, by binary search, the first place in ``order`` whose first ``length`` words are not less (or are greater)."""
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(order), dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        middle = (low[live] + high[live]) // 2
        place = order[middle]
        verdict = np.zeros(len(live), dtype=np.int8)
        open_ = np.arange(len(live))
        for j in range(length):
            a = text[np.minimum(place[open_] + j, len(text) - 1)]
            a = np.where(place[open_] + j < len(text), a, -1)
            b = items[at[live[open_]] + j]
            verdict[open_] = np.sign(a - b)
            open_ = open_[a == b]
            if not len(open_):
                break
        right = verdict < 0 if not upper else verdict <= 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]
        live = live[low[live] < high[live]]
    return low


class Items:
    """Evaluation items as one run of word numbers, with the starts of their suffixes of LEAK_WORDS words and more."""

    def __init__(self, rows: list[tuple[object, str | None]], least: int):
        self.ids = [item for item, _ in rows]
        vocabulary: dict[str, int] = {}
        runs, starts, owner, place, at = [], [], [], [], 0
        self.longest = 0
        for item, (_, text) in enumerate(rows):
            ws = words(text)
            run = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]
            self.longest = max(self.longest, len(run))
            for i in range(len(run) - least + 1):
                starts.append(at + i)
                owner.append(item)
                place.append(i)
            runs += [*run, 0]
            at += len(run) + 1
        self.vocabulary, self.least = vocabulary, least
        self.text = np.array([*runs, 0], dtype=np.int64)
        self.starts, self.owner, self.place = (np.array(x, dtype=np.int64) for x in (starts, owner, place))
        #: the word before each of the suffixes, 0 at the begin of an item
        self.before = np.where(self.place > 0, self.text[np.maximum(self.starts - 1, 0)], 0)


#: Hits that are expanded at once.
STEP = 2_000_000


def _blocks(widths: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of ``widths`` in blocks that sum up to about STEP."""
    ends = np.cumsum(widths)
    begin = 0
    while begin < len(widths):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, side="right")))
        yield np.arange(begin, end)
        begin = end


def _spread(which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``which`` as often as its range is long, and the numbers of the ranges."""
    width = end - begin
    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(which, width), np.repeat(begin, width) + inner


def _longest(text: np.ndarray, doc: np.ndarray, first: np.ndarray, items: Items, place: np.ndarray, query: np.ndarray) -> pd.DataFrame:
    """The hits at ``place`` of the item suffixes ``query``, extended to the right; the longest per document and item."""
    length = np.full(len(place), items.least, dtype=np.int64)
    open_ = np.arange(len(place))
    while len(open_):
        a, b = place[open_] + length[open_], items.starts[query[open_]] + length[open_]
        same = (a < len(text)) & (items.text[b] != 0)
        same &= text[np.minimum(a, len(text) - 1)] == items.text[b]
        open_ = open_[same]
        length[open_] += 1
    hits = pd.DataFrame({"doc": doc[place], "item": items.owner[query], "n_words": length, "place": place - first[doc[place]], "item_place": items.place[query]})
    return hits.sort_values(["n_words", "place", "item_place"], ascending=[False, True, True]).drop_duplicates(["doc", "item"])


def shard_matches(ids: list, runs: list[list[str]], items: Items) -> pd.DataFrame:
    """The longest match of each (document, item) of one shard: id, item, n_words, place, item_place."""
    vocabulary = dict(items.vocabulary)
    text = np.fromiter((x for run in runs for x in (*[vocabulary.get(w, 0) for w in run], -2)), dtype=np.int64)
    # words that no item has, and document ends, are numbered apart, so that no suffix runs over them
    rare = text <= 0
    text[rare] = len(vocabulary) + 1 + np.arange(int(rare.sum()))
    doc = np.repeat(np.arange(len(runs)), [len(r) + 1 for r in runs])
    first = np.cumsum([0, *[len(r) + 1 for r in runs]])
    # suffixes that begin with a word of no item are beyond every item suffix in the order
    order = suffix_array(text, items.longest + 1)
    low = _bound(text, order, items.text, items.starts, items.least, False)
    high = _bound(text, order, items.text, items.starts, items.least, True)
    found = high > low
    if not found.any():
        return pd.DataFrame(columns=["id", "item", "n_words", "place", "item_place"])
    low, high, query = low[found], high[found], np.nonzero(found)[0]
    # The longest match of a document and an item cannot be lengthened to the left, so only hits after another word than
    # the item's count. Hits lie in the order of their suffixes; those after one word form runs there, which are passed over as a whole.
    before = np.where(order > 0, text[order - 1], -1)
    run_starts = np.append(np.nonzero(np.append(True, before[1:] != before[:-1]))[0], len(order))
    first_run, last_run = np.searchsorted(run_starts, low, side="right") - 1, np.searchsorted(run_starts, high, side="left")
    out = []
    for at in _blocks(last_run - first_run):
        q, run = _spread(at, first_run[at], last_run[at])
        differs = before[run_starts[run]] != items.before[query[q]]
        q, run = q[differs], run[differs]
        begin, end = np.maximum(run_starts[run], low[q]), np.minimum(run_starts[run + 1], high[q])
        for part in _blocks(end - begin):  # hits are expanded in blocks, so a passage with very many copies stays within memory
            which, rank = _spread(part, begin[part], end[part])
            out.append(_longest(text, doc, first, items, order[rank], query[q[which]]))
    if not out:
        return pd.DataFrame(columns=["id", "item", "n_words", "place", "item_place"])
    hits = pd.concat(out).sort_values(["n_words", "place", "item_place"], ascending=[False, True, True]).drop_duplicates(["doc", "item"])
    hits["id"], hits["item"] = [ids[i] for i in hits.doc], [items.ids[i] for i in hits["item"]]
    return hits[["id", "item", "n_words", "place", "item_place"]]


def _item_blocks(rows: Iterator) -> Iterator[list[tuple]]:
    """Items in blocks of about ITEM_CHARS characters."""
    block, chars = [], 0
    for row in rows:
        block.append((row[0], row[1]))
        chars += len(row[1])
        if chars > ITEM_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _searcher(shared, shard_words: int):
    """The search of the broadcast items in one partition's documents (id, text), shard by shard."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        overlap = known.longest
        ids: list = []
        runs: list[list[str]] = []
        base: list[int] = []
        n = 0

        def flush() -> pd.DataFrame:
            found = shard_matches(list(range(len(ids))), runs, known)
            found["place"] = [p + base[i] for i, p in zip(found.id, found.place)]
            found["id"] = [ids[i] for i in found.id]
            return found

        for pdf in batches:
            for i, t in zip(pdf.id, pdf.text):
                ws = words(t)
                if len(ws) < known.least:
                    continue
                for at in range(0, max(1, len(ws) - overlap), shard_words):
                    piece = ws[at : at + shard_words + overlap]
                    ids.append(i)
                    runs.append(piece)
                    base.append(at)
                    n += len(piece)
                    if n >= shard_words:
                        yield flush()
                        ids, runs, base, n = [], [], [], 0
        if ids:
            yield flush()

    return search


def find_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "eval_id", text_column: str = "text", least: int = LEAK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, item, n_words, place, item_place): the longest verbatim match of each document and item, in words.

    The documents of a partition are cut into shards of ``shard_words`` words; each shard gets its suffix array, in
    which every item suffix of ``least`` words and more is searched by bisection. All
    documents that share ``least`` consecutive words with an item come out, with the longest such
    stretch and where it lies in either. A document beyond the shard size is cut into pieces that overlap by the longest item.

    Item texts are taken in blocks of ITEM_CHARS characters, each sent to the executors, searched against all documents and
    given up before the next; the driver holds two at most.
    Defined cases: NULL and empty texts and items of fewer words match nothing; ties go to the earliest place; repeated
    document ids come out once per pair.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_words long, place long, item_place long"
    slim = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.length("text") > 0)
    results: list[DataFrame] = []
    rest = _item_blocks(items.select(item_column, text_column).filter(F.length(text_column) > 0).orderBy(item_column).toLocalIterator())
    block = next(rest, [])
    while block is not None:
        following = next(rest, None)
        shared = spark.sparkContext.broadcast(Items(block, least))
        found = slim.mapInPandas(_searcher(shared, shard_words), schema)
        if following is not None or results:  # one block is searched and forgotten before the next one is sent
            found = cut(found)
            shared.unpersist()
        results.append(found)
        block = following
    result = reduce(DataFrame.unionByName, results)
    best = F.max(F.struct("n_words", (-F.col("place")).alias("p"), (-F.col("item_place")).alias("q")))
    merged = result.groupBy("id", "item").agg(best.alias("b"))
    return merged.select(F.col("id").alias(id_column), F.col("item").alias(item_column), F.col("b.n_words").alias("n_words"), (-F.col("b.p")).alias("place"), (-F.col("b.q")).alias("item_place"))


def without_leaks(documents: DataFrame, leaks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents that leak no item."""
    return documents.join(leaks.select(id_column).distinct(), id_column, "left_anti")

"""Fill containers of fixed capacity with texts by multiway differencing."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Tokens of a container.
CAPACITY = 2048
#: Containers that one block of items fills, about; items of a block are partitioned together in one task.
BLOCK_CONTAINERS = 256
#: Items of one block, about; a block of very small items fills fewer containers.
BLOCK_ITEMS = 16_384
#: Blocks of one task, so that the scheduler does not put many seconds of work together because their rows are few bytes.
BLOCKS_PER_TASK = 4
#: The session's setting of the vocabulary file, and where it lies if that is unset.
TOKENIZER_SETTING, TOKENIZER = "conceptmill.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_of(spark: SparkSession) -> str:
    return spark.conf.get(TOKENIZER_SETTING, TOKENIZER)


def token_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens) of whole texts; NULL and empty texts have 0.

    ``tokenizer`` is a vocabulary file in tiktoken's format, by default the one that the session's ``conceptmill.tokenizer``
    names. Only the driver reads it; its bytes, of a vocabulary's size, are sent to the executors.
    """
    spark = documents.sparkSession
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    shared = spark.sparkContext.broadcast((Path(tokenizer or tokenizer_of(spark)).read_bytes(), pattern))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(*shared.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf.text]})

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(count, f"id {kind}, n_tokens long").withColumnRenamed("id", id_column)


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A number of containers that no packing goes below.

    Items above half the capacity need one each. For every k up to half the capacity, items of k and more fit only beside those
    of at most capacity - k; what does not fit there needs further containers.
    """
    falling = np.sort(sizes)[::-1]
    total = np.concatenate([[0], np.cumsum(falling)])
    half = int(np.sum(2 * falling > capacity))
    ks = np.append(np.unique(falling[half:]), 0)
    alone = np.minimum(np.searchsorted(-falling, ks - capacity), half)
    reach = np.searchsorted(-falling, -ks, side="right")
    room = (half - alone) * capacity - (total[half] - total[alone])
    return max(1, half + int(np.maximum(0, -(-(total[reach] - total[half] - room) // capacity)).max()))


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each item, by Karmarkar-Karp multiway differencing.

    A state is a partial partition with its part sums in falling order, less the least sum. The two
    states with the largest imbalance merge, the largest sums of one with the smallest of
    the other, until one state is left. A state holds its filled parts only, so that an item begins as one number; parts are
    linked lists known by their first item, so that a merge joins them in constant time.
    """
    n = len(sizes)
    if parts <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    last, following = np.arange(n), np.full(n, -1, dtype=np.int64)
    states = {i: (np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        b = heap[0][1]
        (sums_a, lists_a), (sums_b, lists_b) = states[a], states.pop(b)
        both = max(0, len(sums_a) + len(sums_b) - parts)  # parts that both states fill
        apart_a, apart_b = len(sums_a) - both, len(sums_b) - both
        front, back = lists_a[apart_a:], lists_b[apart_b:][::-1]
        following[last[front]] = back
        last[front] = last[back]
        sums = np.concatenate([sums_a[:apart_a], sums_a[apart_a:] + sums_b[apart_b:][::-1], sums_b[:apart_b]])
        lists = np.concatenate([lists_a, lists_b[:apart_b]])
        order = np.argsort(-sums, kind="stable")
        sums, lists = sums[order], lists[order]
        if len(sums) == parts:
            sums = sums - sums[-1]
        states[a] = (sums, lists)
        heapq.heapreplace(heap, (-int(sums[0] - (sums[-1] if len(sums) == parts else 0)), a))
    part = np.zeros(n, dtype=np.int64)
    for p, item in enumerate(states[heap[0][1]][1]):
        while item >= 0:
            part[item] = p
            item = following[item]
    return part


class Windows:
    """A partition under repair: items leave overfull windows until none is left."""

    def __init__(self, sizes: np.ndarray, part: np.ndarray, parts: int, capacity: int):
        self.sizes, self.part, self.capacity = sizes, part.copy(), capacity
        self.load = np.bincount(part, weights=sizes, minlength=parts).astype(np.int64)
        self.items: list[set[int]] = [set() for _ in range(parts)]
        for i, p in enumerate(part):
            self.items[p].add(i)

    def move(self, item: int, to: int) -> None:
        at = int(self.part[item])
        self.items[at].remove(item)
        self.items[to].add(item)
        self.load[at] -= self.sizes[item]
        self.load[to] += self.sizes[item]
        self.part[item] = to

    def relieve(self, window: int) -> bool:
        """The move of one item, or its exchange for a smaller one, that mends an overfull window with the least room
        left over, or else lessens it most. No other window becomes overfull; False if there is none."""
        need, slack = int(self.load[window]) - self.capacity, self.capacity - self.load
        open_ = np.nonzero(slack > 0)[0]
        others = np.nonzero(slack[self.part] > 0)[0]
        best = None
        for item in sorted(self.items[window], key=lambda i: (self.sizes[i], i)):
            size = int(self.sizes[item])
            fits = open_[slack[open_] >= size]
            if len(fits):
                to = fits[slack[fits].argmin()]
                rank = (0, int(slack[to]) - size) if size >= need else (1, -size)
                best = min(best, (rank, item, int(to), -1)) if best else (rank, item, int(to), -1)
            less = size - self.sizes[others]
            can = (less > 0) & (less <= slack[self.part[others]])
            if can.any():
                swapped, less = others[can], less[can]
                mends = less >= need
                if mends.any():
                    swapped, less = swapped[mends], less[mends]
                    room = slack[self.part[swapped]] - need
                    at = int(room.argmin())
                    rank = (0, int(room[at]))
                else:
                    at = int(less.argmax())
                    rank = (1, -int(less[at]))
                other = int(swapped[at])
                best = min(best, (rank, item, int(self.part[other]), other)) if best else (rank, item, int(self.part[other]), other)
        if best is None:
            return False
        _, item, to, other = best
        self.move(item, to)
        if other >= 0:
            self.move(other, window)
        return True

    def repair(self) -> np.ndarray:
        """The window of each item, none overfull. Whenever no exchange helps any more, the window count rises by one; each
        step lessens the sum of what exceeds the capacity, so it ends."""
        stuck = np.zeros(len(self.load), dtype=bool)
        while True:
            over = np.where(stuck, 0, self.load - self.capacity)
            window = int(over.argmax())
            if over[window] > 0:
                stuck[window] = not self.relieve(window)
            elif stuck.any():
                self.load, stuck = np.append(self.load, 0), np.zeros(len(self.load) + 1, dtype=bool)
                self.items.append(set())
            else:
                return np.unique(self.part, return_inverse=True)[1]


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item of a block; no item is larger than the capacity.

    Differencing makes as many near-equal windows as no packing goes below. Items then leave overfull windows by moves
    and exchanges; where these do not suffice, the window count rises and the repair goes on from there.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    sizes = np.asarray(sizes, dtype=np.int64)
    parts = least_containers(sizes, capacity)
    return Windows(sizes, differencing(sizes, parts), parts, capacity).repair()


def pack(sized: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", capacity: int = CAPACITY, block_containers: int = BLOCK_CONTAINERS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, piece, start, size, container, place): every item assigned to a container, in blocks of bounded size.

    Items larger than the capacity are cut: full pieces fill containers of their own, the
    remainder is packed like any item. Items spread over blocks by a hash of id and piece, about
    ``block_containers`` containers or ``block_items`` items each, so that copies and hot sizes spread as well and a block
    is one task's work of seconds at any input size.

    Defined cases: items of size 0 or NULL get no container; a capacity below 1 is an error; the id must be unique; an
    empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = sized.select(F.col(id_column).alias("id"), F.col(size_column).cast("long").alias("size")).filter(F.col("size") > 0)
    pieces = items.select("id", F.col("size").alias("whole"), F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("size"))
    pieces = cut(pieces)
    open_ = pieces.filter(F.col("size") < capacity)
    total, n = open_.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, round(total / (capacity * block_containers)), -(-n // block_items))
    key = F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("long")
    kind = items.schema["id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"]).reset_index(drop=True)
        part = fill(pdf["size"].to_numpy(), capacity)
        pdf["container"] = pdf.block.astype(str) + "-" + pd.Series(part).astype(str)
        pdf["place"] = pdf.groupby("container").cumcount()
        return pdf[["id", "piece", "start", "size", "container", "place"]]

    spread = open_.withColumn("block", key).repartition(min(-(-blocks // BLOCKS_PER_TASK), 100_000), "block")
    packed = spread.groupBy("block").applyInPandas(one, f"id {kind}, piece int, start long, size long, container string, place long")
    full = pieces.filter(F.col("size") == capacity).withColumn("container", F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string"))).withColumn("place", F.lit(0).cast("long"))
    return packed.unionByName(full).withColumnRenamed("id", id_column)

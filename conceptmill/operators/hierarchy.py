"""Parent-child rows to full hierarchies by heavy-path decomposition.

All steps are joins and aggregations over tables with one row per node. Pointer doubling keeps
the number of rounds logarithmic in the depth; lineage is cut once per round. Nothing but round
counters and the keys of :func:`conceptmill.session.hot_keys` reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, skew_join, told

#: Siblings of one parent are numbered in this many salted groups.
SIBLING_GROUPS = 64
#: Depth-first numbers of one root that :func:`descendants` joins by one key.
NUMBERS_PER_BLOCK = 64


@dataclass
class Forest:
    """``nodes``: node, root, depth, chain, place, size, first (0 = the root's own number in depth-first order),
    tree nodes only. ``chains``: chain, up, up_place, root, depth, first. ``cyclic``: node, cycle, on_cycle.
    Not ``numbered``: first means nothing."""

    nodes: DataFrame
    chains: DataFrame
    cyclic: DataFrame
    numbered: bool = True


def _nodes(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent); of several parents the least holds, NULL ends are no links."""
    valid = links.filter(F.col(child).isNotNull() & F.col(parent).isNotNull())
    both = valid.select(F.col(child).alias("node"), F.col(parent).alias("parent")).unionByName(valid.select(F.col(parent).alias("node"), F.lit(None).cast(links.schema[parent].dataType).alias("parent")))
    return cut(both.groupBy("node").agg(F.min("parent").alias("parent")), told={"n": F.count(F.lit(1))})


def _live() -> dict[str, Column]:
    """Rows that still have somewhere to jump to."""
    return {"live": F.count("jump")}


def _followed(state: DataFrame, node: str, total: int | None, *columns: str) -> DataFrame:
    """``state`` joined with jump2 and, as name2, the ``columns`` of the row it jumps to.

    Rows that have arrived (NULL jump) would meet in one task; they are joined with themselves instead, which
    gives them NULL, so their place is anywhere.
    """
    own = F.col("jump").isNull()
    left = state.withColumn("to", F.coalesce("jump", node))
    above = state.select(F.col(node).alias("to"), F.col("jump").alias("jump2"), *[F.col(c).alias(f"{c}2") for c in columns])
    joined = skew_join(left, above, "to", total=total) if total is not None else left.join(above, "to", "left")
    return joined.select(*state.columns, "jump2", *[F.when(~own, F.col(f"{c}2")).alias(f"{c}2") for c in columns])


def _subtree_sizes(nodes: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """Tree nodes with subtree size, the nodes on or below a cycle, and the number of these.

    After r rounds ``size`` counts the descendants nearer than 2^r and ``jump`` is the ancestor
    2^r above, NULL past the root. Once a round lets no further node pass its root, those that
    have not passed it never will: they run into a cycle.
    """
    state = nodes.select("node", "parent", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size"))
    live = None
    while True:
        gains = state.filter(F.col("jump").isNotNull()).groupBy("jump").agg(F.sum("size").alias("gain")).withColumnRenamed("jump", "node")
        further = _followed(state, "node", total).withColumn("jump", F.col("jump2"))
        state = cut(further.join(gains, "node", "left").select("node", "parent", "jump", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), instead_of=state, told=_live())
        before, live = live, told(state, "live")
        if live in (before, 0):
            return state.filter(F.col("jump").isNull()).drop("jump"), state.filter(F.col("jump").isNotNull()).select("node", "parent"), live


def _cycles(rest: DataFrame, total: int) -> DataFrame:
    """(node, cycle, on_cycle): ``cycle`` is the least node of the cycle that the node lies on or runs into."""
    state = rest.select("node", F.col("parent").alias("jump"), F.col("node").alias("least"))
    ends = -1
    while True:
        above = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        joined = skew_join(state.select("node", "jump", "least"), above, "jump", how="inner", total=total)
        state = cut(joined.select("node", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")), instead_of=state)
        seen = state.agg(F.count_distinct("jump").alias("ends"), F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("moved")).first()
        if seen["ends"] == ends and not seen["moved"]:
            break
        ends = seen["ends"]
    on = state.select("jump").distinct().join(state.select(F.col("node").alias("jump"), F.col("least").alias("cycle")), "jump")
    found = skew_join(state.select("node", "jump"), on, "jump", how="inner", total=total).select("node", "cycle")
    return found.join(on.select(F.col("jump").alias("node"), F.lit(True).alias("on_cycle")), "node", "left").select("node", "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _sibling_offsets(light: DataFrame) -> DataFrame:
    """(node, before): summed sizes of the light siblings numbered before the node, in salted groups."""
    group = F.pmod(F.xxhash64("node"), F.lit(SIBLING_GROUPS))
    salted = light.select("node", "parent", "size", group.alias("g"))
    sums = salted.groupBy("parent", "g").agg(F.sum("size").alias("s"))
    starts = sums.withColumn("start", F.sum("s").over(Window.partitionBy("parent").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))).select("parent", "g", F.coalesce("start", F.lit(0)).alias("start"))
    inner = F.sum("size").over(Window.partitionBy("parent", "g").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    within = salted.withColumn("inner", F.coalesce(inner, F.lit(0)))
    return within.join(starts, ["parent", "g"]).select("node", (F.col("inner") + F.col("start")).alias("before"))


def heavy_paths(links: DataFrame, child: str, parent: str, numbers: bool = True) -> Forest:
    """Decompose the forest of ``links`` into heavy chains, cycles set apart first.

    The child with the largest subtree continues its parent's chain (ties: the greatest id).
    A node's root and depth come from its chain's; its path is the chain segments
    joined, at most log2(n) of them; with ``numbers`` each chain has consecutive depth-first numbers,
    so the descendants of a node are the numbers first .. first + size - 1 of its root.

    Defined cases: copies count once; of several parents the least holds; rows with a NULL
    end are left out; a node that is its own parent is a cycle; an empty table gives empty tables.
    """
    nodes = _nodes(links, child, parent)
    total = told(nodes, "n")
    trees, rest, n_rest = _subtree_sizes(nodes, total)
    cyclic = cut(_cycles(rest, n_rest)) if n_rest else rest.select("node", F.col("node").alias("cycle"), F.lit(True).alias("on_cycle"))
    n = total - n_rest

    # the heavy child of each parent, keyed by the child: unique on both sides
    heavy = trees.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h")).select(F.col("h.node").alias("node"), F.lit(True).alias("is_heavy"))
    marked = trees.join(heavy, "node", "left")

    # chain of each node: doubling along heavy links, of which every node has at most one below it
    state = cut(marked.select("node", "parent", "size", F.when(F.col("is_heavy"), F.col("parent")).alias("jump"), F.col("is_heavy").isNotNull().cast("long").alias("place"), F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("node")).alias("chain")), told=_live())
    while told(state, "live"):
        last = state
        for _ in range(2):
            state = _followed(state, "node", None, "place", "chain").select("node", "parent", "size", F.col("jump2").alias("jump"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"), F.coalesce("chain2", "chain").alias("chain"))
        state = cut(state, instead_of=last, told=_live())
    labelled = state.drop("jump")

    # one row per chain: where it hangs on another chain
    heads = labelled.filter(F.col("place") == 0).select(F.col("node").alias("chain"), "parent", "size")
    at = labelled.select(F.col("node").alias("parent"), F.col("chain").alias("up"), F.col("place").alias("up_place"))
    first = F.lit(0).cast("long")
    if numbers:
        light = heads.filter(F.col("parent").isNotNull()).select(F.col("chain").alias("node"), "parent", "size")
        heads = heads.join(_sibling_offsets(light).withColumnRenamed("node", "chain"), "chain", "left")
        at = at.join(labelled.filter(F.col("place") > 0).select("parent", F.col("size").alias("heavy_size")), "parent", "left")
        first = F.coalesce(F.col("up_place") + 1 + F.coalesce("heavy_size", F.lit(0)) + F.col("before"), F.lit(0))
    hung = skew_join(heads, at, "parent", total=n)
    chains = cut(hung.select("chain", "up", "up_place", F.coalesce("up", "chain").alias("root"), F.coalesce(F.col("up_place") + 1, F.lit(0)).alias("depth"), first.alias("first"), F.col("up").alias("jump")), told=_live() | {"n": F.count(F.lit(1))})
    n_chains = told(chains, "n")
    while told(chains, "live"):
        further = _followed(chains, "chain", n_chains, "root", "depth", "first")
        chains = cut(further.select("chain", "up", "up_place", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("first") + F.coalesce("first2", F.lit(0))).alias("first"), F.col("jump2").alias("jump")), instead_of=chains, told=_live())
    chains = chains.drop("jump")

    of_chain = chains.select("chain", "root", F.col("depth").alias("d0"), F.col("first").alias("f0"))
    full = skew_join(labelled, of_chain, "chain", how="inner", total=n)
    full = full.select("node", "root", (F.col("d0") + F.col("place")).alias("depth"), "chain", "place", "size", (F.col("f0") + F.col("place")).alias("first"))
    return Forest(full, chains, cyclic, numbers)


def roots_and_depths(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth); on a cycle: its least node and -1, below one: the same node and -2."""
    forest = heavy_paths(links, child, parent, numbers=False)
    return forest.nodes.select("node", "root", "depth").unionByName(forest.cyclic.select("node", F.col("cycle").alias("root"), F.when(F.col("on_cycle"), -1).otherwise(-2).cast("long").alias("depth")))


def paths(forest: Forest) -> DataFrame:
    """(node, path): the nodes from the root to the node, chain segments joined.

    A chain's segment is as long as the longest path through it, which the result holds anyway.
    """
    segments = forest.nodes.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("segment"))
    segments = cut(segments)
    ups = forest.chains.filter(F.col("up").isNotNull()).select("chain", F.col("up"), "up_place")
    lead = skew_join(ups, segments.withColumnRenamed("chain", "up"), "up", how="inner").select("chain", F.col("up").alias("jump"), F.slice("segment", F.lit(1), (F.col("up_place") + 1).cast("int")).alias("lead"))
    state = cut(lead, told=_live() | {"n": F.count(F.lit(1))})
    n = told(state, "n")
    while told(state, "live"):
        further = _followed(state, "chain", n, "lead")
        state = cut(further.select("chain", F.col("jump2").alias("jump"), F.when(F.col("lead2").isNull(), F.col("lead")).otherwise(F.concat("lead2", "lead")).alias("lead")), instead_of=state, told=_live())
    whole = segments.join(state.select("chain", "lead"), "chain", "left").select("chain", F.when(F.col("lead").isNull(), F.col("segment")).otherwise(F.concat("lead", "segment")).alias("whole"), F.coalesce(F.size("lead"), F.lit(0)).alias("n_lead"))
    whole = whole.withColumn("n_lead", F.greatest(F.col("n_lead"), F.lit(0)))
    joined = skew_join(forest.nodes.select("node", "chain", "place"), whole, "chain", how="inner")
    return joined.select("node", F.slice("whole", F.lit(1), (F.col("n_lead") + F.col("place") + 1).cast("int")).alias("path"))


def descendants(forest: Forest) -> DataFrame:
    """(ancestor, descendant, distance), proper pairs; the size of the result is the sum of all depths.

    The descendants of a node are the numbers first + 1 .. first + size - 1 of its root: each interval meets
    the nodes of the blocks of numbers that it touches, so no row is longer than a node's and no key is hotter
    than a block and the intervals over it. The forest must have numbers.
    """
    if not forest.numbered:
        raise ValueError("descendants need depth-first numbers")
    block = lambda c: F.floor(c / F.lit(NUMBERS_PER_BLOCK)).cast("long")
    inner = forest.nodes.filter("size > 1").select(F.col("node").alias("ancestor"), "root", F.col("depth").alias("top"), F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end"))
    inner = inner.withColumn("block", F.explode(F.sequence(block(F.col("begin") + 1), block(F.col("end") - 1))))
    below = forest.nodes.select(F.col("node").alias("descendant"), "root", "depth", "first", block(F.col("first")).alias("block"))
    met = inner.join(below, ["root", "block"]).filter((F.col("first") > F.col("begin")) & (F.col("first") < F.col("end")))
    return met.select("ancestor", "descendant", (F.col("depth") - F.col("top")).cast("int").alias("distance"))


def last_of_series(links: DataFrame, node: str, following: str) -> DataFrame:
    """(node, last): the end of the series that a node starts, for links of which each node has one in and one out at most."""
    state = cut(links.select(F.col(node).alias("node"), F.col(following).alias("jump"), F.coalesce(following, node).alias("last")), told=_live())
    while told(state, "live"):
        further = _followed(state, "node", None, "last")
        state = cut(further.select("node", F.col("jump2").alias("jump"), F.coalesce("last2", "last").alias("last")), instead_of=state, told=_live())
    return state.select("node", "last")

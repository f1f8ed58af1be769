"""Matchings of most weight in sparse bipartite graphs of any size.

Edges are cut twice before anything is solved.  A node needs no more than its best k edges, where k is the number of nodes on
the other side's competitors, i.e. the size of its own side (of the table, then of its component): the others can take at most k - 1 of them.  And
components have nothing to do with each other.  A component of bounded size is then solved exactly in a task (many
components a task); the others go through auction rounds, joins and aggregates of their edges with
the prices so far, so no component is ever gathered that is larger than the bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.components import connected
from tablewright.plans.stages import settle

#: Edges that a task may hold, and steps (nodes of the smaller side squared, times all nodes) that it may take for a component.
CELLS, STEPS = 1 << 22, 1 << 34


def solve(left: np.ndarray, right: np.ndarray, weight: np.ndarray, cardinality: bool = True) -> np.ndarray:
    """Which edges are in a matching of most edges, and of those of most weight (cardinality off: of most weight); weights are above 0.

    Shortest augmenting paths from the smaller side, a node at a time, over all edges of a node at once; memory is by the edge.
    A node that is better left alone is matched to a place of its own that costs nothing.
    """
    rows, r = np.unique(left, return_inverse=True)
    columns, c = np.unique(right, return_inverse=True)
    if len(rows) > len(columns):
        rows, columns, r, c = columns, rows, c, r
    n, m = len(rows), len(columns)
    bonus = 1.0 + n * float(weight.max()) if cardinality else 0.0
    # Edges by row; after a row's own comes the place where it is left alone, column m + row.
    start, to, cost = np.concatenate([r, np.arange(n)]), np.concatenate([c, m + np.arange(n)]), np.concatenate([-(weight + bonus), np.zeros(n)])
    by_row = np.argsort(start, kind="stable")
    to, cost, ends = to[by_row], cost[by_row], np.searchsorted(start[by_row], np.arange(n + 1))
    u, v, owner = np.zeros(n), np.zeros(m + n), np.full(m + n, -1)
    for row in range(n):
        # Dijkstra over columns with reduced costs; column -1 stands for the row that looks for a place.
        # Ahead are the distances of columns that are not done.
        least, came, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        ahead = least.copy()
        i, at, far = row, -1, 0.0
        while True:
            own = to[ends[i] : ends[i + 1]]
            way = far + cost[ends[i] : ends[i + 1]] - u[i] - v[own]
            shorter = ~done[own] & (way < least[own])
            near = own[shorter]
            least[near], came[near], ahead[near] = way[shorter], at, way[shorter]
            at = int(np.argmin(ahead))
            far = least[at]
            if owner[at] < 0:
                break
            done[at], ahead[at] = True, np.inf
            i = owner[at]
        u[row] += far
        held = np.flatnonzero(done)
        u[owner[held]] += far - least[held]
        v[held] -= far - least[held]
        while at >= 0:
            before = int(came[at])
            owner[at] = owner[before] if before >= 0 else row
            at = before
    return owner[c] == r


def _solved(edges: DataFrame, cardinality: bool) -> DataFrame:
    """Edges of components that fit into a task, those chosen of each."""

    def chosen(rows):
        rows = rows.sort_values(["a", "b"])
        return rows[solve(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["weight"].to_numpy(), cardinality)]

    return edges.groupBy("component").applyInPandas(chosen, edges.schema)


def auction(edges: DataFrame, epsilon: float, rounds: int = 100_000) -> DataFrame:
    """Edges (a, b, weight) of a matching whose weight is at most epsilon a node of a below the most there is.

    In a round every node of a without a place offers for its best one as much as it is better than its second best, or than none, and
    epsilon; a place goes to the highest offer, and the node that had it is free again.  Prices only rise, so a
    node that no place is worth to is out for good.  A round is a join of the free nodes' edges with the prices and two
    aggregates; prices and places, a row each, are settled each round.
    """
    edges = settle(edges.select("a", "b", "weight"))
    held = settle(edges.select("b").distinct().select("b", F.lit(0.0).alias("price"), F.lit(None).cast(edges.schema["a"].dataType).alias("a"), F.lit(0.0).alias("weight")))
    out = None
    for _ in range(rounds):
        free = edges.join(held.select("a").dropna(), "a", "left_anti")
        if out is not None:
            free = free.join(out, "a", "left_anti")
        worth = free.join(held.select("b", "price"), "b").withColumn("gain", F.col("weight") - F.col("price"))
        two = worth.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("gain"), "b"))).where("k <= 2")
        best = two.groupBy("a").agg(F.max(F.when(F.col("k") == 1, F.struct("gain", "b", "price", "weight"))).alias("x"), F.greatest(F.max(F.when(F.col("k") == 2, F.col("gain"))), F.lit(0.0)).alias("second"))
        best = settle(best.select("a", "x.*", "second"))
        if best.isEmpty():
            break
        done = best.where("gain <= 0").select("a")
        out = settle(done if out is None else out.union(done))
        offers = best.where("gain > 0").groupBy("b").agg(F.max(F.struct((F.col("price") + F.col("gain") - F.col("second") + epsilon).alias("price"), "a", "weight")).alias("o"))
        held = settle(held.join(offers, "b", "left").select("b", *(F.coalesce(F.col(f"o.{c}"), F.col(c)).alias(c) for c in ("price", "a", "weight"))))
    else:
        raise RuntimeError(f"the auction has not ended after {rounds} rounds")
    return held.where("a is not null").select("a", "b", "weight")


def augment(edges: DataFrame, cardinality: bool = True) -> DataFrame:
    """Edges (a, b, weight) of a matching as solve() finds it, for edges that no task could hold.

    All nodes of a without a place look for shortest ways at once, over edges that cost what they are below the worth of their a and the price of their b: to a free
    place, or to a node of a that is better left alone.  Ways of different starts have no node in common, so all are taken
    that are no longer than the first second way of one start; worths and prices are then moved by that length, which keeps
    every edge covered and every free place without a price.  A round is joins and aggregates; nothing is collected but that
    length.  Each round places or leaves at least one node, so there are at most as many as there are nodes of a.
    """
    bonus = 1.0 + edges.select("a").distinct().count() * edges.agg(F.max("weight")).first()[0] if cardinality else 0.0
    edges = settle(edges.select("a", "b", "weight"))
    kind = edges.schema["b"].dataType
    rows = settle(edges.groupBy("a").agg((F.max("weight") + bonus).alias("worth")).withColumn("b", F.lit(None).cast(kind)))
    prices = settle(edges.select("b").distinct().withColumn("price", F.lit(0.0)))
    # Never below nothing, so that rounding makes no way shorter by a further step.
    cost = F.greatest(F.lit(0.0), F.col("worth") + F.col("price") - (F.col("weight") + bonus))
    while not rows.where("b is null").isEmpty():
        held = rows.where("b is not null")
        ahead, ways = rows.where("b is null").select("a", "worth", F.lit(0.0).alias("d")), None
        while ways is None or not ahead.isEmpty():
            near = ahead.join(edges, "a").join(prices, "b").groupBy("b").agg(F.min(F.struct((F.col("d") + cost).alias("d"), F.col("a").alias("via"))).alias("near"))
            if ways is None:
                ways = settle(near.select("b", F.col("near").alias("way"), F.lit(True).alias("new")))
            else:
                new = F.col("near").isNotNull() & (F.col("way").isNull() | (F.col("near.d") < F.col("way.d")))
                ways = settle(ways.drop("new").join(near, "b", "full").select("b", F.when(new, F.col("near")).otherwise(F.col("way")).alias("way"), new.alias("new")))
            ahead = ways.where("new").join(held, "b").select("a", "worth", "way.d")
        # Nodes of a that are reached, how far they are, and the node of a before them; that of a start is itself.
        there = settle(rows.join(ways.drop("new"), "b", "left").where("b is null or way is not null").select("a", "b", "worth", F.coalesce("way.d", F.lit(0.0)).alias("d"), F.coalesce("way.via", "a").alias("via")))
        starts = there.select("a", F.col("via").alias("start"))
        while True:
            further = settle(starts.join(starts.select(F.col("a").alias("start"), F.col("start").alias("next")), "start").select("a", "start", "next"))
            starts = further.select("a", F.col("next").alias("start"))
            if further.where("next <> start").isEmpty():
                break
        ends = there.select("a", F.lit(None).cast(kind).alias("to"), (F.col("d") + F.col("worth")).alias("d")).union(ways.join(held, "b", "left_anti").select("way.via", F.col("b").alias("to"), "way.d"))
        ranked = settle(ends.join(starts, "a").withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("d", "a", "to"))).where("k <= 2"))
        length = ranked.agg(F.coalesce(F.min(F.when(F.col("k") == 2, F.col("d"))), F.max("d"))).first()[0]
        # Along a way every node of a takes the next place and gives its own to the node before.
        at = settle(ranked.where((F.col("k") == 1) & (F.col("d") <= length)).select("a", "to"))
        taken = at
        while not (at := settle(at.join(there, "a").where("b is not null").select(F.col("via").alias("a"), F.col("b").alias("to")))).isEmpty():
            taken = taken.union(at)
        moved = lambda d: F.coalesce(F.greatest(F.lit(0.0), length - F.col(d)), F.lit(0.0))
        taken = taken.withColumn("taken", F.lit(True))
        after = rows.join(there.select("a", "d"), "a", "left").join(taken, "a", "left").where("taken is null or to is not null")
        rows = settle(after.select("a", (F.col("worth") - moved("d")).alias("worth"), F.coalesce("to", "b").alias("b")))
        prices = settle(prices.join(ways, "b", "left").select("b", (F.col("price") + moved("way.d")).alias("price")))
    return rows.join(edges, ["a", "b"]).select("a", "b", "weight")


def max_weight_matching(edges: DataFrame, cardinality: bool = True, cells: int = CELLS, epsilon: float = 0.0) -> DataFrame:
    """The edges (a, b, weight) of a matching of most edges and, of those, of most weight.

    edges: a, b and weight; those that lack one, or whose weight is not above 0, are none; of repeated ones the heaviest
    counts.  Nodes are of any type with an order; a node of a and one of b are different even if they look the same.
    cardinality off: of most weight, however many edges that has.

    Every component is solved exactly: in a task if it has at most `cells` edges after each node has dropped those that it
    cannot need, and takes at most STEPS; by augment() otherwise.  Sums are of doubles, and of matchings that are equally good any may be given.  With an `epsilon` above 0 larger ones are auctioned instead: their
    weight is at most `epsilon` a node below the most there is, and there `cardinality` counts an edge as
    twice the heaviest one, so no exchange of up to two edges for one more is missed.  An empty table gives no rows.
    """
    kinds = [edges.schema[c].dataType for c in ("a", "b")]
    weight = F.col("weight").cast("double")
    one = settle(edges.where((weight > 0) & ~F.isnan(weight)).dropna(subset=["a", "b"]).groupBy("a", "b").agg(F.max(weight).alias("weight")))
    # No node needs more edges than its side has nodes, wherever they are: a first cut, before components are known.
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("weight"), "a", "b"))
    n_a, n_b = one.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    one = settle(one.withColumns({"k_a": rank("a"), "k_b": rank("b")}).where((F.col("k_a") <= n_a) & (F.col("k_b") <= n_b)).drop("k_a", "k_b"))
    node = lambda side, c: F.struct(F.lit(side).alias("side"), *(F.when(F.lit(side == s), F.col(c) if side == s else F.lit(None)).cast(k).alias(s) for s, k in zip("ab", kinds, strict=True)))
    parts = connected(one.select(node("a", "a").alias("x"), node("b", "b").alias("y")), "x", "y")
    of_a = parts.where("node.side = 'a'").select(F.col("node.a").alias("a"), "component")
    sizes = parts.groupBy("component").agg(F.count_if(F.col("node.side") == "a").alias("n_a"), F.count_if(F.col("node.side") == "b").alias("n_b"))
    placed = settle(one.join(of_a, "a").join(sizes, "component"))
    # The best edges of each node, as many as its side has nodes in the component.
    kept = placed.withColumns({"k_a": rank("a"), "k_b": rank("b")}).where("k_a <= n_a and k_b <= n_b").drop("n_a", "n_b", "k_a", "k_b")
    sides = kept.groupBy("component").agg(F.count("*").alias("edges"), F.count_distinct("a").alias("s_a"), F.count_distinct("b").alias("s_b"))
    steps = F.pow(F.least("s_a", "s_b").cast("double"), F.lit(2)) * (F.col("s_a") + F.col("s_b"))
    sides = settle(sides.select("component", ((F.col("edges") <= cells) & (steps <= STEPS)).alias("small")))
    kept = settle(kept.join(sides, "component"))
    out = _solved(kept.where("small").select("component", "a", "b", "weight"), cardinality).drop("component")
    large = kept.where("not small")
    if large.isEmpty():
        return out
    if epsilon <= 0:
        return out.unionByName(augment(large, cardinality))
    bonus = 2 * large.agg(F.max("weight")).first()[0] if cardinality else 0.0
    sold = auction(large.select("a", "b", (F.col("weight") + bonus).alias("weight")), epsilon)
    return out.unionByName(sold.select("a", "b", (F.col("weight") - bonus).alias("weight")))

"""Link graphs: neighbours, two-hop links, triangles, single linkage and maximal cliques."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import stored

#: Partitions over which neighbourhoods are dealt.
GROUPS = 96


def top_links(ends: DataFrame, k: int) -> DataFrame:
    """ends: (chain, other, score). (a, b), a < b: pairs of which one is among the other's k best."""
    w = Window.partitionBy("chain").orderBy(F.desc("score"), "other")
    top = ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select(F.least("chain", "other").alias("a"), F.greatest("chain", "other").alias("b")).distinct()


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(links: DataFrame) -> DataFrame:
    """(node, degree, neighbours in order)."""
    return both_ways(links).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.array_sort(F.collect_list("b")), ",").alias("neighbours"))


def two_hop(links: DataFrame) -> DataFrame:
    """Links, direct or through a third node, each once."""
    d = both_ways(links)
    far = d.select(F.col("a").alias("x"), F.col("b").alias("m")).join(d.select(F.col("a").alias("m"), F.col("b").alias("y")), "m").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return links.select("a", "b").unionByName(far).distinct()


def triangles(links: DataFrame) -> DataFrame:
    """(node, triangles) of the nodes that are in one. Each triangle is found once, from its least node."""
    up = links.select("a", "b")
    wedge = up.alias("p").join(up.alias("q"), F.col("p.a") == F.col("q.a")).where("p.b < q.b").select(F.col("p.a").alias("x"), F.col("p.b").alias("a"), F.col("q.b").alias("b"))
    closed = wedge.join(up, ["a", "b"])
    return closed.select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def ranked(counts: DataFrame, value: str) -> DataFrame:
    """Rank by value, highest first, then by node. Ties and ranks come from counts of values, so no task sorts all rows."""
    by_value = counts.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    above = by_value.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(value, "above")
    inner = F.row_number().over(Window.partitionBy(value).orderBy("node"))
    return counts.join(above, value).select("node", value, (F.col("above") + inner).alias("rank"))


def single_linkage(nodes: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """nodes: (node). (node, root): the least node reachable over links, by passing on least labels."""
    d = stored(both_ways(links), "links")
    label = stored(nodes.select("node", F.col("node").alias("root")), "labels")
    for _ in range(most_rounds):
        met = d.join(label, d.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        after = label.join(met, label.node == met.a, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        # a label is itself a node: its own label is as good and further on
        jump = after.select(F.col("node").alias("at"), F.col("root").alias("further"))
        after = stored(after.join(jump, after.root == jump.at).select("node", F.least("root", "further").alias("root")), "labels")
        if after.exceptAll(label).isEmpty():
            return after
        label = after
    raise RuntimeError("labels did not settle")


def first_fit(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes: (node), distinct; links: (i, j), i > j. (node, root): in order, a node joins the group of the least
    earlier node that it is linked to, or else starts one, which is named by it.

    A group is a tree of pointers, which are doubled each round, so a chain of n pointers takes about log2(n) rounds."""
    up = links.groupBy("i").agg(F.min("j").alias("up"))
    at = stored(nodes.join(up, nodes.node == up.i, "left").select("node", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().alias("moved")), "pointers")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("node").alias("at"), F.col("root").alias("further"))
        at = stored(at.join(further, at.root == further.at).select("node", F.col("further").alias("root"), (F.col("further") < F.col("root")).alias("moved")), "pointers")
    return at.select("node", "root")


def _cliques(adjacent: dict[int, set[int]]):
    """Maximal cliques by pivoting; a stack instead of recursion."""
    stack = [([], set(adjacent), set())]
    while stack:
        chosen, open_, shut = stack.pop()
        if not open_ and not shut:
            yield sorted(chosen)
            continue
        pivot = max(open_ | shut, key=lambda v: len(open_ & adjacent[v]))
        for v in list(open_ - adjacent[pivot]):
            stack.append(([*chosen, v], open_ & adjacent[v], shut & adjacent[v]))
            open_ = open_ - {v}
            shut = shut | {v}


def maximal_cliques(links: DataFrame, least: int = 3) -> DataFrame:
    """(seed, size, nodes) of every maximal clique of at least so many nodes.

    A clique is found in the neighbourhood of its least node: one group for each node, holding its later neighbours
    and the links among them, so a group is as large as a neighbourhood, not as a component."""
    up = links.select("a", "b")
    inside = up.withColumnRenamed("a", "s").join(up.select(F.col("a").alias("s"), F.col("b").alias("c")), "s").where("b < c").join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    earlier = up.select(F.col("b").alias("s"), F.col("a").alias("e"))
    common = earlier.join(up.select(F.col("a").alias("s"), "b"), "s").join(up.select(F.col("a").alias("e"), "b"), ["e", "b"]).select("s", "b", F.col("e").alias("c"), F.lit(1).alias("kind"))
    rows = inside.select("s", "b", "c", F.lit(0).alias("kind")).unionByName(common).unionByName(up.select(F.col("a").alias("s"), "b", F.lit(None).cast("long").alias("c"), F.lit(2).alias("kind")))

    def find(part: pd.DataFrame) -> pd.DataFrame:
        seed = int(part["s"].iloc[0])
        adjacent: dict[int, set[int]] = {int(v): set() for v in part.loc[part["kind"] == 2, "b"]}
        for b, c in part.loc[part["kind"] == 0, ["b", "c"]].itertuples(index=False):
            adjacent[int(b)].add(int(c))
            adjacent[int(c)].add(int(b))
        shut: dict[int, set[int]] = {}
        for b, e in part.loc[part["kind"] == 1, ["b", "c"]].itertuples(index=False):
            shut.setdefault(int(e), set()).add(int(b))
        found = [[seed, *q] for q in _cliques(adjacent) if len(q) + 1 >= least and not any(set(q) <= known for known in shut.values())]
        return pd.DataFrame({"seed": [seed] * len(found), "size": [len(q) for q in found], "nodes": pd.Series([",".join(map(str, sorted(q))) for q in found], dtype=object)})

    # the rows are few bytes, by which all groups would be merged into one task
    return rows.repartition(GROUPS, "s").groupBy("s").applyInPandas(find, "seed long, size int, nodes string")


def select_cliques(cliques: DataFrame, share: float, cap: int) -> DataFrame:
    """Cliques of more than share of the greatest size, and of each size the first cap by seed and nodes."""
    most = cliques.agg(F.max("size").alias("most"))
    large = cliques.crossJoin(F.broadcast(most)).where(F.col("size") > share * F.col("most"))  # one row
    order = Window.partitionBy("size").orderBy("seed", "nodes")
    return large.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).select("seed", "size", "nodes")

"""Bridges of the network: small components by a walk each, large ones by a breadth-first forest and labels of the links outside of it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopmill.operators.graph import components, counted, settled, shared_root


#: Levels after which the links of components without a frontier are set aside.
LEVELS = 4


def forest(links: DataFrame, cluster: DataFrame) -> tuple[DataFrame, int]:
    """(node_id, parent, way_id, level) from the least node of each component, and the deepest level.

    links(way_id, u, v), cluster(node_id, cluster_id) as of components. A level is one job: neighbours of a level lie in it, before or after it, so only two levels are looked at, and only
    links of components that still have a frontier. Of several ways to a node the least (parent, way) stays.
    """
    cluster = cluster.select(F.col("node_id").alias("n"), "cluster_id")
    both = links.select("way_id", "u", "v").unionByName(links.select("way_id", F.col("v").alias("u"), F.col("u").alias("v")))
    both = settled(both.hint("merge").join(cluster, F.col("u") == F.col("n")).drop("n"), "bfs-links")
    root = f"{shared_root(links.sparkSession)}/bfs-{uuid.uuid4().hex}"
    front = settled(cluster.where("n = cluster_id").select(F.col("n").alias("node_id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("way_id"), F.lit(0).alias("level"), "cluster_id"), "bfs", f"{root}/0")
    before, levels = front, 1
    while True:
        on = front.select(F.col("node_id").alias("u")).hint("merge").join(both, "u").groupBy(F.col("v").alias("node_id")).agg(F.min(F.struct(F.col("u").alias("parent"), "way_id")).alias("p"), F.first("cluster_id").alias("cluster_id"))
        known = front.select("node_id").unionByName(before.select("node_id")).hint("merge")
        new = on.join(known, "node_id", "left_anti").select("node_id", "p.parent", "p.way_id", F.lit(levels).alias("level"), "cluster_id")
        new, n = counted(new, F.lit(True), "bfs", f"{root}/{levels}")
        if not n:
            tree = links.sparkSession.read.schema(front.schema).parquet(*(f"{root}/{k}" for k in range(levels)))
            return tree.drop("cluster_id"), levels - 1
        before, front, levels = front, new, levels + 1
        if levels % LEVELS == 0:
            both = settled(both.join(front.select("cluster_id").distinct().hint("merge"), "cluster_id", "left_semi").select(*both.columns), "bfs-links")


def below(tree: DataFrame, deepest: int) -> DataFrame:
    """tree(node_id, parent, h, n) with h joined by exclusive or, and n summed, over each node and all below it.

    By doubling: after k rounds a node holds what lies less than 2^k below it, and its ancestor 2^k above gets that in the next.
    """
    now, reach = settled(tree.select("node_id", F.col("parent").alias("up"), "h", "n"), "below"), 1
    while reach <= deepest:
        more = now.where("up is not null").groupBy(F.col("up").alias("a")).agg(F.bit_xor("h").alias("ah"), F.sum("n").alias("an"))
        higher = now.select(F.col("node_id").alias("b"), F.col("up").alias("above"))
        now = now.hint("merge").join(more, F.col("node_id") == F.col("a"), "left").hint("merge").join(higher, F.col("up") == F.col("b"), "left")
        h = F.col("h").bitwiseXOR(F.coalesce("ah", F.lit(0))).alias("h")
        now, reach = settled(now.select("node_id", F.col("above").alias("up"), h, (F.col("n") + F.coalesce("an", F.lit(0))).alias("n")), "below"), 2 * reach
    return now.select("node_id", "h", "n")


#: Links of a component up to which it is searched whole; larger ones go level by level. A group of whole components has about as many.
WHOLE = 20_000
FOUND = "way_id long, u long, v long, child long, parent long, worthwhile boolean"


def cutting() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """cut_links as an inner function, which Spark sends whole: workers need no copy of this package."""

    def cut_links(group: pd.DataFrame) -> pd.DataFrame:
        """The bridges among the distinct links (way_id, u, v) of whole components, by a depth-first walk from the least node of each."""
        nodes, at = np.unique(np.concatenate([group["u"], group["v"]]), return_inverse=True)
        way, (us, vs), names = group["way_id"].tolist(), at.reshape(2, -1).tolist(), nodes.tolist()
        out: list[list[tuple[int, int]]] = [[] for _ in names]
        for e, (x, y) in enumerate(zip(us, vs, strict=True)):
            out[x].append((y, e))
            out[y].append((x, e))
        num, low, extra, taken, rows = [-1] * len(names), [0] * len(names), [0] * len(names), 0, []
        for root in range(len(names)):
            if num[root] >= 0:
                continue
            num[root] = low[root] = taken
            taken, trail = taken + 1, [(root, -1, iter(out[root]))]
            while trail:
                x, by, left = trail[-1]
                for y, e in left:
                    if num[y] < 0:
                        num[y] = low[y] = taken
                        taken += 1
                        trail.append((y, e, iter(out[y])))
                        break
                    if e != by:
                        low[x], extra[x] = min(low[x], num[y]), extra[x] + 1
                else:
                    trail.pop()
                    if trail:
                        p = trail[-1][0]
                        low[p], extra[p] = min(low[p], low[x]), extra[p] + extra[x]
                        if low[x] > num[p]:
                            rows.append((way[by], min(names[x], names[p]), max(names[x], names[p]), names[x], names[p], extra[x] > 0))
        return pd.DataFrame(rows, columns=["way_id", "u", "v", "child", "parent", "worthwhile"]).astype({"worthwhile": "bool"})

    return cut_links


def bridges(links: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(way_id, u, v, child, parent, worthwhile) of links without which their ends are apart.

    `child` is the end away from the component's least node; worthwhile bridges have a cycle behind them, others lead to a dead end. A component of up
    to `whole` links is searched in one group with others, `whole` links or so together; larger ones by levels.
    """
    own = links.where("u <> v").select("way_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    cluster = components(own)
    own, n = counted(own.hint("merge").join(cluster, F.col("u") == F.col("node_id")).drop("node_id"), F.lit(True), "bridge-links")
    large = settled(own.groupBy("cluster_id").count().where(F.col("count") > whole).select("cluster_id"), "bridge-large")
    found = own.join(large.hint("merge"), "cluster_id", "left_anti").groupBy(F.pmod(F.xxhash64("cluster_id"), F.lit(n // max(whole, 1) + 1)).alias("g")).applyInPandas(cutting(), FOUND)
    if large.isEmpty():
        return found
    rest = settled(own.join(large.hint("merge"), "cluster_id", "left_semi"), "bridge-rest")
    return found.unionByName(bridges_by_levels(rest, rest.select(F.explode(F.array("u", "v")).alias("node_id"), "cluster_id").distinct()))


def bridges_by_levels(links: DataFrame, cluster: DataFrame) -> DataFrame:
    """As bridges() of distinct links(way_id, u, v), u < v, and cluster(node_id, cluster_id).

    Each link outside of the forest puts a hash on both ends; hashes are joined by exclusive or over each node and all below it. A forest
    link below which every hash cancels is crossed by no other link, so it is a bridge (wrong by chance about once in
    2^64). Ends counted below it say whether the far side has a cycle.
    """
    tree, deepest = forest(links, cluster)
    t = tree.where("parent is not null").select(F.col("way_id").alias("tw"), F.least("node_id", "parent").alias("tu"), F.greatest("node_id", "parent").alias("tv"))
    others = links.hint("merge").join(t, (links["way_id"] == t["tw"]) & (links["u"] == t["tu"]) & (links["v"] == t["tv"]), "left_anti")
    ends = others.select(F.explode(F.array("u", "v")).alias("node_id"), F.xxhash64("way_id", "u", "v").alias("h"))
    own = ends.groupBy("node_id").agg(F.bit_xor("h").alias("h"), F.count("*").alias("n"))
    labelled = tree.hint("merge").join(own, "node_id", "left").select(*tree.columns, F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("n", F.lit(0)).alias("n"))
    done = tree.where("parent is not null").hint("merge").join(below(labelled, deepest).where("h = 0"), "node_id")
    return done.select("way_id", F.least("node_id", "parent").alias("u"), F.greatest("node_id", "parent").alias("v"), F.col("node_id").alias("child"), "parent", (F.col("n") > 0).alias("worthwhile"))


def start_connectors(starts: DataFrame, spurs: DataFrame) -> DataFrame:
    """Distinct (request_id, way_id, u, v) of the dead-end links on the way from each start up to where they end.

    starts(request_id, node_id), spurs(way_id, u, v, child, parent). A round climbs one link for all starts.
    """
    root, rounds = f"{shared_root(starts.sparkSession)}/climb-{uuid.uuid4().hex}", 0
    at = settled(starts.select("request_id", "node_id"), "climb")
    up = settled(spurs.select("way_id", "u", "v", F.col("child").alias("node_id"), "parent"), "climb-links")
    while True:
        step, n = counted(at.hint("merge").join(up, "node_id").select("request_id", "way_id", "u", "v", "parent"), F.lit(True), "climb", f"{root}/{rounds}")
        rounds += 1
        if not n:
            every = step.sparkSession.read.schema(step.schema).parquet(*(f"{root}/{k}" for k in range(rounds)))
            return every.select("request_id", "way_id", "u", "v").distinct()
        at = step.select("request_id", F.col("parent").alias("node_id"))


def edge_sets(edges: DataFrame, spurs: DataFrame, exempt: DataFrame) -> DataFrame:
    """edges with is_spur, is_exempt and is_excluded; spurs and exempt are (way_id, u, v) and hold for both directions."""
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    flag = lambda df, name: df.select("way_id", F.least("u", "v").alias("_u"), F.greatest("u", "v").alias("_v")).distinct().withColumn(name, F.lit(True))
    e = edges.withColumns({"_u": low, "_v": high}).hint("merge").join(flag(spurs, "is_spur"), ["way_id", "_u", "_v"], "left").hint("merge").join(flag(exempt, "is_exempt"), ["way_id", "_u", "_v"], "left")
    e = e.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_spur", "is_exempt")}).drop("_u", "_v")
    return e.withColumn("is_excluded", F.col("is_spur") & ~F.col("is_exempt"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: nodes with an edge, directed edges, and those that are spurs, exempt or excluded."""
    return edges.agg(F.count_distinct("from_id").alias("nodes"), F.count("*").alias("directed"), *(F.count_if(F.col(f"is_{c}")).alias(c) for c in ("spur", "exempt", "excluded")))

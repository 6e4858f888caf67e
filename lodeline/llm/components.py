"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.tables import cut, discard

#: A node with at least one in so many of all pairs is a hub: there are at most so many of them, and they are broadcast.
HUBS = 1000
#: Links a task contracts among themselves at a time.
LOCAL_LINKS = 400_000


def _to_least(pairs: DataFrame, total: int) -> DataFrame:
    """(a, b) with, for each a, the least of a and its b as ``m``.

    The minimum is taken before the shuffle. Pairs of hubs get theirs by broadcast and stay where they
    are, so that no task receives all pairs of a hub; the others are joined.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    hubs = least.where(F.col("n") * HUBS >= total).select("a", F.col("m").alias("h"))
    near = pairs.join(F.broadcast(hubs), "a", "left")
    rest = near.where("h is null").select("a", "b").join(least.where(F.col("n") * HUBS < total).select("a", "m"), "a")
    return near.where("h is not null").select("a", "b", F.col("h").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _to_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _to_least(down, total)
    both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
    return moved.select(F.inline(both)).where("a <> b").distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each task replaced by stars that link the same nodes: what a task holds together is linked in no round after."""

    def run(frames):
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        def stars():
            rows = [(x, root(x)) for x in list(parent)]
            parent.clear()
            return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"])

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                a, b = root(a), root(b)
                if a != b:
                    low, high = min(a, b), max(a, b)
                    parent[high] = low
                    parent.setdefault(low, low)
            if len(parent) >= LOCAL_LINKS:
                yield stars()
        yield stars()

    return links.mapInPandas(run, links.schema)


def components(nodes: DataFrame, links: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node each node is linked with, over any number of links.

    ``links`` names nodes by columns ``a`` and ``b``; direction, repeats and loops don't matter. Links are
    first contracted to stars within each task, a bounded number at a time, as a sum is combined before it
    is shuffled. Each round is then one large-star and one small-star join; the number of rounds grows
    with the logarithm of the longest chain between tasks. Every round is written, the one before deleted,
    so a lost executor costs at most that round. No component is ever gathered, and a hub's pairs stay
    spread. A node without links is its own component; null nodes and links with a null end are ignored;
    empty tables give no rows.
    """
    used = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = cut(_contracted(used).distinct())
    told = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = told(edges)
    while mark[0]:
        large = cut(_large_star(edges, mark[0]), edges)
        edges = cut(_small_star(large, mark[0]), large)
        was, mark = mark, told(edges)
        if was == mark:
            break
    # At the fixed point every edge leads from a node to the least of its component.
    found = cut(
        nodes.select(F.col(node).alias("_n")).where("_n is not null").distinct()
        .join(edges, F.col("_n") == F.col("a"), "left")
        .select(F.col("_n").alias(node), F.coalesce("b", "_n").alias("component"))
    )
    discard(edges)
    return found

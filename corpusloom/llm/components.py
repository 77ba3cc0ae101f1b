"""Connected components by alternating stars (Kiveris and others, 2014), all in Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, written

#: Edges from which on nodes of very many neighbours get theirs by broadcast; fewer are no burden for one task.
MANY = 1 << 20


def components(edges: DataFrame, tag: str = "cc", rounds: int = 60, many: int = MANY) -> DataFrame:
    """From edges (a, b) over any ordered type: (node, root) with the smallest node of each component as its root,
    a row for every node that an edge touches. No edges: no rows. Loops and repeated edges do no harm.

    A round points every node's larger neighbours at its least one, then every node and its smaller neighbours at the
    least of these; the graph is a star for each component when a round changes nothing. Least neighbours come
    from partial sums of min, and from `many` edges on the join that hands them out sends those of hot nodes to all executors, so a node with very many
    neighbours needs no task of its own. Each round is written to the shared folder.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, tag)
    seen = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("v", "u"))
        least, met = _least(both, now[0] >= many, tag)
        least = least.withColumn("m", F.least("u", "m"))
        large = met(both.filter(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(met(e, least).filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).distinct()
        large = large.filter(F.col("u") != F.col("v"))
        large = written(large, tag)
        least, met = _least(large, now[0] >= many, tag)
        small = met(large, least).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), tag)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _least(pairs: DataFrame, hot: bool, tag: str) -> tuple[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]:
    """u and m, its least v; and the join on u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), *([F.count(F.lit(1)).alias("n")] if hot else []))
    if not hot:
        return least, lambda rows, table: rows.join(table, "u")
    counts = written(least, tag)
    return counts.drop("n"), lambda rows, table: joined(rows, table, "u", counts, "n")


class Forest:
    """Union-find over the places 0 to n - 1 of one task; the least place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

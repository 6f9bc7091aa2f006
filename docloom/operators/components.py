"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Each step is one grouped minimum and one join on the vertex, so a hub is pre-aggregated before the shuffle and no
neighbourhood is gathered in one task. The number of rounds grows with the logarithm of the graph, not with the length of
its chains. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """For each u: its larger neighbours are tied to the least of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """For each u: its smaller neighbours and u itself are tied to the least of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(vertex, component): component is the least vertex reachable. Vertices are those of the edges; edges with a null
    end or both ends the same are left out. Repeated edges and either direction are fine. No edges: no rows."""
    now = edges.select(F.least(a, b).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
    now = stored(now.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct())
    before = None
    for _ in range(most_rounds):
        after = stored(_small_star(_large_star(now)).distinct())
        # Every step keeps the sum of the tied ends' marks only at the fixed point.
        mark = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select("a").distinct()
    return now.select(F.col("b").alias("vertex"), F.col("a").alias("component")).union(roots.select("a", F.col("a")))

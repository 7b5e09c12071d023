"""Connected components of an edge table, by alternating star steps.

Each step keeps connectivity and points nodes at smaller ones: the large
star links a node's larger neighbours to its smallest neighbour, the small
star does the same for its smaller ones. The table shrinks to one edge per
node, towards the smallest id of its component, in a few rounds. Minima are
combined map-side and joined back, so a hub's neighbours are spread over
tasks (Spark splits the skewed side of the join). Every round is written to
the shared folder; only two sums reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.common import stored


def _star(pairs: DataFrame) -> DataFrame:
    """Directed (u, v): v's link to the least of u and u's v's. The minima
    are stored, so the join deals both sides anew and Spark may split a hub."""
    least = stored(pairs.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("m_u"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of comparable ids -> (node, component): the least id that
    each node reaches. Nodes without an edge to another have no row."""
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    table = stored(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = table.union(table.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = _star(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            large.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        table = stored(small, "stars")
        now = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                table.select("v", "v").distinct())
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

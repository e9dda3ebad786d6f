"""Connected components over an edge table, by alternating large-star and small-star rounds.

Only DataFrame operations are used, nothing is collected but two numbers a round, and each round's edges are written to
the shared folder. Per-node minima are partial aggregates, so a node with very many neighbours is combined map-side; the
joins that bring minima back are plain equi-joins, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import materialise


def _round(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("n")).select("u", "v", "m")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node with an edge to another; ``component`` is the least node reachable.

    Nodes are of any orderable type. Edges holding a null and self-loops are left out, so their nodes come back only if
    another edge names them. An empty edge table gives an empty result.
    """
    now = materialise(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # The checksum is that of a set: both star rounds end in distinct().
        now = materialise(_round(_round(now, True), False), "edges")
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if tuple(mark) == seen or mark["n"] == 0:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

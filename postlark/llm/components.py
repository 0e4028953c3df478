"""Connected components of links between 64-bit nodes, by alternating stars.

Each round hangs every node's larger neighbours (large star) and then its smaller ones (small star) on the least node
among them, until nothing moves; the number of rounds grows with the logarithm of the longest path. Rounds are joins and
combined minimums over written tables; no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.operators.spread import cut


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` with v the least node reachable from u, for every linked node that isn't the least itself."""
    u, v = F.col("u"), F.col("v")
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(u > v).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where(u > v).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges

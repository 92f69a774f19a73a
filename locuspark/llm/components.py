"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Map every vertex of ``edges`` to the smallest vertex that it reaches.

    Returns ``node``, ``root`` with one row per vertex that has an edge to a
    different vertex.  Self loops, repeated edges and edges with a null end
    are ignored; an empty table gives an empty result.

    Large-star and small-star rounds (Kiveris et al., 2014) only aggregate a
    minimum per vertex, which combines before the shuffle, and join it back,
    which AQE can split for a hub; no neighbourhood is ever gathered.
    """
    a, b = F.col(src), F.col(dst)
    current = materialise(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "cc-edges",
    )
    for _ in range(max_rounds):
        before = _shape(current)
        # Large star: every larger neighbour of a vertex moves to the smallest of its neighbourhood.
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct()
        # Small star: every smaller neighbour of a vertex moves to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))
        )
        current = materialise(small.where("u != v").distinct(), "cc-edges")
        if _shape(current) == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _shape(edges: DataFrame) -> tuple:
    """Edges, and order-free checksums: equal before and after a round only at the fixed point of stars."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_xor(xxhash64(u, v))").alias("x"),
        F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))").alias("s"),
    ).first()
    return tuple(row)

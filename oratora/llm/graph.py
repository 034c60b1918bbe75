"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ways into which the links of one node are dealt in the large-star join.
SALTS = 16


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``; the root is the smallest node reachable.

    The links hold longs.  Rounds are logarithmic in the longest chain; each
    ends in a checkpoint, so lineage stays short and lost executors cost one
    round.  A node with very many links (the centre of a star) is dealt over
    ``SALTS`` tasks.  Loops and repeated links are allowed, null links are
    ignored, no links give no rows.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = _signature(edges)
    salts = F.explode(F.array([F.lit(i) for i in range(SALTS)]))
    while before[0]:
        # large star: what hangs on v moves to the smallest neighbour of v
        lowest = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m", salts.alias("salt"))
        far = (
            edges.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
            .join(lowest, ["v", "salt"], "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .distinct()
        )
        # small star: u and its smaller neighbours all point to the smallest of them
        low = F.min("v").over(Window.partitionBy("u"))
        near = (
            far.select("u", "v", low.alias("m"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        edges = cut(near)
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenstep.sources.storage import settle


def _mins(sides: DataFrame) -> DataFrame:
    """Links ``(u, v)`` in both directions with the smallest node at or beside ``u``."""
    least = sides.groupBy(F.col("u").alias("of")).agg(F.least(F.col("of"), F.min("v")).alias("m"))
    return sides.join(least, F.col("u") == F.col("of")).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``links`` (two columns of longs): ``root`` is the smallest node reachable.

    Stars grow by turns: each node hangs its larger neighbours, then its smaller ones, on the smallest that it
    knows, until nothing moves (a number of rounds about the logarithm of the longest path). Each round is
    written to shared storage. Links of a node to itself and repeated links do no harm; a link with a null end
    is left out.
    """
    a, b = links.columns
    # Stored: what made the links may be dear, and they are read more than once.
    links = settle(links.select(F.col(f"`{a}`").cast("long").alias("u"), F.col(f"`{b}`").cast("long").alias("v")).where("u is not null and v is not null"))
    alone = links.where("u = v").select("u", "v")
    pairs = settle(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Here every link goes from a node to a smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).unionByName(alone.select(F.col("u").alias("id"), F.col("u").alias("root")))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots).groupBy("id").agg(F.min("root").alias("root"))

"""Connected components of links, and blocks for comparing the rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links`` (``a long, b long``); the smallest node names it.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the
    smallest node next to it.  Each round is written to the scratch folder and compared by count
    and digest, so two numbers reach the driver.  Null ends and self-links are left out.
    """
    u, v = F.col("u"), F.col("v")

    def down(a, b) -> list:
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]

    known = links.filter("a <> b").select(*down(F.col("a"), F.col("b"))).distinct()
    current, before = written(known, "links"), None
    while True:
        both = current.select("u", "v").unionByName(current.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(v.alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(*down(v, F.col("m")))
        current = written(small.union(low.select("u", "m")).distinct(), "links")
        digest = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if digest == before:
            break
        before = digest
    roots = current.select(v.alias("u"), "v").distinct()
    return current.select("u", "v").union(roots).toDF("node", "component")


def block_pairs(df: DataFrame, key: list[str], id_column: str, block_rows: int) -> DataFrame:
    """Rows dealt out so that every two rows of one ``key`` meet, in groups of bounded size.

    Adds ``block_a``, ``block_b``, ``own_block``.  A key with at most ``block_rows`` rows is one
    group, one with a single row is left out.  A larger key is cut by hash into ``n`` blocks and
    each row goes to the ``n`` pairs of blocks that hold its own.  Two rows meet in the group of
    their two blocks; rows of one block meet in the group where ``block_a = block_b``.
    """
    count = df.groupBy(*key).agg(F.count("*").alias("key_rows")).filter("key_rows > 1")
    n = F.ceil(F.col("key_rows") / block_rows).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_column)), n).cast("int")
    dealt = df.join(count, key).withColumn("own_block", own)
    dealt = dealt.withColumn("other_block", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(
        *df.columns,
        "own_block",
        F.least("own_block", "other_block").alias("block_a"),
        F.greatest("own_block", "other_block").alias("block_b"),
    )

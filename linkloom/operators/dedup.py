"""Duplicate removal: exact first occurrence, against a seen set, and by a Bloom-style bit map."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.hashing import BIT_MAP_SIZE, bit_positions


_POSITIONS = 1 << 31
#: What a bit map is made for unless told otherwise.
EXPECTED_URLS, FALSE_POSITIVES = 100_000_000, 0.01


def dedup_links(links: DataFrame) -> DataFrame:
    """First occurrence of each exact URL by ``(src_id, pos)``: ``url, src_id, pos``.

    ``src_id`` and ``pos`` travel as one decimal that orders like the pair.  Unlike a struct it
    is a fixed-width buffer, so this is a hash aggregation, and a URL that most pages carry is
    down to one row per map task before the shuffle.
    """
    width = F.lit(_POSITIONS).cast("decimal(11,0)")
    place = (F.col("src_id").cast("decimal(20,0)") * width + F.col("pos")).cast("decimal(38,0)")
    first = links.select("url", place.alias("_place")).groupBy("url").agg(F.min("_place").alias("_place"))
    pos = F.pmod(F.col("_place"), width)
    return first.select(
        "url",
        ((F.col("_place") - pos) / width).cast("long").alias("src_id"),
        pos.cast("int").alias("pos"),
    )


def drop_seen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links whose ``url`` is not in ``seen``; both sides should be distinct on ``url``."""
    return links.join(seen.select("url"), "url", "left_anti")


def extend_frontier(frontier: DataFrame, fresh: DataFrame) -> DataFrame:
    """Frontier with the new entries added."""
    return frontier.unionByName(fresh)


def power_of_two_mask(num_bits: int) -> int:
    if num_bits < 1 or num_bits & (num_bits - 1):
        raise ValueError("num_bits must be a power of two; pass mask= for any other bit mask")
    return num_bits - 1


def bloom_bits(expected: int, fpp: float) -> int:
    """Places of a bit map, a power of two, for ``expected`` URLs at ``fpp`` false positives."""
    least = -expected * math.log(fpp) / math.log(2) ** 2
    return 1 << max(0, math.ceil(math.log2(max(1.0, least))))


def bloom_mask(num_bits: int | None, mask: int | None, expected: int, fpp: float) -> int:
    """The bit mask that these arguments stand for."""
    return power_of_two_mask(num_bits or bloom_bits(expected, fpp)) if mask is None else mask


def bloom_first(
    df: DataFrame, url: str, seq: str, num_bits: int | None = None, mask: int | None = None,
    expected: int = EXPECTED_URLS, fpp: float = FALSE_POSITIVES,
) -> DataFrame:
    """``seq`` of the rows that a set-then-test bit map, filled in ``seq`` order, finds new.

    A row is new exactly if it is the first to set at least one of its bits, so the answer is
    the distinct ``min(seq)`` per bit: no row is ever grouped with the others of its bit.
    Map-side aggregation leaves at most one row per bit and task to shuffle.  The map has
    ``num_bits`` places, or as many as ``expected`` URLs need for ``fpp`` false positives; it is
    never held in memory.  ``mask=BIT_MASK`` gives the fixed bit map of 100,000,000 places.
    """
    mask = bloom_mask(num_bits, mask, expected, fpp)
    bits = df.select(
        F.col(seq), F.explode(bit_positions(F.col(url), mask)).alias("_bit")
    )
    return bits.groupBy("_bit").agg(F.min(seq).alias(seq)).select(seq).distinct()


def bloom_fill(
    df: DataFrame, url: str = "url", num_bits: int | None = None, mask: int | None = None,
    expected: int = EXPECTED_URLS, fpp: float = FALSE_POSITIVES,
) -> DataFrame:
    """``bits_set`` and ``fill``, the share of the map's places, once all of ``df`` is in it.

    At a fill of a half about one new URL in a hundred is taken for a known one; beyond that the
    map is too small.
    """
    mask = bloom_mask(num_bits, mask, expected, fpp)
    bits = df.select(F.explode(bit_positions(F.col(url), mask)).alias("_bit")).distinct()
    places = 1 << bin(mask).count("1")  # a mask with gaps reaches fewer
    count = bits.agg(F.count(F.lit(1)).alias("bits_set"))
    return count.withColumn("fill", F.col("bits_set") / places)


def bloom_dedup(
    df: DataFrame, url: str = "url", seq: str = "seq", num_bits: int | None = None, mask: int | None = None,
    expected: int = EXPECTED_URLS, fpp: float = FALSE_POSITIVES,
) -> DataFrame:
    """``df`` with ``is_duplicate``: all bits of the row were set by rows with smaller ``seq``.

    ``seq`` is unique.  A repeated URL is always flagged; a new one may be, by collision: see
    :func:`bloom_first` for the size of the map and :func:`bloom_fill` for how full it gets.
    ``df`` is read twice, so hand over a written table rather than a costly plan.
    """
    new = bloom_first(df, url, seq, num_bits, mask, expected, fpp).withColumn("_new", F.lit(True))
    return (
        df.join(new, seq, "left")
        .withColumn("is_duplicate", F.col("_new").isNull())
        .drop("_new")
    )


BIT_MASK = BIT_MAP_SIZE - 1

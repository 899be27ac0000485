"""Packing documents into sequences: best fit under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import whole_groups
from linkloom.llm.mixing import token_count
from linkloom.scratch import written

CAPACITY = 2048
#: Pieces that one shard packs on its own; shards are many as the data needs.
SHARD_PIECES = 4096


class _Bins:
    """Open bins in the order of what they have left, each with bitmaps of what it holds."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.masks = capacity, [], []

    def put(self, size: int, mask: int) -> int:
        """The tightest bin with room for ``size`` and nothing in common with ``mask``, or a new one."""
        order, masks = self.order, self.masks
        at = bisect_left(order, (size, -1))
        while at < len(order) and masks[order[at][1]] & mask:  # on to the successor
            at += 1
        if at < len(order):
            left, bin_no = order.pop(at)
            masks[bin_no] |= mask
        else:
            left, bin_no = self.capacity, len(masks)
            masks.append(mask)
        if left > size:
            insort(order, (left - size, bin_no))
        return bin_no


def _bits(values: list, only_shared: bool) -> list[int]:
    """A bitmap with one bit for each value; values that occur once need none if ``only_shared``."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    shared = [v for v, n in count.items() if v is not None and (n > 1 or not only_shared)]
    bit = {v: 1 << i for i, v in enumerate(shared)}
    return [bit.get(v, 0) for v in values]


def copies(text: Column) -> Column:
    """A cluster for each text, by hash of the whole of it; null where there is nothing to copy."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def pack(
    docs: DataFrame, cluster: Column | str, capacity: int = CAPACITY, tokens: Column | None = None, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """``doc_id, source, cluster, piece, begin, tokens, shard, bin`` for every piece of ``docs``.

    A document of more than ``capacity`` tokens is cut into full pieces and a rest; ``begin`` is
    the piece's first token.  Each shard, a hash range of documents, is packed by itself: pieces
    from the largest down, each into the bin with the least room left that can take it.  No bin
    holds two pieces of the same ``source`` or the same ``cluster`` (duplicates); the search goes
    on through the bins in order of room left until one is compatible, and only then opens one.
    Full pieces fill a bin alone.

    Null sources and clusters conflict with nothing.  Documents without tokens have one piece of
    none.  Repeated rows are packed each on their own.  Null ids are kept.  Other columns are not
    read.  The number of shards follows the number of pieces, so a task holds a bounded number.
    """
    size = token_count(F.col("text")) if tokens is None else tokens
    group = F.col(cluster) if isinstance(cluster, str) else cluster
    rows = docs.select("doc_id", F.col("source").cast("string"), group.cast("long").alias("cluster"), size.cast("long").alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("piece") * capacity
    pieces = pieces.select(
        "doc_id", "source", "cluster", F.col("piece").cast("int"), begin.alias("begin"),
        F.least(F.lit(capacity), F.col("size") - begin).cast("int").alias("tokens"),
    )
    pieces = written(pieces, "pieces")
    shards = pieces.count() // shard_pieces + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "source", "cluster"), F.lit(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            shard = table.column("shard").to_numpy()
            ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
            begin = 0
            for end in ends:
                part = table.slice(begin, end - begin)
                begin = end
                source = _bits(part.column("source").to_pylist(), only_shared=False)
                width = max(source).bit_length()
                copies = _bits(part.column("cluster").to_pylist(), only_shared=True)
                bins = _Bins(capacity)
                sizes = part.column("tokens").to_pylist()
                where = pa.array([bins.put(n, s | c << width) for n, s, c in zip(sizes, source, copies)], pa.int32())
                yield from part.append_column("bin", where).combine_chunks().to_batches()

    order = ["shard", F.desc("tokens"), "doc_id", "piece", "source", "cluster"]
    packed = dealt.repartition("shard").sortWithinPartitions(*order)
    return packed.mapInArrow(
        run, "doc_id long, source string, cluster long, piece int, begin long, tokens int, shard long, bin int"
    )

"""SimHash near-duplicates: pivot distance tables decide which fingerprints are compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import mixed, spanning, whole_groups
from linkloom.llm.graph import block_pairs, components
from linkloom.scratch import written

#: Widths in bits of the parts of a fingerprint.  Three differing bits touch at most three of the
#: five parts, so two linked fingerprints agree in two parts at least.
PARTS = (13, 13, 13, 13, 12)
MOST_BITS = 3
#: Reference fingerprints of the distance table.
PIVOTS = 24
#: Distinct fingerprints of a group that one task compares.
BLOCK_ROWS = 4096

_HASH_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and parted at the six ASCII blanks only
    if not words:
        return 0
    width = min(3, len(words))
    line = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    begins = [0] + [e + 1 for e in ends]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[b:e], 42) for b, e in zip(begins, ends[width - 1 :])]
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _HASH_BITS
    bits = counts.ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp long`` for each row of ``docs``.

    Each text is lower-cased in A-Z and cut at ASCII blanks; the 64 bits are majorities over the
    XXH64 (seed 42) of its three-word sequences, repeats included.  Shorter texts are one
    sequence.  Null, empty and blank texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((_fingerprint((t.as_py() or "").encode()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _pivots() -> np.ndarray:
    return mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64))


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = _pivots()
    for table in whole_groups(batches, ["part", "bits", "block_a", "block_b"]):
        group = np.zeros(table.num_rows, bool)
        for name in ("part", "bits", "block_a", "block_b"):
            values = table.column(name).to_numpy()
            group[1:] |= values[1:] != values[:-1]
        group = np.cumsum(group)
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("own_block").to_numpy()
        apart = table.column("block_a").to_numpy() != table.column("block_b").to_numpy()
        # The distance table: one row for each fingerprint, one column for each pivot.
        distance = np.bitwise_count(fp[:, None] ^ pivots).astype(np.int8)
        order = np.lexsort((distance[:, 0], group))
        group, fp, own, apart, distance = group[order], fp[order], own[order], apart[order], distance[order]
        left, right = [], []
        at, step = np.arange(len(fp)), 1
        while len(at):
            at = at[at + step < len(fp)]
            near = group[at] == group[at + step]
            near &= distance[at + step, 0] - distance[at, 0] <= MOST_BITS
            at = at[near]  # sorted by the first pivot: once too far, all later ones are
            keep = at[~apart[at] | (own[at] != own[at + step])]
            for pivot in range(1, PIVOTS):
                keep = keep[np.abs(distance[keep, pivot] - distance[keep + step, pivot]) <= MOST_BITS]
            keep = keep[np.bitwise_count(fp[keep] ^ fp[keep + step]) <= MOST_BITS]
            left.append(keep)
            right.append(keep + step)
            step += 1
        if left and sum(map(len, left)):
            doc = table.column("doc_id").to_numpy()[order]
            a, b = doc[np.concatenate(left)], doc[np.concatenate(right)]
            enough = spanning(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[enough]), pa.array(b[enough])], ["a", "b"])


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that span the rows of ``nodes`` (``doc_id, fp``, no print twice) at three differing bits or fewer.

    Nodes that agree in two of five parts meet; of these, only pairs whose distances to every pivot
    differ by at most three are compared.
    """
    parts, low = [], 0
    for width in PARTS:
        parts.append(F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1))
        low += width
    keys = [
        F.struct(F.lit(i).alias("part"), F.shiftleft(parts[a], 32).bitwiseOR(parts[b]).alias("bits"))
        for i, (a, b) in enumerate(combinations(range(len(PARTS)), 2))
    ]
    keyed = nodes.select("doc_id", "fp", F.inline(F.array(*keys)))
    dealt = block_pairs(keyed, ["part", "bits"], "fp", BLOCK_ROWS)
    group = ["part", "bits", "block_a", "block_b"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_close_pairs, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (``doc_id``, ``text``).

    Fingerprints that differ in at most three bits link; ``component_id`` is the smallest id that
    can be reached.  Equal fingerprints are one node, so copies make no pairs.  Nodes that agree in
    two of five parts meet; of these, only pairs whose distances to every pivot differ by at most
    three are compared.  Rows without an id get their fingerprint and a null component, and link
    nothing.  Rows that repeat an id stay; the id belongs to all their components.  Other columns
    are not read.  An empty table gives an empty result.
    """
    prints = written(fingerprints(docs), "fingerprints")
    nodes = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    nodes = written(nodes, "nodes")
    links = close_fingerprints(nodes)
    # A repeated id ties its rows together, whatever their texts.
    same = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
    same = same.filter("x <> y").select("doc_id")
    tied = prints.join(same, "doc_id").join(nodes.withColumnRenamed("doc_id", "b"), "fp").select(F.col("doc_id").alias("a"), "b")
    found = components(links.unionByName(tied))
    by_print = nodes.join(found, nodes.doc_id == found.node, "left").select(
        "fp", F.coalesce("component", "doc_id").alias("component_id")
    )
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(by_print, "fp", "left").select("doc_id", shown, component)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_duplicates`: the smallest id.

    All columns stay.  Rows without an id are in no group and stay, also those with equal texts;
    rows that repeat the smallest id stay together.
    """
    groups = near_duplicates(docs)
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)

"""Filter interaction audit: truth tables of which filters, in which order, remove which documents.

Filters are independent yes/no conditions, so what a document does under any order of them follows
from the set of those it fails.  Each document becomes a truth-table word: bit ``S`` is set if it
survives the set ``S`` of filters.  Counting set bits over the words of a part and label
(a positional population count by carry-save adders) gives the survivors of all subsets at once,
and every figure of every order is a difference of these counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import written

#: Filters of one audit: a word of 32 bits holds all subsets of five.
MOST_FILTERS = 5
#: Groups of words that a task holds before it passes their counts on.
HELD_GROUPS = 1 << 12
_WORD = r"[^\x20\x09-\x0D]+"
_CLASSES = 4


def text_failures(text: Column) -> dict[str, Column]:
    """Four conditions of whole texts under which a document fails; null is empty.

    A: under 50 words.  B: 100 times the distinct words is under 65 times the words.  C: 100 times
    the letters A-Z is over five times the code points.  D: holds one of ``#$%&*|``.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0))
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.length(whole).cast("long") * 5,
        "D": whole.rlike("[#$%&*|]"),
    }


def _words(filters: int) -> np.ndarray:
    """The truth-table word of each set of failed filters: bit ``S`` is set if ``S`` holds none of them."""
    sets = np.arange(1 << filters)
    return ((sets[:, None] & sets) == 0) @ (np.uint64(1) << sets.astype(np.uint64))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (32 bits each) have each bit set.

    Carry-save adders work on whole words: of three words of one weight the majority bits carry to
    the next weight and the parities stay, so each round leaves a third fewer words, 32 counters
    at a time, until one word of each weight is left.
    """
    level = [words.astype(np.uint32)]
    counts, weight = np.zeros(32, np.int64), 1
    while level:
        held, carries = np.concatenate(level), []
        while len(held) > 2:
            third = len(held) // 3
            a, b, c, rest = held[:third], held[third : 2 * third], held[2 * third : 3 * third], held[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            held = np.concatenate((half ^ c, rest))
        if len(held) == 2:
            carries.append(held[:1] & held[1:])
            held = held[:1] ^ held[1:]
        for word in held:
            counts += ((int(word) >> np.arange(32)) & 1) * weight
        level, weight = carries, weight * 2
    return counts


def _survivors(filters: int):
    table = _words(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            names = part.dictionary.to_pylist()
            label = batch.column(1).to_numpy()
            word = table[batch.column(2).to_numpy()].astype(np.uint32)
            group = part.indices.to_numpy().astype(np.int64) * _CLASSES + label
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            for own in np.split(order, bounds[1:]) if len(order) else []:
                key = names[group[own[0]] // _CLASSES], int(group[own[0]] % _CLASSES)
                held[key] = held.get(key, 0) + positional_counts(word[own])
            if len(held) > HELD_GROUPS:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    return run


def _rows(held: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
    size = 32
    parts = [key[0] for key in held for _ in range(size)]
    labels = np.repeat(np.array([key[1] for key in held], np.int32), size)
    subsets = np.tile(np.arange(size, dtype=np.int32), len(held))
    columns = [pa.array(parts, pa.string()), pa.array(labels), pa.array(subsets), pa.array(np.concatenate(list(held.values())))]
    return pa.RecordBatch.from_arrays(columns, ["part", "label", "subset", "survivors"])


@lru_cache
def _orders(names: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each step of each order: the order's name, the step, its filter, and the set before it."""
    shown, steps, filters, before = [], [], [], []
    for order in permutations(range(len(names))):
        held = 0
        for step, own in enumerate(order, 1):
            shown.append("".join(names[i] for i in order))
            steps.append(step)
            filters.append(own)
            before.append(held)
            held |= 1 << own
    return shown, np.array(steps), np.array(filters), np.array(before)


def _figures(names: tuple[str, ...], classes: Mapping[str, tuple[int, ...]]):
    """From the survivors of each part (a row of ``_CLASSES`` times 32 counts) all steps of all orders."""
    full = (1 << len(names)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown, steps, own, before = _orders(names)
        bit = 1 << own
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_label = np.array(counts, np.int64).reshape(_CLASSES, 32)
                left = by_label.sum(axis=0)
                removed = left[before] - left[before | bit]
                value = np.zeros(len(names), np.int64)
                for i in range(len(names)):
                    for held in range(full + 1):
                        if not held >> i & 1:
                            size = held.bit_count()
                            ways = factorial(size) * factorial(len(names) - 1 - size)
                            value[i] += ways * (left[held] - left[held | 1 << i])
                columns = {
                    "part": pa.array([part] * len(steps), pa.string()), "filter_order": pa.array(shown, pa.string()),
                    "step": pa.array(steps.astype(np.int32)), "kept": pa.array(left[before | bit]), "removed": pa.array(removed),
                    "redundant": pa.array(left[0] - left[bit] - removed),
                    "unique_fails": pa.array(left[full & ~bit] - left[full]),
                }
                for name, these in classes.items():
                    lost = by_label[list(these)].sum(axis=0)
                    columns[name] = pa.array(lost[before] - lost[before | bit])
                columns["shapley"] = pa.array(value[own])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def repeated_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``text_hash``, others) with ``repeated``: whether a smaller id has the same text.

    The first id of each text is found by partial aggregation.  Only rows that are the first of
    their text are matched to it, by text and id together, so copies never meet in one task.
    """
    firsts = rows.filter("id is not null").groupBy("text_hash").agg(F.min("id").alias("id"))
    known = rows.filter("id is not null").join(firsts.withColumn("_first", F.lit(True)), ["text_hash", "id"], "left")
    known = known.withColumn("repeated", F.col("_first").isNull()).drop("_first")
    return known.unionByName(rows.filter("id is null").withColumn("repeated", F.lit(False)))


def audit(
    docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], repeats: str | None = None, part: str = "source"
) -> DataFrame:
    """One row per part, order of filters and step, zeros included.

    ``failures`` maps one-letter names to conditions over ``docs`` under which a document fails;
    ``repeats`` names one more filter, failed by a text that a smaller ``doc_id`` has too, table-wide.
    Columns: ``part, filter_order, step, kept, removed, redundant`` (failing, removed earlier),
    ``unique_fails`` (failing this filter alone), ``good_lost`` and ``toxic_lost`` (removed here with
    a label of ``quality`` or ``toxic`` 1), ``shapley`` (removed by the filter, summed over all orders).

    Null texts and parts count as empty.  A document has a label if any of its rows in ``labels`` says
    so; null labels say nothing.  Each row of ``docs`` counts, also with a repeated or null ``doc_id``;
    a null id neither repeats a text nor is repeated, and has no labels.  Other columns are not
    read.  An empty table gives no rows.
    """
    names = (*failures, repeats) if repeats else tuple(failures)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters")
    mask = sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(failures.values())), F.lit(0))
    text_hash = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("failed"), (text_hash if repeats else F.lit(None).cast("binary")).alias("text_hash"),
    )
    if repeats:
        rows = repeated_texts(written(rows, "failed"))
        rows = rows.withColumn("failed", F.col("failed") + F.col("repeated").cast("int") * (1 << len(failures)))
    held = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id"))
    held = held.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")))
    label = F.coalesce("_quality", F.lit(0)) + F.coalesce("_toxic", F.lit(0)) * 2
    words = rows.join(held, "id", "left").select("part", label.alias("label"), "failed")
    counted = words.mapInArrow(_survivors(len(names)), "part string, label int, subset int, survivors long")
    counted = counted.groupBy("part", "label", "subset").agg(F.sum("survivors").alias("survivors"))
    place = F.col("label") * 32 + F.col("subset")
    by_part = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(place, "survivors"))).alias("held"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(_CLASSES * 32 - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0)))
    figures = _figures(names, {"good_lost": (1, 3), "toxic_lost": (2, 3)})
    return by_part.select("part", counts.alias("counts")).mapInArrow(
        figures,
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long",
    )

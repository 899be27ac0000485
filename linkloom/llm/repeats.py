"""Repeated substrings across texts: common-prefix interval trees over a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import Powers, flat_bytes, mixed, running, small_pieces, whole_groups
from linkloom.scratch import written

#: Length in bytes of the strings that may stand once only.
LENGTH = 400
#: A place is an anchor if the hash of the ``GRAM`` bytes there is the first smallest of a window of
#: half the length.  Each string has an anchor in the first half of its places, the same wherever it
#: stands, so that all its occurrences share the bytes from there on to its length: the key.
GRAM = 32
#: Hashes are sums over groups of so many bytes, each mixed first; sums over single bytes would be
#: equal for known pairs of texts whatever the base.
_GROUP = 8
#: Anchors of one bucket, on average, and surroundings of one key that one task sorts.
BUCKET_ANCHORS = 1 << 17
KEY_CONTEXTS = 1 << 13
#: Surroundings that a task holds before it hands them on.
HELD_CONTEXTS = 1 << 13
_BASE = 0xA24BAED4963EE407

#: What a packed row holds of each anchor: columns one after the other.
_ANCHOR = {"key": "<i8", "context": "<i8", "id": "<i8", "tag": "<i4", "at": "<i4", "before": "<i2", "after": "<i2", "many": "i1"}
_SPAN = {"id": "<i8", "tag": "<i4", "begin": "<i4", "end": "<i4"}


def _pack(columns: dict[str, np.ndarray], kinds: dict[str, str], rows: slice) -> bytes:
    return b"".join(columns[name][rows].astype(kind, copy=False).tobytes() for name, kind in kinds.items())


def _unpack(packed: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds.values())
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in kinds.items()}
    for row in packed:
        n, at = len(row) // width, 0
        for name, kind in kinds.items():
            parts[name].append(np.frombuffer(row, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(p) for name, p in parts.items()}


def _anchors(texts: pa.Array, powers: Powers, length: int) -> dict[str, np.ndarray]:
    """Anchors of the strings in each text.

    ``row`` and place ``at`` in its text; ``before`` and ``after`` bound the strings that the
    anchor stands for: they begin ``before`` bytes before it at first, ``after`` bytes at last.
    """
    window, gram = length // 2, min(GRAM, length // 4)
    data, bounds = flat_bytes(texts)
    n, size = len(data), np.diff(bounds)
    strings = np.maximum(0, size - length + 1)
    if not strings.sum():
        return {name: np.zeros(0, np.int64) for name in ("row", "at", "before", "after", "key", "context")}
    up, down = powers.upto(n)
    padded = np.concatenate((data, np.zeros(_GROUP, np.uint8)))
    sums = running(mixed(np.ndarray((n,), "<u8", padded.data, 0, (1,))) * up)

    def hashed(begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (sums[end] - sums[begin]) * down[begin]

    low = mixed(hashed(slice(0, n - gram + 1), slice(gram - _GROUP + 1, n - _GROUP + 2)))
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(low), dtype=np.uint64)  # of equal hashes the first place
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    row = np.repeat(np.arange(len(size)), strings)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings) + bounds[row]
    anchor = (low[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, anchor, first, last = row[first], anchor[first], begin[first], begin[last]
    before, after = anchor - first, anchor - last
    shape = (before * window + after).astype(np.uint64)
    key = mixed(hashed(anchor, anchor + (length - window + 1 - _GROUP + 1)) + np.uint64(length))
    context = mixed(hashed(first, last + (length - _GROUP + 1)) + mixed(shape))
    return {
        "row": row, "at": anchor - bounds[row], "before": before, "after": after,
        "key": key.view(np.int64), "context": context.view(np.int64),
    }


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where a new one begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


def _spans(a: dict[str, np.ndarray], rows: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All that the strings of these anchors cover."""
    return {
        "id": a["id"][rows], "tag": a["tag"][rows], "begin": a["at"][rows] - a["before"][rows],
        "end": a["at"][rows] - a["after"][rows] + length,
    }


def _one_of_each(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One anchor of each key and context, told whether there are ``many``; places of those with many."""
    order, new = _groups(a["key"], a["context"])
    group = np.cumsum(new) - 1
    count = np.bincount(group, minlength=1)
    many = np.zeros(len(order), bool)
    many[order] = count[group] > 1 if len(order) else False
    any_many = np.zeros(len(count), bool)
    np.logical_or.at(any_many, group, a["many"][order].astype(bool))
    heads = order[new]
    out = {name: v[heads] for name, v in a.items()}
    out["many"] = (any_many | (count > 1))[: len(heads)]
    return out, np.flatnonzero(many)


def _deal(buckets: int, length: int):
    """Packed anchors for each bucket, and packed spans of what a batch has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, turn = Powers(_BASE), 0
        for batch in batches:
            found: dict[str, list] = {}
            for piece in small_pieces(batch, "text"):
                a = _anchors(piece.column(2), powers, length)
                row = a.pop("row")
                a["id"] = piece.column(0).to_numpy()[row]
                a["tag"] = piece.column(1).to_numpy()[row]
                for name, v in a.items():
                    found.setdefault(name, []).append(v)
            if not found:
                continue
            a = {name: np.concatenate(v) for name, v in found.items()}
            a["many"] = np.zeros(len(a["key"]), bool)
            kept, repeated = _one_of_each(a)
            bucket = (mixed(kept["key"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            kept = {name: v[order] for name, v in kept.items()}
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            filled = np.flatnonzero(np.diff(ends))
            packed = [_pack(kept, _ANCHOR, slice(ends[b], ends[b + 1])) for b in filled]
            turn += 1
            spans = _pack(_spans(a, repeated, length), _SPAN, slice(None))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(filled, -1 - turn % buckets).astype(np.int32)),
                    pa.array([*packed, spans], pa.binary()),
                ],
                ["bucket", "packed"],
            )

    return run


def _meet(length: int):
    """Spans that are known to repeat, and anchors whose surroundings must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(bucket, []).append(packed)
        for bucket in list(held):
            packed = held.pop(bucket)
            if bucket < 0:
                yield _shown(_unpack(packed, _SPAN), None)
                continue
            a = _unpack(packed, _ANCHOR)
            _, inverse, count = np.unique(a["key"], return_inverse=True, return_counts=True)
            some = count[inverse] > 1
            some |= a["many"] > 0
            a = {name: v[some].astype(np.int64) if name in ("at", "before", "after") else v[some] for name, v in a.items()}
            one, repeated = _one_of_each(a)
            # A batch that had it many times has reported all but the one that stands here.
            repeated = np.union1d(repeated, np.flatnonzero(a["many"]))
            yield _shown(_spans(a, repeated, length), None)
            _, inverse, count = np.unique(one["key"], return_inverse=True, return_counts=True)
            contexts = count[inverse]
            open_ = contexts > 1
            one = {name: v[open_] for name, v in one.items()}
            one["hot"] = contexts[open_] > KEY_CONTEXTS
            yield _shown(None, one)

    return run


def _shown(spans: dict | None, anchors: dict | None) -> pa.RecordBatch:
    n = len((spans or anchors)["id"])
    none = lambda kind: pa.nulls(n, kind)
    side = spans or anchors
    return pa.RecordBatch.from_arrays(
        [
            pa.array(side["id"].astype(np.int64)),
            pa.array(side["tag"].astype(np.int32)),
            *([pa.array(spans[c].astype(np.int32)) for c in ("begin", "end")] if spans else [none(pa.int32())] * 2),
            *([pa.array(anchors["key"].astype(np.int64))] if anchors else [none(pa.int64())]),
            *([pa.array(anchors[c].astype(np.int32)) for c in ("at", "before", "after")] if anchors else [none(pa.int32())] * 3),
            *([pa.array(anchors[c].astype(bool)) for c in ("many", "hot")] if anchors else [none(pa.bool_())] * 2),
        ],
        ["id", "tag", "begin", "end", "key", "at", "before", "after", "many", "hot"],
    )


_SHOWN = "id long, tag int, begin int, end int, key long, at int, before int, after int, many boolean, hot boolean"


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [press((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "tag", "packed"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around open anchors; of keys with very many, each string's hash instead."""
    plain = zstandard.ZstdDecompressor().decompress
    names = ["length", "key", "id", "tag", "at", "before", "many", "bytes", "string", "begin"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int32()]

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            own, tag, packed, anchors = (c[i].as_py() for c in batch.columns)
            text = plain(packed)
            for x in anchors:
                length = x["length"]
                begin, end = x["at"] - x["before"], x["at"] - x["after"] + length
                if not x["hot"]:
                    rows.append((length, x["key"], own, tag, x["at"], x["before"], x["many"], text[begin:end], None, None))
                else:
                    for at in range(begin, end - length + 1):
                        string = hashlib.blake2b(text[at : at + length], digest_size=16).digest()
                        rows.append((length, None, own, tag, None, None, None, None, string, at))
                if len(rows) >= HELD_CONTEXTS:
                    yield shown(rows)
                    rows = []
    yield shown(rows)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first difference lies in between
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """First, last suffix and length of each common-prefix interval of a sorted suffix array.

    ``common[i]`` is what suffixes ``i`` and ``i + 1`` share.  One scan with a stack.
    """
    stack = [(0, 0)]  # where the interval began, how much it shares
    for i, shared in enumerate([*common, 0]):
        begin = i
        while stack and stack[-1][1] > shared:
            begin, length = stack.pop()
            yield begin, i, length
        if not stack or stack[-1][1] < shared:
            stack.append((begin, shared))


def _maximal(group: list[tuple[bytes, bytes, bool]], least: int) -> Iterator[tuple[int, int, int]]:
    """Occurrences in maximal repeats of at least ``least`` bytes: number, bytes before and after the anchor.

    ``group`` has for each anchor what follows it, what precedes it in reverse, and whether it needs
    no answer.  In an interval all share what follows; sorted by what precedes, neighbours show how
    far each can be extended to the left with another one.  Where the left sides differ at once the
    repeat is maximal as it is; else it is the extended one.
    """
    order = sorted(range(len(group)), key=lambda i: group[i][0])
    common = [_common(group[i][0], group[j][0]) for i, j in zip(order, order[1:])]
    for first, last, length in _intervals(common):
        members = sorted(order[first : last + 1], key=lambda i: group[i][1])
        extended = [0] * len(members)
        for k in range(len(members) - 1):
            left = _common(group[members[k]][1], group[members[k + 1]][1])
            extended[k] = max(extended[k], left)
            extended[k + 1] = left
        for i, left in zip(members, extended):
            if left + length >= least and not group[i][2]:
                yield i, left, length


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["key", "length"]):
        key, least = table.column("key").to_numpy(), table.column("length").to_pylist()
        new = (key[1:] != key[:-1]) | (np.diff(least) != 0)
        ends = np.append(np.flatnonzero(new) + 1, len(key))
        at, before = table.column("at").to_pylist(), table.column("before").to_pylist()
        many, surroundings = table.column("many").to_pylist(), table.column("bytes").to_pylist()
        rows, begins, stops, begin = [], [], [], 0
        for end in ends.tolist():
            group = [(surroundings[i][before[i] :], surroundings[i][: before[i]][::-1], many[i]) for i in range(begin, end)]
            for i, left, length in _maximal(group, least[begin]):
                rows.append(begin + i)
                begins.append(at[begin + i] - left)
                stops.append(at[begin + i] + length)
            begin = end
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                table.column("id").combine_chunks().take(rows),
                table.column("tag").combine_chunks().take(rows),
                table.column("length").combine_chunks().take(rows),
                pa.array(begins, pa.int32()),
                pa.array(stops, pa.int32()),
            ],
            ["id", "tag", "length", "begin", "end"],
        )


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as runs that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], []]
            for packed, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                runs = {n: _runs([(s["begin"], s["end"]) for s in spans if s["length"] == n]) for n in {s["length"] for s in spans}}
                own, kept = runs.pop(length, []), None
                if own:
                    text = plain(packed)
                    edges = [0, *(at for pair in own for at in pair), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out[0].append([{"begin": a, "end": b} for a, b in own])
                out[1].append(kept)
                out[2].append(sum(b - a for other in runs.values() for a, b in other))
            spans = pa.array(out[0], pa.list_(pa.struct({"begin": pa.int32(), "end": pa.int32()})))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), spans, pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())],
                ["id", "tag", "spans", "kept", "n_shorter"],
            )

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, sha256, n_shorter`` for each row of ``docs``.

    Texts are UTF-8 bytes.  Every byte goes that is covered by a string of ``length`` bytes (32 to 32,000) which
    starts at another place too, in the same text or another; all is judged on the input.  ``spans``
    has the maximal removed runs (``begin, end``) in order, ``kept`` what is left, null where
    nothing went, and ``sha256`` the hash of the whole text.  ``n_shorter`` counts the bytes that
    strings of ``shorter`` bytes cover in the same way (0 if it isn't given); they stay.  Null texts are empty;
    texts under ``length`` lose nothing.  Repeated rows are texts of their own, so they lose all.
    Null ids are kept.  Other columns are not read.

    Anchors, chosen by content, stand for all strings of the length; those whose key occurs once are
    dropped.  Equal surroundings (hashes of 128 bits) are repeats as a whole, counted in each
    batch before anything moves, so that copies of a text cost one row for each batch.  Different
    surroundings of one key form a suffix array whose common-prefix intervals give the maximal
    repeats of its anchors.  Keys with more of them than a task should sort have each
    of their strings counted by hash instead, which finds the same bytes.
    """
    lengths = sorted({length, shorter or length})
    if not 32 <= lengths[0] <= lengths[-1] <= 32_000:
        raise ValueError(f"lengths must be from 32 to 32,000 bytes, not {lengths}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.xxhash64(text)
    #: An id, or a hash in its place, and a tag that tells rows with one id apart.
    low = h.bitwiseAND(0x3FFFFFFF) * 2 + F.col("doc_id").isNull().cast("int")
    texts = docs.select(
        F.coalesce(F.col("doc_id"), F.xxhash64(text, F.lit(1))).cast("long").alias("id"),
        low.cast("int").alias("tag"), text.alias("text"), "doc_id",
    )
    plain = texts.select("id", "tag", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    plain = written(plain, "texts")
    size = plain.agg(F.sum("n_bytes")).first()[0] or 0
    own = texts.select("id", "tag", "text")

    def met_anchors(n: int) -> DataFrame:
        buckets = int(size * 2 // (n // 2 + 1) // BUCKET_ANCHORS) + 1
        dealt = own.mapInArrow(_deal(buckets, n), "bucket int, packed binary")
        # A bucket is a partition, so that none gets several while others get none.
        placed = dealt.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)))
        return written(placed.mapInArrow(_meet(n), _SHOWN), "anchors").withColumn("length", F.lit(n))

    met = reduce(DataFrame.union, map(met_anchors, lengths))
    anchor = F.struct("length", "key", "at", "before", "after", "many", "hot")
    open_ = F.col("key").isNotNull()
    involved = met.groupBy("id", "tag").agg(F.collect_set(F.when(open_, anchor)).alias("anchors"))
    packed = own.mapInArrow(_compressed, "id long, tag int, packed binary")
    # Rows that agree in id and text are one here; each gets what is found.
    involved = written(packed.join(involved, ["id", "tag"]), "involved")
    around = involved.filter("size(anchors) > 0").select("id", "tag", "packed", "anchors").mapInArrow(
        _surroundings,
        "length int, key long, id long, tag int, at int, before int, many boolean, bytes binary, string binary, begin int",
    )
    around = written(around, "surroundings")
    compared = around.filter("key is not null").select("length", "key", "id", "tag", "at", "before", "many", "bytes").distinct()
    compared = compared.repartition("key").sortWithinPartitions("key", "length")
    compared = compared.mapInArrow(_compare, "id long, tag int, length int, begin int, end int")
    strings = around.filter("string is not null").select("length", "string", "id", "tag", "begin")
    twice = strings.groupBy("length", "string").agg(F.count("*").alias("n")).filter("n > 1").select("length", "string")
    counted = strings.join(twice, ["length", "string"]).select("id", "tag", "length", "begin", (F.col("begin") + F.col("length")).alias("end"))

    spans = met.filter("begin is not null").select("id", "tag", "length", "begin", "end").union(compared).union(counted)
    spans = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("length", "begin", "end")).alias("spans"))
    whole = involved.select("id", "tag", "packed").dropDuplicates(["id", "tag"])
    done = whole.join(spans, ["id", "tag"]).select("id", "tag", "packed", "spans").mapInArrow(
        _cut(length), "id long, tag int, spans array<struct<begin:int,end:int>>, kept binary, n_shorter long"
    )
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return plain.join(done, ["id", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), "kept", "sha256",
        F.coalesce("n_shorter", F.lit(0)).cast("long").alias("n_shorter"),
    )

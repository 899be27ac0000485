"""Language-model scores by online logistic mixing of bit predictors.

A text is its words, lower-cased in A-Z, and an end.  Words are spelled byte by byte, each byte by
the yes/no decisions of a code tree that depends on the byte before it; predictors look up the odds
of a decision by hashed contexts.  At the first byte of a word the contexts are the words before it,
at the others the word's own beginning.  At all of them a gate chooses the weights that mix the
predictors, the weights follow each outcome while a text is read, and an adaptive map refines the
result.  First bytes have weights and a map of their own, so the two kinds of decisions are mixed
side by side; what is looked up for the others is the same wherever a word stands.  The sum over all
decisions is the text's code length in bits.  All statistics, and the weights and maps that texts
start with, come from all training texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import BLANK, Powers, flat_bytes, mixed, running, word_ranges
from linkloom.llm.alignment import ragged
from linkloom.scratch import written

#: Bits of cells of the contexts inside a word: byte before (exact), two and three bytes before, beginning.
CELL_BITS = (16, 18, 20, 22)
#: Bits of cells of each context of a word's first byte: word before, the one before that, both, last bytes.
HEAD_BITS, _HEADS = 14, 4
_BLOCK_BITS = 14
#: Following tasks whose counts of a block are summed before all are.
_SALTS = 64
#: Decisions after which a lane starts again from the fitted weights, at first bytes and behind them, and lanes that run abreast.
SEGMENT, TAIL_SEGMENT = 1024, 2048
LANES = 4096
#: Steps whose inputs are made ready at once.
_STRIP = 32
#: Text whose words are looked up at once.
PIECE_BYTES = 1 << 21
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 1 << 19
#: Words whose counts are broadcast: the most frequent ones of at most this many bytes.
HOT_WORDS, HOT_BYTES = 1 << 19, 32
#: Decisions of frequent words that a task keeps spelled (five bytes each), and words whose decisions are copied at once.
TAIL_ROOM, _TOKENS = 1 << 22, 1 << 15
#: Passes over all training texts that fit where lanes start, and over all their words: Newton steps and one for the map.
HEAD_PASSES, TAIL_PASSES = 1, 3
#: Words whose decisions a pass over words holds at once: more would be slower, in memory that is new to the process each time.
FIT_BYTES = 1 << 18
_RATE, _MAP_RATE, _MAP = 0.02, 0.02, 33
#: Least probability of a decision.
_LEAST = 1e-4
#: Gates: depth in the code tree; inside a word also the place in it and how sure its beginning is.
_DEPTHS, _HEAD_GATES, _PLACES, _SURE = 3, 8, 5, 4
_MOST = 8.0
_UNIT = 127 / _MOST
_SPACE, _END = 32, 10
_BASE = 0x9E3779B97F4A7C15


# ---- texts as words ---------------------------------------------------------------------------


def _lower(data: np.ndarray) -> np.ndarray:
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words, each with a space behind it, and a line break at the end of each text; tokens of each text."""
    data, bounds = flat_bytes(texts)
    data = _lower(data)
    starts, stops = word_ranges(data, bounds)
    n = len(bounds) - 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n)
    place = np.arange(len(starts)) + doc
    sizes = np.ones(len(starts) + n, np.int64)
    sizes[place] += stops - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(offsets[-1], _SPACE, np.uint8)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = data[~BLANK[data]]
    out[offsets[np.cumsum(per_doc) + np.arange(n)]] = _END
    array = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(out))
    return array, per_doc + 1


def _pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _bytes_at(words: pa.Array, back: int) -> np.ndarray:
    """The byte ``back`` places before the end of each word, its separator not counted; zero beyond its begin."""
    data, bounds = flat_bytes(words)
    at = bounds[1:] - 1 - back
    return np.where(at >= bounds[:-1], data[np.maximum(at, 0)], 0).astype(np.uint64)


def _keys(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each row's bytes."""
    up, down = powers.upto(len(data) + 1)
    sums = running((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + np.uint64(2))


@dataclass(frozen=True)
class _Run:
    """The words of some texts in their order, by place among the distinct ones."""

    distinct: pa.Array
    keys: np.ndarray  # hashes of the distinct words
    at: np.ndarray
    per_doc: np.ndarray
    first: np.ndarray  # the first byte of each distinct word
    #: For each context of first bytes the cell of each word of the texts.
    cells: list[np.ndarray]

    @staticmethod
    def of(texts: pa.Array, powers: Powers) -> _Run:
        tokens, per_doc = _tokens(texts)
        encoded = tokens.dictionary_encode()
        distinct, at = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        data, bounds = flat_bytes(distinct)
        key = _keys(data, bounds, powers)
        ending = mixed(_bytes_at(distinct, 1) * np.uint64(256) + _bytes_at(distinct, 2) + np.uint64(1 << 20))
        begins = np.cumsum(per_doc) - per_doc

        def before(values: np.ndarray, back: int) -> np.ndarray:
            out = np.zeros(len(at), np.uint64)
            out[back:] = values[at[:-back]]
            for skipped in range(back):  # nothing lies before the begin of a text
                out[begins[per_doc > skipped] + skipped] = 0
            return out

        one, two = before(key, 1), before(key, 2)
        shift = np.uint64(64 - HEAD_BITS)
        hashed = [one, two, one * np.uint64(0x9FB21C651E98DF25) + two, before(ending, 1)]
        cells = [(h * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32) for h in hashed]
        return _Run(distinct, key, at, per_doc, data[bounds[:-1]], cells)


def _zeros(sizes: list[int], kind: type) -> list[np.ndarray]:
    """Tables that lie in one block, which the system gets back whole when it is free: workers wait between tasks."""
    return np.split(np.zeros(sum(sizes), kind), np.cumsum(sizes)[:-1])


def _count(table: np.ndarray, at: np.ndarray, times: np.ndarray) -> None:
    """``times`` added to cells of ``table``, of the same type: with places of 64 bits numpy does it in one plain loop."""
    np.add.at(table, at.astype(np.int64), times)


_COUNTED = "token string, n long, table int, block int, counts binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, and in rows without a word the counts of first bytes by context."""
    held: list[pa.Table] = []
    waiting = 0
    powers = Powers(_BASE)
    contexts = _zeros([256 << HEAD_BITS] * _HEADS, np.int32)

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in held[0].to_batches():
            nothing = [pa.nulls(batch.num_rows, kind) for kind in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *nothing], ["token", "n", "table", "block", "counts"])

    def summed() -> list[pa.Table]:
        found = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")])
        return [found.rename_columns(["token", "n"])]

    for batch in batches:
        for piece in _pieces(batch, 0):
            texts = _Run.of(piece.column(0), powers)
            n = np.bincount(texts.at, minlength=len(texts.distinct))
            held.append(pa.table({"token": texts.distinct.cast(pa.string()), "n": n}))
            waiting += len(n)
            first = texts.first[texts.at]
            for table, cells in zip(contexts, texts.cells):
                _count(table, (cells << 8) + first, np.int32(1))
        if waiting > HELD_WORDS:
            held = summed()
            waiting = len(held[0])
            if waiting > HELD_WORDS // 2:
                yield from rows()
                held, waiting = [], 0
    if held:
        held = summed()
        yield from rows()
        held = []
    for k, table in enumerate(contexts):
        for own in _sparse(len(CELL_BITS) + k, table):
            nothing = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, *own.columns], ["token", "n", "table", "block", "counts"])
    pa.default_memory_pool().release_unused()


# ---- code trees and contexts ------------------------------------------------------------------


@dataclass(frozen=True)
class Codes:
    """For each byte after each byte the decisions that spell it: ``first``, ``length`` into ``node``, ``bit``, ``depth``."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Codes:
        """Optimal code trees for ``counts`` (256 by 256); all bytes have a code after every byte."""
        length, node, bit, depth = np.zeros(1 << 16, np.int64), [], [], []
        for before in range(256):
            heap = [(int(c) * 256 + 1, i) for i, c in enumerate(counts[before])]
            heapq.heapify(heap)
            up = {}
            for inner in range(256, 511):
                (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
                up[a], up[b] = (inner, 0), (inner, 1)
                heapq.heappush(heap, (x + y, inner))
            for byte in range(256):
                path, at = [], byte
                while at in up:
                    path.append(up[at])
                    at = path[-1][0]
                length[before * 256 + byte] = len(path)
                node += [510 - parent for parent, _ in reversed(path)]
                bit += [side for _, side in reversed(path)]
                depth += range(len(path))
        first = np.cumsum(length) - length
        return Codes(first, length, *(np.array(own, np.uint8) for own in (node, bit, depth)))


#: What the nodes of a code tree add to a spread context.
_NODE = np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) * np.uint64(0x9FB21C651E98DF25)


def _cell(spread: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a context and a node of a code tree, from the sum of what they spread to; ``spread`` is used up."""
    spread ^= spread >> np.uint64(29)
    spread *= np.uint64(0x2545F4914F6CDD1D)
    spread >>= np.uint64(64 - bits)
    return spread.astype(np.int32)


@dataclass(frozen=True)
class _Spelled:
    """The decisions of some words behind their first bytes, one word after the other, and the cells of their contexts."""

    word: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    cells: list[np.ndarray]


def _spelled(words: pa.Array, codes: Codes, powers: Powers) -> _Spelled:
    data, bounds = flat_bytes(words)
    n = len(data)
    sizes = np.diff(bounds)
    start = np.repeat(bounds[:-1], sizes)
    inside = np.arange(n) - start
    before = []
    for back in (1, 2, 3):
        shifted = np.full(n, _SPACE, np.uint8)
        shifted[back:] = data[:-back] if n >= back else []
        before.append(np.where(inside >= back, shifted, np.uint8(_SPACE)).astype(np.uint64))
    up, down = powers.upto(n + 1)
    sums = running((data.astype(np.uint64) + np.uint64(1)) * up[:n])
    beginning = mixed((sums[:-1] - sums[start]) * down[start] + np.uint64(1))
    byte = np.flatnonzero(inside > 0)
    single = before[0] * np.uint64(256)
    code = (single.view(np.int64) + data)[byte]
    length = codes.length[code]
    at = ragged(codes.first[code], length)
    node, bit = codes.node[at], codes.bit[at]
    owner = np.repeat(byte, length)
    place = (np.minimum((inside - 1) >> 1, _PLACES - 1) * _DEPTHS).astype(np.uint8)
    gate = place[owner] + np.minimum(codes.depth, np.uint8(_DEPTHS - 1))[at]
    pair = single + before[1]
    triple = pair * np.uint64(256) + before[2]
    cells, of_node = [single.astype(np.int32)[owner] + node], _NODE[node]
    for salt, context in enumerate((pair, triple, beginning), 1):
        spread = ((context * np.uint64(8) + np.uint64(salt)) * np.uint64(0x9FB21C651E98DF25))[owner]
        spread += of_node
        cells.append(_cell(spread, CELL_BITS[salt]))
    return _Spelled(np.repeat(np.arange(len(sizes)), sizes)[owner], bit, gate, cells)


def _block_row(table: int, block: int, counts: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(counts)
    blob = held.astype("<u2").tobytes() + counts[held].astype("<i8").tobytes()
    blob = zstandard.ZstdCompressor(level=1).compress(blob)
    columns = [pa.array([table], pa.int32()), pa.array([block], pa.int32()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["table", "block", "counts"])


def _sparse(table: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of a table (two counts each) that are not zero, by block."""
    size = 2 << _BLOCK_BITS
    for block in range(len(counts) // size):
        own = counts[block * size : (block + 1) * size]
        if own.any():
            yield _block_row(table, block, own)


_SPARSE = "table int, block int, counts binary"


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = flat_bytes(batch.column(0))
        before = np.concatenate(([_SPACE], data[:-1])).astype(np.int64)
        before[bounds[:-1]] = _SPACE
        weight = np.repeat(batch.column(1).to_numpy(), np.diff(bounds))
        counts += np.bincount(before * 256 + data, weight, 1 << 16)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held].astype(np.int64))], ["code", "n"])


def _word_contexts(codes: Codes):
    """Counts of the contexts inside words from words and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BASE)
        tables = _zeros([2 << bits for bits in CELL_BITS], np.int64)
        for batch in batches:
            for piece in _pieces(batch, 0, FIT_BYTES):
                words = _spelled(piece.column(0), codes, powers)
                weight = piece.column(1).to_numpy()[words.word]
                for table, cells in zip(tables, words.cells):
                    _count(table, cells * 2 + words.bit, weight)
        for k, table in enumerate(tables):
            yield from _sparse(k, table)

    return run


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one in units of a signed byte; zero where nothing was counted."""
    odds = np.log((np.maximum(ones, 0) + 0.4) / (np.maximum(zeros, 0) + 0.4))
    return np.rint(np.clip(odds, -_MOST, _MOST) * _UNIT).astype(np.int8)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The counts of each block, whose rows lie next to each other, summed as they stream by."""
    last, counts = None, np.zeros(2 << _BLOCK_BITS, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for table, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and (table, block) != last:
                yield *last, counts
                counts = np.zeros(2 << _BLOCK_BITS, np.int64)
            last = table, block
            held = unpack(blob)
            n = len(held) // 10
            counts[np.frombuffer(held, "<u2", n)] += np.frombuffer(held, "<i8", n, 2 * n)
    if last is not None:
        yield *last, counts


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, block, counts in _sums(batches):
        yield _block_row(table, block, counts)


def _tables(codes: Codes):
    """The log odds of each block of cells, and what they would be with one zero or one one less.

    Counts of first bytes by context become counts of decisions: those of all bytes below a side of a node.
    """
    own = codes.length[_SPACE * 256 : (_SPACE + 1) * 256]
    at = ragged(codes.first[_SPACE * 256 : (_SPACE + 1) * 256], own)
    sides = np.zeros((256, 512))
    sides[np.repeat(np.arange(256), own), codes.node[at].astype(np.int64) * 2 + codes.bit[at]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, block, counts in _sums(batches):
            if table >= len(CELL_BITS):
                counts = (counts.reshape(-1, 256).astype(np.float64) @ sides).ravel()
            zeros, ones = counts[::2], counts[1::2]
            blobs = [_stretched(zeros, ones), _stretched(zeros - 1, ones), _stretched(zeros, ones - 1)]
            columns = [pa.array([table], pa.int32()), pa.array([block], pa.int32())]
            columns += [pa.array([b.tobytes()], pa.binary()) for b in blobs]
            yield pa.RecordBatch.from_arrays(columns, ["table", "block", "odds", "less_zero", "less_one"])

    return run


# ---- mixing -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Start:
    """Where each lane starts: weights of each gate, and the refining map."""

    weights: np.ndarray
    map: np.ndarray

    @staticmethod
    def plain(gates: int, predictors: int) -> Start:
        weights = np.full((gates, predictors + 1), 0.3, np.float32)
        weights[:, -1] = 0
        steps = np.linspace(-_MOST, _MOST, _MAP)
        return Start(weights, (1 / (1 + np.exp(-steps))).astype(np.float32))


def _inputs(odds: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.multiply(odds, np.float32(1 / _UNIT), out=out[:, :-1], dtype=np.float32)
    return out


def _spot(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where log odds lie in the refining map: the place below, and how far towards the next."""
    spot = (z + np.float32(_MOST)) * np.float32((_MAP - 1) / (2 * _MOST))
    low = np.minimum(np.floor(spot), np.float32(_MAP - 2))
    spot -= low
    return low.astype(np.int64), spot


def _mix(odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, length: np.ndarray, start: Start) -> tuple[np.ndarray, Start]:
    """Bits that each lane costs, and where the lanes end on average.

    ``odds`` (steps, lanes, predictors), ``gate`` and ``bit`` (steps, lanes) hold a lane in each
    column, longest first; ``length`` says how many decisions each has.
    """
    lanes, gates = len(length), len(start.weights)
    # The four weights of a gate are one element of 16 bytes, which is read and written at once; the constant's share lies beside.
    weights = np.tile(np.ascontiguousarray(start.weights[:, :-1], np.float32), (lanes, 1)).view(np.complex128)[:, 0]
    constant = np.tile(start.weights[:, -1] * np.float32(0.5), lanes)
    refined = np.tile(start.map, lanes)
    row, base = np.arange(lanes) * gates, np.arange(lanes) * _MAP
    bits = np.zeros(lanes)
    active = lanes - np.searchsorted(length[::-1], np.arange(len(bit)), side="right")
    for some in range(0, len(bit), _STRIP):
        most, steps = active[some], slice(some, some + _STRIP)
        inputs = odds[steps, :most] * np.float32(1 / _UNIT)
        outcome = bit[steps, :most].astype(np.float32)
        chance = np.ones(outcome.shape, np.float32)
        for x, y, at, q, n in zip(inputs, outcome, row[:most] + gate[steps, :most], chance, active[steps].tolist()):
            x, y, at, q = x[:n], y[:n], at[:n], q[:n]
            w = weights.take(at)
            held = w.view(np.float32).reshape(n, 4)
            shares = x * held
            half = constant.take(at)
            z = _summed_shares(shares, half)
            p = np.exp(-z)
            p += 1
            np.divide(1, p, out=p)
            low, part = _spot(z)
            low += base[:n]
            high = low + 1
            left, right = refined.take(low), refined.take(high)
            np.subtract(right, left, out=z)
            z *= part
            z += left
            z += p
            z *= np.float32(0.5)
            np.subtract(z, 1 - y, out=q)  # of what came true, but for the sign
            np.subtract(y, p, out=p)
            p *= np.float32(_RATE)
            np.multiply(x, p.repeat(4).reshape(n, 4), out=shares)
            held += shares
            weights[at] = w
            p *= np.float32(0.25)
            half += p
            constant[at] = half
            part *= np.float32(_MAP_RATE)
            np.subtract(y, right, out=p)
            p *= part
            right += p
            np.subtract(y, left, out=y)
            np.subtract(np.float32(_MAP_RATE), part, out=part)
            y *= part
            left += y
            refined[low] = left
            refined[high] = right
        bits[:most] -= np.log2(np.clip(np.abs(chance), _LEAST, 1)).sum(axis=0, dtype=np.float64)
    ends = np.concatenate((weights.view(np.float32).reshape(lanes, gates, 4), 2 * constant.reshape(lanes, gates, 1)), axis=2)
    return bits, Start(ends.mean(axis=0), refined.reshape(lanes, _MAP).mean(axis=0))


def _summed_shares(shares: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Log odds from the shares of four predictors and the constant, in an order that is kept, as rounding depends on it."""
    pairs = shares.view(np.complex64)
    pairs = pairs[:, 0] + pairs[:, 1]
    z = pairs.real + pairs.imag
    z += constant
    np.maximum(z, np.float32(-_MOST), out=z)
    return np.minimum(z, np.float32(_MOST), out=z)


def _odds(cells: list[np.ndarray], bit: np.ndarray, tables: list[np.ndarray], less: bool = False) -> np.ndarray:
    """Log odds by each predictor; ``less``: of :func:`_less`, where the decisions' own counts are left out."""
    out = np.empty((len(bit), len(tables)), np.int8)
    for k, (table, own) in enumerate(zip(tables, cells)):
        out[:, k] = table.take(own * 2 + bit if less else own)
    return out


def _less(zeros: list[np.ndarray], ones: list[np.ndarray]) -> list[np.ndarray]:
    """Tables that hold for each cell its odds with one zero less and with one one less, side by side."""
    return [np.stack(two, axis=1).ravel() for two in zip(zeros, ones)]


def _gates(gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Gates by place and depth, each split by how sure the last predictor is; zero is a context never seen."""
    sure = np.abs(odds[:, -1].astype(np.int16))
    return (gate * _SURE + (sure > 0) + (sure >= _UNIT) + (sure >= 3 * _UNIT)).astype(np.uint8)


def _summed(rows: DataFrame, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums of arrays of doubles, one row (a binary column for each) from each task."""
    out = [np.zeros(shape) for shape in shapes]
    for row in rows.collect():
        for total, blob in zip(out, row):
            total += np.frombuffer(blob).reshape(total.shape)
    return out


def _sum_row(arrays: list[np.ndarray]) -> pa.RecordBatch:
    blobs = [pa.array([a.astype(np.float64).tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays(blobs, [f"s{i}" for i in range(len(blobs))])


def _tail_sums(shared, start: Start):
    """Gradient and Hessian of each gate's weights, hits and visits of the map's places; each word as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, tables), powers = shared.value, Powers(_BASE)
        gates, width = start.weights.shape
        gradient, hessian = np.zeros((gates, width)), np.zeros((gates, width, width))
        hits, seen = np.zeros(_MAP), np.zeros(_MAP)
        for batch in batches:
            for piece in _pieces(batch, 0, FIT_BYTES):
                words = _spelled(piece.column(0), codes, powers)
                odds = _odds(words.cells, words.bit, tables, less=True)
                gate = _gates(words.gate, odds)
                order = np.argsort(gate, kind="stable")
                sorted_odds = odds.view(np.int32)[:, 0].take(order).view(np.int8).reshape(odds.shape)
                x = _inputs(sorted_odds, np.full((len(odds), width), 0.5))
                bit, n = words.bit[order].astype(np.float64), piece.column(1).to_numpy().astype(np.float64)[words.word[order]]
                ends = np.cumsum(np.bincount(gate, minlength=gates))
                for g in range(gates):
                    at = slice(ends[g - 1] if g else 0, ends[g])
                    own = x[at]
                    z = np.clip(own @ start.weights[g], -_MOST, _MOST)
                    p = 1 / (1 + np.exp(-z))
                    gradient[g] += own.T @ (n[at] * (bit[at] - p))
                    hessian[g] += (own * (n[at] * p * (1 - p))[:, None]).T @ own
                    low, part = _spot(z)
                    for places, share in ((low, n[at] * (1 - part)), (low + 1, n[at] * part)):
                        hits += np.bincount(places, share * bit[at], _MAP)
                        seen += np.bincount(places, share, _MAP)
        yield _sum_row([gradient, hessian, hits, seen])

    return run


def _tail_start(words: DataFrame, shared, start: Start) -> Start:
    """Weights of each gate by damped Newton steps over all words, and the map from the outcomes at each of its places."""
    (gates, width), first = start.weights.shape, start.weights.astype(np.float64)
    weights = first.copy()
    for step in range(TAIL_PASSES):
        rows = words.mapInArrow(_tail_sums(shared, Start(weights, start.map)), "s0 binary, s1 binary, s2 binary, s3 binary")
        gradient, hessian, hits, seen = _summed(rows, [(gates, width), (gates, width, width), (_MAP,), (_MAP,)])
        if step < TAIL_PASSES - 1:
            weights = weights + np.linalg.solve(hessian + np.eye(width), (gradient - (weights - first))[:, :, None])[:, :, 0]
    refined = start.map + (hits - start.map * seen) / (seen + 50)
    return Start(weights.astype(np.float32), refined.astype(np.float32))


def _laid(values: list[np.ndarray], begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Of each of ``values`` the runs that begin at ``begin``, longest first, as (steps, lanes); what lies beyond a run's end is not set."""
    steps = int(size[0])
    out = [np.zeros((steps, len(size)), own.dtype) for own in values]
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    for some in range(0, steps, _STRIP):
        most = active[some]
        at = begin[:most] + np.arange(some, min(some + _STRIP, steps))[:, None]
        for wide, own in zip(out, values):
            wide[some : some + _STRIP, :most] = own.take(at, mode="clip")
    return out


def _lanes(length: np.ndarray, per_doc: np.ndarray, segment: int, decisions: Callable) -> Iterator[tuple]:
    """Decisions as lanes, ready for mixing, with the text of each lane.

    ``length`` says how many decisions each word of the texts has, and ``decisions(t0, t1)`` gives those of the
    words from ``t0`` to ``t1``: odds of four predictors as one value, and gates and outcomes as one.  A lane is
    ``segment`` decisions of one text or what is left of it, so that what a lane holds depends on
    nothing but its text.
    """
    ends = np.cumsum(length)
    per_text = np.diff(ends[np.cumsum(per_doc) - 1], prepend=0)
    segments = -(-per_text // segment)
    doc = np.repeat(np.arange(len(per_doc)), segments)
    nth = ragged(np.zeros(len(per_doc), np.int64), segments)
    begin = (np.cumsum(per_text) - per_text)[doc] + nth * segment
    size = np.minimum(per_text[doc] - nth * segment, segment)
    for some in range(0, len(doc), LANES):
        last = min(some + LANES, len(doc)) - 1
        t0 = np.searchsorted(ends, begin[some], side="right")
        t1 = np.searchsorted(ends, begin[last] + size[last], side="left") + 1
        own = some + np.argsort(-size[some : last + 1], kind="stable")
        four, mark = _laid(decisions(t0, t1), begin[own] - (ends[t0] - length[t0]), size[own])
        yield four.view(np.int8).reshape(*mark.shape, 4), mark >> 1, mark & 1, size[own], doc[own]


def _head_lanes(texts: _Run, codes: Codes, tables: list[np.ndarray], less: bool = False) -> Iterator[tuple]:
    """The lanes of the decisions at the first bytes of the words."""
    marks = np.minimum(codes.depth, np.uint8(_HEAD_GATES - 1)) * 2 + codes.bit
    code = _SPACE * 256 + texts.first.astype(np.int64)
    length, first = codes.length[code][texts.at], codes.first[code][texts.at]

    def decisions(t0: int, t1: int) -> list[np.ndarray]:
        each = length[t0:t1]
        at = ragged(first[t0:t1], each)
        node, mark = codes.node[at], marks[at]
        cells = [np.repeat(own[t0:t1].astype(np.int64) << 8, each) + node for own in texts.cells]
        return [_odds(cells, mark & 1, tables, less).view(np.int32)[:, 0], mark]

    return _lanes(length, texts.per_doc, SEGMENT, decisions)


class _Tails:
    """What words are spelled with behind their first bytes, by the model ``codes`` and ``tables``, for following pieces of text.

    Words of the table of frequent ones are spelled once for all pieces, as long as there is room; the others at each piece.
    """

    def __init__(self, codes: Codes, tables: list[np.ndarray], frequent: int):
        self.codes, self.tables, self.powers = codes, tables, Powers(_BASE)
        self.first, self.length = np.full(frequent, -1), np.zeros(frequent, np.int64)
        self.held, self.used = [np.zeros(0, np.int32), np.zeros(0, np.uint8)], 0

    def _put(self, words: pa.Array, at: int) -> tuple[np.ndarray, int]:
        """Decisions of ``words`` laid from place ``at``; how many each has, and where they end."""
        lengths = [np.zeros(0, np.int64)]
        for piece in _pieces(pa.record_batch([words], ["token"]), 0, FIT_BYTES):
            own = _spelled(piece.column(0), self.codes, self.powers)
            odds = _odds(own.cells, own.bit, self.tables)
            end = at + len(odds)
            if end > len(self.held[0]):
                self.held = [np.concatenate((held, np.zeros(end + end // 2 - len(held), held.dtype))) for held in self.held]
            self.held[0][at:end] = odds.view(np.int32)[:, 0]
            self.held[1][at:end] = _gates(own.gate, odds) * 2 + own.bit
            lengths.append(np.bincount(own.word, minlength=piece.num_rows))
            at = end
        return np.concatenate(lengths), at

    def of(self, words: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``held`` the decisions of each of ``words`` begin, and how many there are; ``place`` is that of frequent ones, or -1."""
        first, length = np.where(place >= 0, self.first[place], -1) if len(self.first) else place.copy(), np.zeros(len(words), np.int64)
        known = first >= 0
        length[known] = self.length[place[known]]
        begin = self.used
        # Those that stay come first.
        for new in (np.flatnonzero(~known & (place >= 0)), np.flatnonzero(place < 0)):
            each, end = self._put(words.take(pa.array(new)), begin)
            first[new], length[new] = begin + np.cumsum(each) - each, each
            if end <= TAIL_ROOM and len(new) and place[new[0]] >= 0:
                self.first[place[new]], self.length[place[new]], self.used = first[new], each, end
            begin = end
        return first, length

    def lanes(self, words: pa.Array, at: np.ndarray, per_doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """The lanes of the decisions behind the first bytes of texts, whose words are those of ``words`` at ``at``."""
        first, length = self.of(words, place)
        each, begin = length[at], first[at]

        def decisions(t0: int, t1: int) -> list[np.ndarray]:
            out = [np.zeros(int(each[t0:t1].sum()), held.dtype) for held in self.held]
            end = 0
            for some in range(t0, t1, _TOKENS):
                own = slice(some, min(some + _TOKENS, t1))
                places = ragged(begin[own], each[own])
                for flat, held in zip(out, self.held):
                    flat[end : end + len(places)] = held.take(places)
                end += len(places)
            return out

        return _lanes(each, per_doc, TAIL_SEGMENT, decisions)


def _mixed_bits(lanes: Iterator[tuple], texts: int, start: Start) -> np.ndarray:
    """Bits of each text, mixed online."""
    out = np.zeros(texts)
    for odds, gate, bit, sizes, doc in lanes:
        np.add.at(out, doc, _mix(odds, gate, bit, sizes, start)[0])
    return out


@dataclass(frozen=True)
class Model:
    """Code trees, log odds of all cells of each predictor, and where the mixing of both parts of words starts."""

    codes: Codes
    inside: list[np.ndarray]
    heads: list[np.ndarray]
    head: Start
    tail: Start

    def tails(self, words: pa.Array, powers: Powers) -> np.ndarray:
        """Bits of each word behind its first byte, as the only word of a text."""
        place, one = np.full(len(words), -1), np.ones(len(words), np.int64)
        return self.later_bytes(words, np.arange(len(words)), one, place, _Tails(self.codes, self.inside, 0))

    def later_bytes(self, words: pa.Array, at: np.ndarray, per_doc: np.ndarray, place: np.ndarray, tails: _Tails) -> np.ndarray:
        """Bits of the words of each text behind their first bytes."""
        return _mixed_bits(tails.lanes(words, at, per_doc, place), len(per_doc), self.tail)

    def first_bytes(self, texts: _Run) -> np.ndarray:
        """Bits of the first bytes of the words of each text."""
        return _mixed_bits(_head_lanes(texts, self.codes, self.heads), len(texts.per_doc), self.head)


def _head_sums(shared, start: Start):
    """How many lanes there are, and the sums of where they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, tables), powers = shared.value, Powers(_BASE)
        lanes, weights, refined = np.zeros(1), np.zeros(start.weights.shape), np.zeros(_MAP)
        for batch in batches:
            for piece in _pieces(batch, 0):
                for odds, gate, bit, sizes, _ in _head_lanes(_Run.of(piece.column(0), powers), codes, tables, less=True):
                    end = _mix(odds, gate, bit, sizes, start)[1]
                    lanes += len(sizes)
                    weights += end.weights.astype(np.float64) * len(sizes)
                    refined += end.map.astype(np.float64) * len(sizes)
        yield _sum_row([lanes, weights, refined])

    return run


def _head_start(texts: DataFrame, shared, start: Start) -> Start:
    """Passes over all lanes, each from where those of the pass before ended on average."""
    for _ in range(HEAD_PASSES):
        rows = texts.mapInArrow(_head_sums(shared, start), "s0 binary, s1 binary, s2 binary")
        lanes, weights, refined = _summed(rows, [(1,), start.weights.shape, (_MAP,)])
        if lanes[0]:
            start = Start((weights / lanes).astype(np.float32), (refined / lanes).astype(np.float32))
    return start


def fit(texts: DataFrame, words: DataFrame, heads: DataFrame) -> Model:
    """A model of ``texts`` (``id``, ``text``), whose words (``token``, ``n``) and contexts of first bytes are counted.

    Contexts of all texts are counted in tables of fixed numbers of cells (``CELL_BITS``, ``HEAD_BITS``), whatever
    the size of the input, which bounds what the driver gets.  The first weights and the maps are fitted to
    all texts and all words; there the cells' counts leave out the decision at hand, which they hold.
    """
    pairs = words.mapInArrow(_byte_pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for code, n in pairs:
        counts[code] = n
    codes = Codes.of(counts.reshape(256, 256))
    tallies = words.mapInArrow(_word_contexts(codes), _SPARSE).unionByName(heads)
    salted = tallies.repartition("table", "block", F.floor(F.spark_partition_id() / _SALTS)).sortWithinPartitions("table", "block")
    blocks = salted.mapInArrow(_merged, _SPARSE).repartition("table", "block").sortWithinPartitions("table", "block")
    blocks = blocks.mapInArrow(_tables(codes), "table int, block int, odds binary, less_zero binary, less_one binary")
    sizes = [*(1 << bits for bits in CELL_BITS), *[256 << HEAD_BITS] * _HEADS]
    found = [[np.zeros(n, np.int8) for n in sizes] for _ in range(3)]
    for row in blocks.toLocalIterator():
        for tables, blob in zip(found, row[2:]):
            begin = row.block * len(blob)
            tables[row.table][begin : begin + len(blob)] = np.frombuffer(blob, np.int8)
    head, tail = Start.plain(_HEAD_GATES, _HEADS), Start.plain(_PLACES * _DEPTHS * _SURE, len(CELL_BITS))
    inside, heads_of = [tables[: len(CELL_BITS)] for tables in found], [tables[len(CELL_BITS) :] for tables in found]
    context = texts.sparkSession.sparkContext
    # Each pass looks up odds without the decision at hand only.
    shared = [context.broadcast((codes, _less(*tables[1:]))) for tables in (heads_of, inside)]
    head = _head_start(texts.select("text"), shared[0], head)
    tail = _tail_start(words.select("token", "n"), shared[1], tail)
    for done in shared:
        done.destroy()
    return Model(codes, inside[0], heads_of[0], head, tail)


# ---- scores -----------------------------------------------------------------------------------


def _frequent(words: DataFrame) -> int:
    """The least count from which at most ``HOT_WORDS`` words count as frequent: sums by power of two."""
    steps = words.groupBy(F.floor(F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for step, n in steps:
        held += n
        if held > HOT_WORDS:
            break
        least = 1 << step
    return least


@dataclass(frozen=True)
class _Known:
    """Words in the order of their hashes, made once for all tasks: Arrow's lookup builds its table at each call."""

    words: pa.Array
    keys: np.ndarray

    @staticmethod
    def of(words: pa.Array, powers: Powers) -> tuple[_Known, np.ndarray]:
        """And where ``words`` were before."""
        pieces = _pieces(pa.record_batch([words], ["token"]), 0, FIT_BYTES)
        keys = np.concatenate([np.zeros(0, np.uint64), *(_keys(*flat_bytes(p.column(0)), powers) for p in pieces)])
        order = np.argsort(keys, kind="stable")
        return _Known(words.take(pa.array(order)), keys[order]), order

    def places(self, words: pa.Array, keys: np.ndarray) -> np.ndarray:
        """The place of each word, or -1; words that share a hash without being equal are looked up by themselves."""
        out = np.full(len(keys), -1)
        order = np.argsort(keys)  # following keys lie near each other
        at = np.searchsorted(self.keys, keys[order])
        held = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys[order]) if len(self.keys) else order[:0]
        at, word = at[held], order[held]
        same = pc.equal(self.words.take(pa.array(at)), words.take(pa.array(word))).to_numpy(zero_copy_only=False)
        out[word[same]] = at[same]
        if not same.all():
            other = word[~same]
            out[other] = pc.fill_null(pc.index_in(words.take(pa.array(other)), value_set=self.words), -1).to_numpy()
        return out


def _scored(shared, frequent, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, counts, *_) = shared.value, frequent.value
        powers, tails = Powers(_BASE), _Tails(model.codes, model.inside, len(known.words))
        below = total + 0.1 * (distinct + 1)
        for batch in batches:
            for piece in _pieces(batch, 2):
                texts = _Run.of(piece.column(2), powers)
                n, learned = piece.num_rows, piece.column(3).to_numpy(zero_copy_only=False)
                words = texts.distinct.cast(pa.string())
                place = known.places(words, texts.keys)
                found = place >= 0
                own = np.zeros(len(found), np.int64)
                own[found] = counts[place[found]]
                doc = np.repeat(np.arange(n), texts.per_doc)
                seen = found[texts.at]
                bits = model.first_bytes(texts) + model.later_bytes(texts.distinct, texts.at, texts.per_doc, place, tails)
                base = np.bincount(doc, np.where(seen, np.log10((own + 0.1) / below)[texts.at], 0), n)
                n_known = np.bincount(doc, seen, n).astype(np.int64)
                bytes_ = np.bincount(doc, pc.binary_length(words).to_numpy()[texts.at], n).astype(np.int64)
                # Words that are not among the frequent ones, with their number in the text.
                rare, times = np.unique(doc[~seen] * len(own) + texts.at[~seen], return_counts=True)
                rare_doc, rare_word = np.divmod(rare, max(len(own), 1))
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rare_doc, minlength=n)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(1), piece.column(3), pa.array(texts.per_doc), pa.array(n_known), pa.array(base),
                        pa.array(bits), pa.array(bytes_), pa.ListArray.from_arrays(bounds, words.take(pa.array(rare_word))),
                        pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64())),
                    ],
                    ["row", "doc_id", "learned", "n_tokens", "n_known", "base_score", "bits", "n_bytes", "rare", "times"],
                )

    return run


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, learned`` for each row of ``docs``.

    The model learns from rows for which ``learn`` holds (``learned``; null is false).  A text's tokens are its words,
    lower-cased in A-Z, and one end; ``n_known`` of them occur in the training texts, which have
    ``train_tokens``.  ``base_score`` is the log10 probability by single tokens with a tenth added to each count, ``score`` that
    of the same tokens by the mixing model, which spells unknown words.  ``bits_per_byte`` divides
    its code length by the bytes of the tokens, one separator each included.

    Each row is mixed online at all its decisions, whether it was learned from or not.  Counts of the most
    frequent words are broadcast; the others meet their rows in a join, in which only words of over
    ``HOT_BYTES`` bytes can be frequent.  Null texts count as empty: their only token is the end.  Rows without
    an id, or that repeat one, are rows of their own.  Other columns are not read.  An empty table gives an empty result;
    without training texts nothing is known and scores are those of the untrained model.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"),
    )
    texts = rows.filter("learned").select(F.col("doc_id").alias("id"), "text")
    counted = written(texts.select("text").mapInArrow(_counted, _COUNTED), "counted")
    words = written(counted.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = context.broadcast(fit(texts, words, counted.filter("token is null").select("table", "block", "counts")))
    least = _frequent(words.filter(F.octet_length("token") <= HOT_BYTES))
    frequent = (F.col("n") >= least) & (F.octet_length("token") <= HOT_BYTES)
    table = words.filter(frequent).toArrow().combine_chunks()
    if len(table):
        known, n = (column.combine_chunks() for column in table.columns)
    else:
        known, n = pa.array([], pa.string()), pa.array([], pa.int64())
    known, order = _Known.of(known.cast(pa.string()), Powers(_BASE))
    held = context.broadcast((known, n.to_numpy()[order]))
    found = rows.mapInArrow(
        _scored(shared, held, total, distinct),
        "row long, doc_id long, learned boolean, n_tokens long, n_known long, base_score double, bits double, n_bytes long, "
        "rare array<string>, times array<long>",
    )
    found = written(found, "scored")
    for done in (shared, held):
        done.destroy()
    rare = found.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("row", F.col("w.rare").alias("token"), F.col("w.times").alias("times"))
    rare = rare.join(words.filter(~frequent), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    below = float(total) + 0.1 * (distinct + 1)
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.log10((F.col("n") + 0.1) / F.lit(below)) * F.col("times")).alias("_base"),
    )
    out = found.drop("rare", "times").join(rare, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"), "learned",
    )

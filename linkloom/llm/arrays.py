"""Arrow columns as flat arrays, and rows of one key kept together while batches stream by."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once.  Temporary arrays hold eight bytes or more for each byte of it.
CHUNK_BYTES = 1 << 21


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and the rows' bounds in it; null is empty."""
    binary = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = binary.buffers()
    bounds = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    if data is None or not len(binary):
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs between ASCII blanks in ``data``, which ends of rows cut too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
    stops = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
    return starts, stops


def small_pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` cut by rows so that each piece has about ``CHUNK_BYTES`` of text.

    A longer text is a piece of its own.
    """
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows in the given order, cut only where one of ``keys`` changes.

    The input must hold the rows of a key next to each other.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
            if waiting:
                last = waiting[-1]
                change[0] |= last.column(last.schema.get_field_index(key))[-1].as_py() != values[0]
        at = np.flatnonzero(change)
        if not len(at):
            waiting.append(batch)
            continue
        cut = int(at[-1])
        waiting.append(batch.slice(0, cut))
        whole = [b for b in waiting if b.num_rows]
        if whole:
            yield pa.Table.from_batches(whole).combine_chunks()
        waiting = [batch.slice(cut)]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values, one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes from which a word is hashed by itself.
_LONG_WORD = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes after eight mixed in; long words have cryptographic ones.

    Unlike a polynomial in 64 bits it has no pairs of words that collide whatever its constants.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # at every place, so unaligned
    size = stops - starts
    out = mixed(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ (eight[starts] & _EIGHT[np.minimum(size, 8)]))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    more, skipped = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
    while len(more):
        block = eight[starts[more] + skipped] & _EIGHT[np.minimum(size[more] - skipped, 8)]
        out[more] = mixed(out[more] * np.uint64(0xD6E8FEB86659FD93) + block)
        skipped += 8
        more = more[size[more] > skipped]
    return out


class Powers:
    """Powers of a number and of its inverse in 64 bits, kept as far as they were needed."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.held = (np.ones(0, np.uint64),) * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            self.held = tuple(self._powers(b, n) for b in self.bases)
        return self.held[0][:n], self.held[1][:n]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


def running(values: np.ndarray) -> np.ndarray:
    """Sums of all beginnings of ``values`` in 64 bits, the empty one included."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


class Forest:
    """Disjoint sets of small integers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were in different sets until now."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links in ``a``, ``b`` that suffice to connect what all of them connect."""
    forest = Forest()
    join = forest.join
    return np.array([i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())) if join(x, y)], np.int64)

"""Alignment of two tokenizations: groups between common token ends, and how common their links are.

A byte range of a text yields a fragment: the tokens before its first common end (open prefix), the
closed groups between common ends, and the tokens after the last one (open suffix).  Composing two
fragments closes one group out of the left one's suffix and the right one's prefix.  That is
associative, so ranges of a very long text are tokenized by different tasks and composed as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import small_pieces, whole_groups
from linkloom.llm.tokens import VOCABULARIES, Pair, last_safe, next_safe, pair, safe_words, vocabularies
from linkloom.scratch import written

#: Code points of the ranges of a long text; a text of up to two ranges is handled whole.
RANGE = 1 << 16
#: Fragments that are composed by one task at a level of the tree.
FAN = 8
#: Words whose tokens a task remembers.
MEMO_WORDS = 1 << 18
#: Words that are encoded in one go.
ENCODED = 512
#: Links of a group that are listed one by one; larger groups are counted by id first.
LISTED_LINKS = 1 << 16
#: Id pairs that are broadcast with their counts, the most frequent ones (about 13 bytes each).
HOT_PAIRS = 1 << 20
#: Pairs that a task counts before it passes them on.
COUNTED = 1 << 21
#: Ids of the second vocabulary are below this; a pair of ids is one number.
_PAIR = 1 << 15

_FRAGMENT = (
    "n_a long, n_b long, n_groups long, n_links long, pairs array<int>, times array<long>, shown binary, "
    "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, cut boolean, usable boolean"
)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length`` of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id pairs of groups of ``n_a`` and ``n_b`` following tokens, how often, and of which group, in their order."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    listed = n_a * n_b <= LISTED_LINKS
    group = np.repeat(np.arange(len(n_a)), n_a)
    plain = listed[group]
    each = n_b[group[plain]]
    codes = np.repeat(a[plain] * _PAIR, each) + b[ragged(first_b[group[plain]], each)]
    times, of = np.ones(len(codes), np.int64), np.repeat(group[plain], each)
    if not listed.all():
        more = [(codes, times, of)]
        for g in np.flatnonzero(~listed):
            x, nx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            more.append(((x[:, None] * _PAIR + y).ravel(), (nx[:, None] * ny).ravel(), np.full(len(x) * len(y), g)))
        codes, times, of = map(np.concatenate, zip(*more))
        order = np.argsort(of, kind="stable")
        codes, times, of = codes[order], times[order], of[order]
    return codes, times, of


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, times
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[at], np.add.reduceat(times[order], at)


def _shown(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for p, q in zip(n_a.tolist(), n_b.tolist()):
        out.append(f"{','.join(x[i : i + p])}|{','.join(y[j : j + q])}".encode())
        i, j = i + p, j + q
    return out


@dataclass(frozen=True)
class Fragment:
    """What the tokens that end in a byte range yield, however the text goes on at both sides."""

    n_a: int = 0
    n_b: int = 0
    #: Closed groups: their number, links, id pairs with their counts, and text.
    n_groups: int = 0
    n_links: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shown: bytes = b""
    #: Ids before the first common end.
    head: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 2
    #: Ids after the last common end; all of them where there is none.
    tail: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 2
    #: Whether there is a common end.
    cut: bool = False
    #: Whether both vocabularies give back the bytes of the text.
    usable: bool = True

    @staticmethod
    def of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
        """The fragment of tokens (ids and growing byte offsets of their ends) of one range."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return Fragment(len(a), len(b), tail=(a, b))
        at_a, at_b = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        own_a, own_b = a[at_a[0] : at_a[-1]], b[at_b[0] : at_b[-1]]
        codes, times, _ = _links(own_a, own_b, n_a, n_b)
        pairs, times = _summed(codes, times)
        shown = b";".join(_shown(own_a, own_b, n_a, n_b))
        return Fragment(
            len(a), len(b), len(n_a), int((n_a * n_b).sum()), pairs, times, shown,
            (a[: at_a[0]], b[: at_b[0]]), (a[at_a[-1] :], b[at_b[-1] :]), True,
        )

    def __add__(self, other: Fragment) -> Fragment:
        both = replace(
            self, n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b, usable=self.usable and other.usable
        )
        joined = tuple(np.concatenate(ids) for ids in zip(self.tail, other.head if other.cut else other.tail))
        if not other.cut:
            return replace(both, tail=joined)
        if not self.cut:
            return replace(other, n_a=both.n_a, n_b=both.n_b, usable=both.usable, head=joined)
        closed = _group(*joined)
        pairs, times = _summed(
            np.concatenate((self.pairs, closed.pairs, other.pairs)), np.concatenate((self.times, closed.times, other.times))
        )
        return replace(
            both, n_groups=self.n_groups + closed.n_groups + other.n_groups,
            n_links=self.n_links + closed.n_links + other.n_links, pairs=pairs, times=times,
            shown=b";".join(s for s in (self.shown, closed.shown, other.shown) if s), tail=other.tail,
        )

    def whole(self) -> Fragment:
        """The fragment of a whole text, whose begin is a common end: the prefix is a group too."""
        return Fragment(cut=True) + self


def _group(a: np.ndarray, b: np.ndarray) -> Fragment:
    """A closed group of these tokens; no tokens are no group."""
    if not len(a) and not len(b):
        return Fragment()
    n_a, n_b = np.array([len(a)]), np.array([len(b)])
    pairs, times = _summed(*_links(a, b, n_a, n_b)[:2])
    return Fragment(n_groups=1, n_links=len(a) * len(b), pairs=pairs, times=times, shown=_shown(a, b, n_a, n_b)[0])


def range_fragment(encoders: Pair, text: str, low: int, high: int) -> Fragment:
    """The fragment of the tokens of space+``text`` that end behind byte ``low`` and up to ``high``."""
    ids = encoders.encode(text)
    if ids is None:
        return Fragment(usable=False)
    kept = []
    for own, lengths in zip(ids, (encoders.a_lengths, encoders.b_lengths)):
        ends = np.cumsum(lengths[own])
        inside = slice(*np.searchsorted(ends, (low, high), side="right"))
        kept += [own[inside], ends[inside]]
    return Fragment.of(*kept)


class _Memo:
    """Groups of words, each of which is a text of its own for both tokenizers (see ``SAFE``)."""

    def __init__(self, encoders: Pair):
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.sizes: list[np.ndarray] = []  # n_a, n_b, n_groups, links listed, usable
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def learn(self, words: list[str]) -> None:
        """Words that begin and end without a blank are encoded together, the others alone."""
        plain = [w for w in words if w and not (w[0].isspace() or w[-1].isspace() or "▁" in w)]
        for begin in range(0, len(plain), ENCODED):
            some = plain[begin : begin + ENCODED]
            if not self._add(some):
                for word in some:
                    self._add([word], True)
        held = set(plain)
        for word in words:
            if word not in held:
                self._add([word], True)

    def _add(self, words: list[str], alone: bool = False) -> bool:
        ids = self.encoders.encode(" ".join(words))
        if ids is None:
            if alone:
                self.place[words[0]] = len(self.place)
                self.shown.append(b"")
                self.sizes.append(np.zeros((1, 5), np.int64))
            return False
        a, b = ids
        a_ends, b_ends = np.cumsum(self.encoders.a_lengths[a]), np.cumsum(self.encoders.b_lengths[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        n_a = np.diff(np.searchsorted(a_ends, common) + 1, prepend=0)
        n_b = np.diff(np.searchsorted(b_ends, common) + 1, prepend=0)
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        of = np.searchsorted(word_ends, common)  # the word of each group
        codes, times, group = _links(a, b, n_a, n_b)
        sizes = np.ones((len(words), 5), np.int64)
        for i, counts in enumerate((n_a, n_b, np.ones(len(of)), np.bincount(group, minlength=len(of)))):
            sizes[:, i] = np.bincount(of, counts, len(words))
        shown, bounds = _shown(a, b, n_a, n_b), np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        first = len(self.place)
        for i, word in enumerate(words):
            self.place[word] = first + i
            self.shown.append(b";".join(shown[bounds[i] : bounds[i + 1]]))
        self.sizes.append(sizes)
        self.pairs.append(codes)
        self.times.append(times)
        return True

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for name in ("sizes", "pairs", "times"):
            held = getattr(self, name)
            setattr(self, name, [np.concatenate(held)] if held else [])
        nothing = np.zeros(0, np.int64)
        return (
            self.sizes[0] if self.sizes else np.zeros((0, 5), np.int64),
            self.pairs[0] if self.pairs else nothing, self.times[0] if self.times else nothing,
        )


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def _whole_texts(files: tuple[bytes, bytes]):
    """Of each text, cut into words at safe spaces: sizes, digest and id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(pair(*files))
        for batch in batches:
            for piece in small_pieces(batch, "text"):
                yield _aligned(piece, memo)

    return run


def _aligned(batch: pa.RecordBatch, memo: _Memo) -> pa.RecordBatch:
    words = [safe_words(t) if t else [] for t in batch.column(2).to_pylist()]
    if len(memo.place) > MEMO_WORDS:
        memo.clear()
    flat = list(chain.from_iterable(words))
    place = memo.place
    new = [w for w in dict.fromkeys(flat) if w not in place]
    memo.learn(new)
    at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    sizes, pairs, times = memo.arrays()
    n_words = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(words)), n_words)
    ends = np.cumsum(n_words)
    n = len(words)
    usable = (np.bincount(doc, sizes[at, 4] == 0, n) == 0) & (n_words > 0)
    totals = [(np.bincount(doc, sizes[at, i], n).astype(np.int64)) * usable for i in range(3)]
    # The id pairs of all words of a document, counted once with their number.
    kept = usable[doc]
    listed = sizes[at[kept], 3]
    first = np.cumsum(sizes[:, 3]) - sizes[:, 3]
    places = ragged(first[at[kept]], listed)
    codes, counts = _summed((np.repeat(doc[kept], listed) << 32) | pairs[places], times[places])
    own = codes >> 32
    links = np.bincount(own, counts, n).astype(np.int64)
    shown, digests = memo.shown, []
    for i, end in enumerate(ends.tolist()):
        mine = at[end - len(words[i]) : end].tolist()
        digests.append(hashlib.sha256(b";".join([shown[j] for j in mine])).hexdigest() if usable[i] else "")
    per_doc = np.bincount(own, minlength=n)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0), batch.column(1), *map(pa.array, totals), pa.array(links), pa.array(digests, pa.string()),
            _lists((codes & 0xFFFFFFFF).astype(np.int32), per_doc, pa.int32()), _lists(counts, per_doc, pa.int64()),
        ],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def ranges(text: str, size: int) -> Iterator[tuple[str, int, int]]:
    """``text`` as byte ranges: what to encode for each, and which ends in it (bytes) are the range's own.

    A range ends wherever it does, within a token too; what is encoded reaches from the safe space
    before it to the one after it.  A range that meets no safe space for its whole size is longer.
    """
    full = " " + text
    begin, cuts = 0, [0]  # the last safe spaces known
    while begin < len(full):
        end = min(begin + size, len(full))
        stop = next_safe(full, end) if end < len(full) else end
        if stop - end > size:
            end = stop
        start = max(c for c in cuts if c <= begin)
        cuts = [start, last_safe(full, start + 1, end), stop]
        low, high = len(full[start:begin].encode()), len(full[start:end].encode())
        yield full[start + 1 : stop], low, high
        begin = end


def _long_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, (piece, low, high) in enumerate(ranges(text, size)):
                    values = ([row], [doc], [no], [piece], [low], [high])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    columns = [pa.array(v, k) for v, k in zip(values, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "no", "piece", "low", "high"])

    return run


def _fragment_rows(keys: list[tuple], found: list[Fragment]) -> pa.RecordBatch:
    def ids(values: list[np.ndarray]) -> pa.Array:
        return pa.array([v.astype(np.int32) for v in values], pa.list_(pa.int32()))

    numbers = [pa.array([getattr(f, n) for f in found], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    columns = [
        *(pa.array(list(k), pa.int64()) for k in zip(*keys)), *numbers, ids([f.pairs for f in found]),
        pa.array([f.times for f in found], pa.list_(pa.int64())), pa.array([f.shown for f in found], pa.binary()),
        *(ids([end[i] for end in (getattr(f, part) for f in found)]) for part in ("head", "tail") for i in (0, 1)),
        pa.array([f.cut for f in found]), pa.array([f.usable for f in found]),
    ]
    names = ["row", "doc_id", "no", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "shown"]
    return pa.RecordBatch.from_arrays(columns, [*names, "head_a", "head_b", "tail_a", "tail_b", "cut", "usable"])


def _read_fragments(table: pa.Table) -> list[tuple[tuple, Fragment]]:
    def ids(values) -> np.ndarray:
        return np.array(values, np.int64)

    return [
        (
            (r["row"], r["doc_id"], r["no"]),
            Fragment(
                r["n_a"], r["n_b"], r["n_groups"], r["n_links"], ids(r["pairs"]), ids(r["times"]), r["shown"],
                (ids(r["head_a"]), ids(r["head_b"])), (ids(r["tail_a"]), ids(r["tail_b"])), r["cut"], r["usable"],
            ),
        )
        for r in table.to_pylist()
    ]


def _fragments(files: tuple[bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = pair(*files)
        for batch in batches:
            for row, doc, no, piece, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                yield _fragment_rows([(row, doc, no)], [range_fragment(encoders, piece, low, high)])

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Following fragments of a text, those of one ``branch``, as one."""
    for table in whole_groups(batches, ["row", "branch"]):
        held: dict[tuple, list[Fragment]] = {}
        branches = table.column("branch").to_pylist()
        for branch, ((row, doc, _), fragment) in zip(branches, _read_fragments(table)):
            held.setdefault((row, doc, branch), []).append(fragment)
        yield _fragment_rows(list(held), [reduce(Fragment.__add__, own) for own in held.values()])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (row, doc, _), found in _read_fragments(pa.Table.from_batches([batch])):
            found = found.whole()
            if not found.usable:
                found = Fragment()
            columns = [
                pa.array([row], pa.int64()), pa.array([doc], pa.int64()),
                *(pa.array([n], pa.int64()) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                pa.array([hashlib.sha256(found.shown).hexdigest() if found.n_a else ""], pa.string()),
                pa.array([found.pairs.astype(np.int32)], pa.list_(pa.int32())), pa.array([found.times], pa.list_(pa.int64())),
            ]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            yield pa.RecordBatch.from_arrays(columns, names)


_ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<int>, times array<long>"
)


def align(docs: DataFrame, folder: str = VOCABULARIES, size: int = RANGE) -> DataFrame:
    """One row for each of ``docs``: sizes, digest of the groups, and ``pairs`` linked in it with ``times``.

    Texts of up to two ranges of ``size`` code points are one task's work.  Ranges of longer ones are
    dealt to all tasks and their fragments composed as a tree of ``FAN`` branches, one written
    table a level.
    """
    files = vocabularies(folder)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > 2 * size
    short = written(rows.filter(~is_long).mapInArrow(_whole_texts(files), _ALIGNED), "aligned")
    pieces = "row long, doc_id long, no long, piece string, low long, high long"
    cut = rows.filter(is_long).mapInArrow(_long_texts(size), pieces)
    found = cut.repartition("row", "no").mapInArrow(_fragments(files), f"row long, doc_id long, no long, {_FRAGMENT}")
    found = written(found, "fragments")
    last = found.agg(F.max("no")).first()[0] or 0
    while last:
        last //= FAN
        dealt = found.withColumn("branch", F.floor(F.col("no") / FAN)).repartition("row", "branch")
        dealt = dealt.sortWithinPartitions("row", "branch", "no")
        found = written(dealt.mapInArrow(_composed, f"row long, doc_id long, no long, {_FRAGMENT}"), "fragments")
    return short.unionByName(found.mapInArrow(_ended, _ALIGNED))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, waiting = [], 0

    def rows() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n, pa.int64())], ["pair", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        waiting += len(held[-1])
        if waiting >= COUNTED:
            yield rows()
            held, waiting = [], 0
    if waiting:
        yield rows()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many rows of ``aligned`` hold a pair, and whether its first id has none above it."""
    counts = aligned.select("pairs").mapInArrow(_counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", _PAIR.bit_length() - 1)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count from which at most ``most`` pairs count as frequent: found on sums by power of two."""
    steps = counts.groupBy(F.floor(F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, None
    for step, n in steps:
        held += n
        if held > most:
            break
        least = 1 << step
    return least if least is not None else (1 << 62)


def _looked_up(frequent) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = frequent.value
        for batch in batches:
            kept = batch.num_columns - 2
            lists, times = batch.column(kept), batch.column(kept + 1).flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at, times_found, row_found = at[found], times[found], row[found]
            count_sum, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count_sum, row_found, n[at] * times_found)
            np.add.at(n_best, row_found, best[at] * times_found)
            rest = np.bincount(row[~found], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:kept], pa.array(n_best), pa.array(count_sum),
                    _lists(pairs[~found], rest, pa.int32()), _lists(times[~found], rest, pa.int64()),
                ],
                [*batch.schema.names[:kept], "n_best", "count_sum", "pairs", "times"],
            )

    return run


def links(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its pairs.

    The counts of the most frequent pairs, at most ``hot_pairs`` of them, are broadcast; rows meet
    the others by a join on the pair, which by then is one that few rows hold.
    """
    counts = pair_counts(aligned)
    least = _frequent(counts, hot_pairs)
    table = counts.filter(F.col("n") >= least).toArrow()
    pairs, n, best = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3)) if len(table) else (np.zeros(0, np.int64),) * 3
    order = np.argsort(pairs)
    spark = aligned.sparkSession
    frequent = spark.sparkContext.broadcast((pairs[order], n[order], best[order].astype(np.int64)))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = aligned.select(*kept, "pairs", "times").mapInArrow(
        _looked_up(frequent), f"{kinds}, n_best long, count_sum long, pairs array<int>, times array<long>"
    )
    found = written(found, "links")
    rest = found.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    rest = rest.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    rest = rest.join(counts.filter(F.col("n") < least), "pair").groupBy("row")
    rest = rest.agg(
        F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("_best")
    )
    out = found.drop("pairs", "times").join(rest, "row", "left")
    return out.select(
        *kept[1:], (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def alignment(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for each row of ``docs``.

    A text is encoded as space+text by both vocabularies in ``folder``.  Byte offsets at which tokens
    of both end cut them into groups; all token pairs of a group are links.  A pair's count is the
    number of rows that hold it linked; ``n_best`` counts links whose pair has the highest count
    of its first id, ``count_sum`` adds the counts over all links.

    Null and empty texts, and those whose bytes either vocabulary doesn't give back, have zeros and
    an empty digest.  Rows without an id and rows that repeat one are rows of their own, and count
    as documents each.  Other columns are not read.  An empty table gives an empty result.
    """
    return links(align(docs, folder))

"""Line deduplication: an exact set-similarity join on lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import flat_bytes, mixed, running, small_pieces, word_hashes, word_ranges
from linkloom.scratch import written

WORDS = 5
#: Jaccard similarity as a fraction: exact in integers.
SIMILAR = (4, 5)
#: Cells of the table of token counts that orders tokens by rarity (four bytes each).  It is a
#: fixed size for any input: tokens share a cell when there are more, which costs some speed.
RARITY_BITS = 16
#: Tokens of prefixes that one task joins.
TASK_TOKENS = 1 << 18
#: Lines of one token that are compared in one go.  A token counted more often is cut into blocks.
BLOCK_LINES = 1 << 14
#: Bits that tell which texts are wanted (2 MiB at most), in maps of 32,768 each.  It is a fixed size for
#: any input: texts share a bit when there are more, and then some are moved that nothing joins.
KEY_BITS, _MAP_BITS = 24, 15

_BASE = 0x9E3779B97F4A7C15


class Cut(NamedTuple):
    """How texts are cut into lines and lines into tokens of ``words`` following words."""

    words: int = WORDS
    #: Whether a line of fewer words is one token; otherwise it holds none.
    short: bool = False
    #: Whether a text is one line, and A-Z in it count as lower case.
    whole: bool = False


class _Lines:
    """The lines of some texts as sets of hashed tokens, rarest token first.

    ``doc`` and ``number`` have an entry for each line; ``tokens`` holds the sets one after
    the other with ``bounds`` between them.
    """

    def __init__(self, texts: pa.Array, cut: Cut, rank: np.ndarray | None = None):
        data, bounds = flat_bytes(texts)
        if cut.whole:
            data = data | ((data - np.uint8(65) < 26) << 5).astype(np.uint8)
        starts, stops = word_ranges(data, bounds)
        # A line ends at each break and at each end of a text.
        breaks = np.flatnonzero((data == 10) & (not cut.whole))
        doc_of_break = np.searchsorted(bounds, breaks, side="right") - 1
        per_doc = np.bincount(doc_of_break, minlength=len(texts)) + 1
        self.doc = np.repeat(np.arange(len(texts)), per_doc)
        first = np.cumsum(per_doc) - per_doc
        self.number = np.arange(len(self.doc)) - np.repeat(first, per_doc)
        # A word's line: breaks and ends of texts before it.
        line = np.searchsorted(breaks, starts) + np.searchsorted(bounds[1:], starts, side="right")
        token, token_line = self._shingles(word_hashes(data, starts, stops), line, cut)
        if rank is None:
            self.tokens = token
            return
        # As sets: by line, then by rarity, then by value; repeats go.
        order = self._order(token, token_line, rank)
        token, token_line = token[order], token_line[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (token_line[1:] != token_line[:-1])
        self.tokens, token_line = token[keep], token_line[keep]
        self.bounds = np.searchsorted(token_line, np.arange(len(self.doc) + 1))

    @staticmethod
    def _order(token: np.ndarray, line: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """By line, rank of the token's cell, token: in one sort where a 64-bit key tells all apart."""
        cell = rank[token >> np.uint64(64 - RARITY_BITS)]
        rest = 64 - 20 - RARITY_BITS
        if line.max(initial=0) < 1 << 20:
            low = token & np.uint64((1 << rest) - 1)
            key = line.astype(np.uint64) << np.uint64(44) | cell << np.uint64(rest) | low
            order = np.argsort(key)
            key, sorted_token = key[order], token[order]
            if not ((key[1:] == key[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any():
                return order
        return np.lexsort((token & np.uint64((1 << 63) - 1), token & np.uint64((1 << rest) - 1), cell, line))

    @staticmethod
    def _shingles(word: np.ndarray, line: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``cut.words`` following words of a line, and of shorter lines if they count."""
        width = cut.words
        m = max(0, len(word) - width + 1)
        whole = np.flatnonzero(line[:m] == line[width - 1 :])
        token = np.zeros(len(whole), np.uint64)
        for k in range(width):
            token = token * np.uint64(_BASE) + word[whole + k]
        if not cut.short:
            return mixed(token), line[whole]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n = np.diff(first, append=len(line))
        first, n = first[n < width], n[n < width]
        all_of_it = n.astype(np.uint64)
        for k in range(width - 1):
            longer = n > k
            all_of_it[longer] = all_of_it[longer] * np.uint64(_BASE) + word[first[longer] + k]
        return mixed(np.concatenate((token, all_of_it))), line[np.concatenate((whole, first))]

    def set_hashes(self) -> np.ndarray:
        """One 64-bit value for each line's set: equal for equal sets in any order."""
        total = running(mixed(self.tokens ^ np.uint64(_BASE)))
        return mixed(total[self.bounds[1:]] - total[self.bounds[:-1]]).view(np.int64)


def _needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least overlap of sets of ``x`` and ``y`` tokens that are similar: ceil(t/(1+t) (x+y))."""
    top, low = SIMILAR
    return -((x + y) * top // -(top + low))


def _rarity_cells(docs: DataFrame, cut: Cut) -> np.ndarray:
    """How many tokens of all lines fall in each cell; ``2**RARITY_BITS`` counts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for piece in small_pieces(batch, "text"):
                tokens = _Lines(piece.column(0), cut).tokens
                counts += np.bincount((tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    summed = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(1 << RARITY_BITS, np.int64)
    for row in summed.collect():  # bounded by the number of cells
        cells[row.cell] = row.n
    return cells


def _ranks(rarity: np.ndarray) -> np.ndarray:
    """Cells in the order of their counts."""
    rank = np.empty(len(rarity), np.uint64)
    rank[np.argsort(rarity, kind="stable")] = np.arange(len(rarity), dtype=np.uint64)
    return rank


#: What a packed row holds of each posting: columns one after the other.
_POSTING = {"token": "<u8", "set": "<i8", "size": "<i4", "place": "<i4", "meet": "<i8"}
_PACKED = "task int, postings binary"


_HELD = "doc_id long, text_key long, line_no int, line_set long, sets binary"


def _lines_and_sets(rank: np.ndarray, cut: Cut):
    """Rows of two sorts, as each text is cut but once.

    A row for each line that holds tokens, or for each text that is one line; and, with ``sets``,
    the distinct sets among some texts with the tokens of their prefixes, which say less than
    postings: a set stands there once and not with each token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, seen = [], np.zeros(0, np.int64)
            for piece in small_pieces(batch, "text"):
                lines = _Lines(piece.column(2), cut, rank)
                size, all_sets = np.diff(lines.bounds), lines.set_hashes()
                used = np.flatnonzero((size > 0) | cut.whole)
                doc = pa.array(lines.doc[used])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(doc), piece.column(1).take(doc), pa.array(lines.number[used].astype(np.int32)),
                        pa.array(all_sets[used]), pa.nulls(len(used), pa.binary()),
                    ],
                    ["doc_id", "text_key", "line_no", "line_set", "sets"],
                )
                sets, place = np.unique(all_sets, return_index=True)
                fresh = (size[place] > 0) & ~np.isin(sets, seen)
                sets, place = sets[fresh], place[fresh]
                seen = np.concatenate((seen, sets))
                row, at = _prefixes(size[place])
                made.append((sets, size[place].astype("<i8"), lines.tokens[lines.bounds[place][row] + at]))
                if sum(len(tokens) for _, _, tokens in made) >= TASK_TOKENS:
                    yield _sets_row(made)
                    made, seen = [], np.zeros(0, np.int64)
            if made:
                yield _sets_row(made)

    return run


def _prefixes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set and the place of each prefix token of sets of ``size`` tokens, one set after the other.

    A similar set holds ceil(t * size) of the tokens, so one of the first ones.
    """
    top, low = SIMILAR
    prefix = size + (size * top) // -low + 1
    row = np.repeat(np.arange(len(size)), prefix)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)


def _sets_row(made: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row of sets, their sizes and the tokens of their prefixes, behind the number of sets."""
    sets, size, tokens = (np.concatenate(parts) for parts in zip(*made))
    blob = len(sets).to_bytes(8, "little") + sets.tobytes() + size.tobytes() + tokens.tobytes()
    nothing = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([*nothing, pa.array([blob], pa.binary())], ["doc_id", "text_key", "line_no", "line_set", "sets"])


def _dealt(rarity: np.ndarray, tasks: int):
    """For each task packed rows of the postings of sets, which are the last column (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(batch.num_columns - 1).drop_null().to_pylist():
                n = int.from_bytes(blob[:8], "little")
                sets, size = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i8", n, 8 + 8 * n)
                row, at = _prefixes(size)
                out = {"token": np.frombuffer(blob, "<u8", len(row), 8 + 16 * n), "set": sets[row], "size": size[row], "place": at}
                yield _packed({name: values.astype(_POSTING[name]) for name, values in out.items()}, rarity, tasks)

    return run


def _packed(out: dict[str, np.ndarray], rarity: np.ndarray, tasks: int) -> pa.RecordBatch:
    """A row for each task with its postings."""
    # Tokens that may be frequent are cut into blocks, which meet pair by pair.
    count = rarity[out["token"] >> np.uint64(64 - RARITY_BITS)]
    blocks = np.maximum(1, -(count // -(BLOCK_LINES << 6))).astype(np.int64)
    own = (mixed(out["set"].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    if blocks.max(initial=1) > 1:
        other = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        out, own = {name: np.repeat(v, blocks) for name, v in out.items()}, np.repeat(own, blocks)
    else:
        other = own
    out["meet"] = np.minimum(own, other) * 1_000_003 + np.maximum(own, other)
    spread = out["token"] + mixed(out["meet"].view(np.uint64))
    task = (mixed(spread) % np.uint64(tasks)).astype(np.int32)
    order = np.argsort(task, kind="stable")
    out = {name: v[order] for name, v in out.items()}
    ends = np.searchsorted(task[order], np.arange(tasks + 1))
    filled = np.flatnonzero(np.diff(ends))
    packed = [b"".join(out[n][ends[t] : ends[t + 1]].tobytes() for n in _POSTING) for t in filled]
    return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(packed, pa.binary())], ["task", "postings"])


def _unpacked(packed: bytes) -> dict[str, np.ndarray]:
    n = len(packed) // sum(np.dtype(t).itemsize for t in _POSTING.values())
    out, at = {}, 0
    for name, kind in _POSTING.items():
        out[name] = np.frombuffer(packed, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a prefix token with others and pass the length and positional filters.

    A row for each token and set, not for each pair: which of a group are compared comes later.
    """
    by_task: dict[int, list] = {}
    for batch in batches:
        for task, postings in zip(*(c.to_pylist() for c in batch.columns)):
            by_task.setdefault(task, []).append(postings)
    for task in list(by_task):
        parts = [_unpacked(p) for p in by_task.pop(task)]
        rows = {name: np.concatenate([p[name] for p in parts]) for name in _POSTING}
        # Most tokens stand in one set alone; these go before the rest is put in order.
        _, inverse, count = np.unique(rows["token"], return_inverse=True, return_counts=True)
        several = count[inverse] > 1
        rows = {name: v[several] for name, v in rows.items()}
        order = np.lexsort((rows["set"], rows["size"], rows["meet"], rows["token"]))
        rows = {name: v[order] for name, v in rows.items()}
        meet = rows["meet"]
        group = np.ones(len(meet), bool)
        group[1:] = (rows["token"][1:] != rows["token"][:-1]) | (meet[1:] != meet[:-1])
        keep = group.copy()
        keep[1:] |= rows["set"][1:] != rows["set"][:-1]  # a set that several batches held
        group = np.cumsum(group)
        rows, group = {name: v[keep] for name, v in rows.items()}, group[keep]
        size, place, sets = rows["size"].astype(np.int64), rows["place"].astype(np.int64), rows["set"]
        partner = np.zeros(len(sets), bool)
        at, step = np.arange(len(sets)), 1
        while len(at):
            at = at[at + step < len(sets)]
            to = at + step
            # Sorted by size: once a set is too long for a shorter one, so are all later ones.
            near = (group[at] == group[to]) & _similar_sizes(size[at], size[to])
            at, to = at[near], to[near]
            good = _reachable(size[at], place[at], size[to], place[to])
            partner[at[good]] = partner[to[good]] = True
            step += 1
        named = mixed(rows["token"] + mixed(rows["meet"].view(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(named[partner]), pa.array(sets[partner]), pa.array(rows["size"][partner]), pa.array(rows["place"][partner])],
            ["group", "line_set", "size", "at"],
        )


def _similar_sizes(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return longer * SIMILAR[0] <= shorter * SIMILAR[1]


def _reachable(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` tokens that share places ``i`` and ``j`` can be similar."""
    return 1 + np.minimum(x - i - 1, y - j - 1) >= _needed(x, y)


def _key_place() -> Column:
    """The bit of a text's id and key."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), "text_key"), 64 - KEY_BITS)


def _key_bits(keys: DataFrame) -> np.ndarray:
    """One bit for each place of ``keys`` (``doc_id``, ``text_key``); ``2**KEY_BITS`` at most."""
    place = _key_place()
    maps = keys.select(F.shiftright(place, _MAP_BITS).alias("map"), place.bitwiseAND((1 << _MAP_BITS) - 1).alias("bit"))
    bits = np.zeros(1 << KEY_BITS - 3, np.uint8)
    size = 1 << _MAP_BITS - 3
    for row in maps.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # bounded by the number of maps
        bits[row.map * size : (row.map + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits


def _compressed(bits: np.ndarray):
    """The third column, texts, in compressed form: they are moved but once, and only if their place's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            place = batch.column(3).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)))
            packed = [press((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "text_key", "packed"]
            )

    return run


def moved_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, text_key, packed`` of the rows of ``texts`` that ``keys`` may hold: those, and few others."""
    placed = texts.select("doc_id", "text_key", "text", _key_place().alias("place"))
    return placed.mapInArrow(_compressed(_key_bits(keys)), "doc_id long, text_key long, packed binary")


def _tokens_of(rank: np.ndarray, cut: Cut):
    """The tokens of chosen lines, packed; the second column has the lines' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = pa.array([plain(t).decode() for t in batch.column(0).to_pylist()], pa.string())
            batch = pa.RecordBatch.from_arrays([texts, batch.column(1)], ["text", "wanted"])
            for piece in small_pieces(batch, "text"):
                lines = _Lines(piece.column(0), cut, rank)
                first = np.searchsorted(lines.doc, np.arange(piece.num_rows))
                numbers = piece.column(1)
                text = np.repeat(np.arange(piece.num_rows), pc.list_value_length(numbers).to_numpy())
                at = first[text] + numbers.flatten().to_numpy()
                packed = [lines.tokens[lines.bounds[i] : lines.bounds[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.set_hashes()[at]), pa.array(packed, pa.binary())], ["line_set", "tokens"]
                )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0]
        keep = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(2).take(keep), batch.column(3).take(keep)], ["a", "b"])


def may_match(x: str, y: str) -> str:
    """SQL: the length and positional filters on the members ``x`` and ``y`` of a group."""
    top, low = SIMILAR
    return (
        f"{x}.size * {top} <= {y}.size * {low} and {y}.size * {top} <= {x}.size * {low} and "
        f"least({x}.size - {x}.at, {y}.size - {y}.at) * {top + low} >= ({x}.size + {y}.size) * {top}"
    )


class SetGroups(NamedTuple):
    """The lines of a table as sets of tokens, and groups in which similar sets meet."""

    #: ``doc_id, text_key, line_no, line_set`` for each line.
    lines: DataFrame
    #: ``line_set, place, n``: the first place and the number of each distinct set.
    firsts: DataFrame
    #: ``group, line_set, size, at, place, n``: two similar sets meet in a group at least.
    members: DataFrame
    #: ``line_set, tokens`` of the members.
    tokens: DataFrame

    def tried(self) -> DataFrame:
        """``a, b``: each member with an earlier one, the earliest or the most frequent of its group."""
        member = F.struct("line_set", "size", "at", "place")
        hubs = self.members.groupBy("group").agg(
            F.min_by(member, "place").alias("first"), F.max_by(member, F.struct("n", "line_set")).alias("frequent")
        )
        hubs = hubs.select("group", F.explode(F.array("first", "frequent")).alias("y"))
        pairs = self.members.alias("x").join(hubs, "group").filter("y.place < x.place and " + may_match("x", "y"))
        return pairs.select(F.col("x.line_set").alias("a"), F.col("y.line_set").alias("b"))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (``a, b``) whose whole sets are similar, each once."""
        sets_a = self.tokens.select(F.col("line_set").alias("a"), F.col("tokens").alias("x"))
        sets_b = self.tokens.select(F.col("line_set").alias("b"), F.col("tokens").alias("y"))
        whole = pairs.select("a", "b").distinct().join(sets_a, "a").join(sets_b, "b").select("x", "y", "a", "b")
        return whole.mapInArrow(_verified, "a long, b long")


def set_groups(docs: DataFrame, cut: Cut, again: bool = False) -> SetGroups:
    """Sets of the lines of ``docs`` (``doc_id``, ``text``), by the prefix, length and positional filters.

    Sets with their prefixes are written with the lines, or, to keep less in the scratch folder, made ``again`` in a second pass.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    rarity = _rarity_cells(texts, cut)
    rank = _ranks(rarity)
    tasks = max(1, int(rarity.sum()) // 4 // TASK_TOKENS + 1)
    cut_up, dealt = _lines_and_sets(rank, cut), _dealt(rarity, tasks)
    held = texts.mapInArrow(cut_up, _HELD)
    held = held if again else written(held, "lines")
    lines = held.filter("sets is null").select("doc_id", "text_key", "line_no", "line_set")
    lines = written(lines, "lines") if again else lines
    place = F.struct("doc_id", "text_key", "line_no")
    firsts = lines.groupBy("line_set").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    firsts = written(firsts, "line-sets")

    # In one call, as two chained ones would hold two Python workers for a task.
    packed = texts.mapInArrow(lambda batches: dealt(cut_up(batches)), _PACKED) if again else (
        held.filter("sets is not null").select("sets").mapInArrow(dealt, _PACKED)
    )
    members = packed.repartitionById(tasks, F.col("task")).mapInArrow(_candidates, "group long, line_set long, size int, at int")
    members = written(members.join(firsts, "line_set"), "line-groups")

    # Whole sets of the candidates, from the documents that hold them first.
    wanted = members.select("line_set", "place").distinct().groupBy("place.doc_id", "place.text_key")
    wanted = written(wanted.agg(F.collect_list("place.line_no").alias("wanted")), "line-wanted")  # lines of one text
    # A merge join, as a broadcast one would chain two Python workers in a task.
    holders = moved_texts(texts, wanted).alias("t").join(
        wanted.hint("merge").alias("w"),
        F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key")),
    )
    tokens = holders.select("packed", "wanted").mapInArrow(_tokens_of(rank, cut), "line_set long, tokens binary")
    # Rows that agree in id and text hold the same.
    tokens = written(tokens.groupBy("line_set").agg(F.first("tokens").alias("tokens")), "line-tokens")
    return SetGroups(lines, firsts, members, tokens)


def repeated_lines(docs: DataFrame, words: int = WORDS, short: bool = True, again: bool = False) -> DataFrame:
    """Lines that repeat an earlier one: ``doc_id, text_key, line_no, match_doc_id, match_line_no``.

    A line is what stands between line breaks; its tokens are the distinct sequences of ``words``
    following words (cut at ASCII blanks, case kept).  A line of fewer words is one token; without
    ``short`` it holds none and is never a copy.  Nor is a blank line.  A line goes if an
    earlier line, by (``doc_id``, text, line number), has the same tokens or a Jaccard similarity
    of 0.8 or more to it, whether or not that line stays.  The match is one such line, the first
    with the same tokens unless only others are similar.

    Lines with equal token sets are one node.  Nodes meet at the rarest tokens of their sets
    (prefix filter) and pass the length and positional filters.  Each member of a group is first
    verified on whole sets against two of it, the earliest and the most frequent; only those that
    match neither are compared with all earlier members, so that copies make no pairs.
    ``text_key`` is the hash of the text: rows that agree in id and text are one document, and
    what is said of it holds for each.  Null ids come before others; null texts have no lines.
    """
    sets = set_groups(docs, Cut(words, short), again)
    lines, firsts, members = sets.lines, sets.firsts, sets.members

    def matches(pairs: DataFrame) -> DataFrame:
        """Of pairs of a set and an earlier one: sets with the place of the first similar one."""
        other = firsts.select(F.col("line_set").alias("b"), F.col("place").alias("other"))
        return sets.similar(pairs).join(other, "b").groupBy(F.col("a").alias("line_set")).agg(F.min("other").alias("other"))

    found = written(matches(sets.tried()), "line-matches")
    rest = members.join(found, "line_set", "left_anti")
    others = rest.alias("x").join(members.alias("y"), "group").filter("y.place < x.place and " + may_match("x", "y"))
    found = found.union(matches(others.select(F.col("x.line_set").alias("a"), F.col("y.line_set").alias("b"))))

    place = F.struct("doc_id", "text_key", "line_no")
    first = firsts.join(found, "line_set", "left").select("line_set", "place", F.coalesce("other", "place").alias("match"))
    same = F.col("place") < place
    match = F.when(same, F.col("place")).otherwise(F.col("match"))
    return lines.join(first, "line_set").filter(same | (F.col("match") < place)).select(
        "doc_id", "text_key", "line_no", match["doc_id"].alias("match_doc_id"), match["line_no"].alias("match_line_no")
    )


def drop_repeated_lines(docs: DataFrame, words: int = WORDS, short: bool = True) -> DataFrame:
    """``docs`` with the lines of :func:`repeated_lines` cut from ``text``; ``n_chars`` follows.

    All columns and rows stay but those of texts that lose every line.  A text without a repeated
    line, also null or empty, stays as it is.
    """
    gone = repeated_lines(docs, words, short, again=True).groupBy("doc_id", "text_key").agg(F.collect_list("line_no").alias("gone"))
    d, g = docs.alias("d"), gone.alias("g")
    key = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    kept = F.filter(F.split("d.text", "\n"), lambda line, i: ~F.array_contains(F.col("g.gone"), i))
    joined = d.join(g, key, "left").filter(F.col("g.gone").isNull() | (F.size(kept) > 0))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("g.gone").isNull(), F.col("d.n_chars")).otherwise(F.length(text))
    return joined.select(*[changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])

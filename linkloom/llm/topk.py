"""Exact top-k search with an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.vectors import matrix, usable
from linkloom.scratch import written

#: Rows of an index block and queries that meet it in one task.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Quantised impacts of a component.
LEVELS = 8
#: The search ends once all but this part of a block is excluded by proof.
SHARE = 64
#: Between two looks at the bounds, what can still be added falls to this share of itself.
LOOK = 0.85
#: Components of rows and queries that whole 64-bit numbers hold with room to spare; vectors with
#: larger ones are scored in long arithmetic, outside of the index.
_NARROW = 2.0**44


class _Index:
    """Postings of each component by value, cut into segments of one quantised impact."""

    def __init__(self, x: np.ndarray):
        self.x, self.floats = x, x.astype(float)
        n, dims = x.shape
        self.low, self.high = (x.min(axis=0), x.max(axis=0)) if n else (np.zeros(dims, int), np.zeros(dims, int))
        step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        self.rows = np.argsort(x, axis=0, kind="stable").T.copy()
        held = np.take_along_axis(self.floats.T, self.rows, axis=1)
        #: Postings of all components one after the other: rows, and how far values lie over the least or under the largest.
        self.flat_rows, self.over, self.under = self.rows.ravel(), (held - self.low[:, None]).ravel(), (held - self.high[:, None]).ravel()
        level = np.take_along_axis(((x - self.low) // step).T, self.rows, axis=1)
        #: Where the segments of a component begin in its postings, the end included.
        self.cuts = np.stack([np.searchsorted(h, np.arange(LEVELS + 1)) for h in level]) if dims else np.zeros((0, LEVELS + 1), int)
        self.flat_cuts = (self.cuts + np.arange(dims)[:, None] * n).tolist()
        # Smallest and largest value of each segment's quantised range.
        self.first = np.minimum(self.low[:, None] + step[:, None] * np.arange(LEVELS), self.high[:, None])
        self.last = np.minimum(self.first + step[:, None] - 1, self.high[:, None])
        self.largest = float(np.abs(x).max(initial=0))

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole scores; in floats only where they are exact."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**52:
            return (self.floats[rows] @ q.astype(float)).astype(np.int64)
        return _held(self.x[rows].astype(object) @ q.astype(object))

    def _add(self, added: np.ndarray, taken: dict[int, list[int]], q: list[float]) -> None:
        """Adds the impacts of the ``taken`` postings, from and to in the flat ones of each component, in one pass."""
        size = sum(high - low for low, high in taken.values())
        rows, impacts, at = np.empty(size, np.int64), np.empty(size), 0
        for d, (low, high) in taken.items():
            to = at + high - low
            rows[at:to] = self.flat_rows[low:high]
            np.multiply((self.over if q[d] > 0 else self.under)[low:high], q[d], out=impacts[at:to])
            at = to
        added += np.bincount(rows, impacts, len(added))

    def possible(self, q: np.ndarray, k: int, barred: np.ndarray) -> np.ndarray:
        """Rows that the bounds can't exclude from the best ``k`` (``barred`` rows apart).

        Impacts count from the least that a component can add, so that none is negative and what
        has been added so far is a lower bound.  All that is not yet added is at most the sum of
        the next segments' impacts, one for each component.  Segments are taken by falling impact
        until it is proved of all but a few rows that they can't be among the best, or none is left.
        """
        n = len(self.x)
        used = np.flatnonzero(q)
        if n <= 16 * k or not len(used):
            return np.arange(n)
        up = q[used] > 0
        bound = np.where(
            up[:, None], (self.last[used] - self.low[used, None]) * q[used, None].astype(float),
            (self.first[used] - self.high[used, None]) * q[used, None].astype(float),
        )
        size = np.diff(self.cuts[used], axis=1)
        bound[size == 0] = -1.0
        order = np.argsort(-bound, axis=None, kind="stable")[: np.count_nonzero(size)]
        # What a component can still add after a segment: the impact of its next one.
        ranked = np.maximum(0.0, np.sort(bound, axis=1)[:, ::-1])
        ranked = np.column_stack((ranked, np.zeros(len(used))))
        after = np.empty(ranked[:, 1:].shape)
        np.put_along_axis(after, np.argsort(-bound, axis=1, kind="stable"), ranked[:, :-1] - ranked[:, 1:], axis=1)
        left = rest = float(ranked[:, 0].sum())
        base = np.where(up, self.low[used], self.high[used]).astype(float)
        by = q[used].astype(float)
        shift, doubt = float(base @ by), 1e-9 * (1 + rest + float(np.abs(base) @ np.abs(by)))
        fall = after.ravel()[order].tolist()
        dims, cuts, weight = used.tolist(), self.flat_cuts, q.astype(float).tolist()
        added = np.zeros(n)
        added[barred] = -np.inf
        taken: dict[int, list[int]] = {}
        for flat, less in zip(order.tolist(), fall):
            at, level = divmod(flat, LEVELS)
            low, high = cuts[dims[at]][level : level + 2]
            own = taken.setdefault(dims[at], [low, high])
            # The segments of a component are taken in the order in which they lie side by side.
            own[:] = min(low, own[0]), max(high, own[1])
            left -= less
            if left > LOOK * rest:
                continue
            self._add(added, taken, weight)
            taken, rest = {}, left
            best = np.argpartition(added, n - k)[n - k :]
            if added[best].min() < 0:
                continue
            worst = float(self.exact(q, best).min()) - shift
            alive = np.flatnonzero(added >= worst - rest - doubt)
            if len(alive) <= max(16 * k, n // SHARE):
                return alive
        return np.flatnonzero(added >= worst - doubt) if rest <= doubt and added[best].min() >= 0 else np.arange(n)


def _held(scores: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as 64-bit ones, the nearest where they don't fit."""
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` of doubles of any size, as Python's whole numbers."""
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        out[at] = int(value) * 256 if abs(value) >= 2.0**53 else int(np.floor(value * 256))
    return out


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            cells = [t.column("vector").combine_chunks() for t in (rows, queries)]
            width = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in cells)
            x, q = (matrix(c, width) for c in cells)
            ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            wide, odd = (np.abs(v).max(axis=1, initial=0) >= _NARROW / 256 for v in (x, q))
            order = np.argsort(wide, kind="stable")  # the rows of the index, then the wide ones
            x, ids, plain = x[order], ids[order], int((~wide).sum())
            index = _Index(np.floor(x[:plain] * 256).astype(np.int64))
            large, all_rows = _whole(x[plain:]), _whole(x) if odd.any() else None
            for query_id, vector, is_odd in zip(own, q, odd):
                if is_odd:
                    alive, score = np.arange(len(x)), _held(all_rows @ _whole(vector))
                else:
                    vector = np.floor(vector * 256).astype(np.int64)
                    alive = index.possible(vector, k, np.flatnonzero(ids[:plain] == query_id))
                    score = index.exact(vector, alive)
                    if len(large):
                        alive = np.append(alive, np.arange(plain, len(x)))
                        score = np.append(score, _held(large @ vector.astype(object)))
                other = ids[alive] != query_id
                alive, score = alive[other], score[other]
                best = np.lexsort((ids[alive], -score.astype(object) if is_odd or len(large) else -score))[:k]
                found.append((np.full(len(best), query_id), ids[alive[best]], score[best]))
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    return run


def best_matches(vectors: DataFrame, query: str, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row where ``query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``; a component ``x`` counts as ``floor(256 x)`` and
    the score is the whole-number inner product.  Ties go to the smaller id.  A query is compared
    with all rows of other ids.  Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part.  Shorter vectors end in zeros.  A score beyond the range of a
    long is given as the nearest long, and equal ones of those go by id.  Rows that repeat an id are
    each searched and found on their own; all rows with a query's id share one ranking, so a
    candidate that several of them find holds several ranks.

    Rows and queries are cut into blocks by hash; every block of queries meets every block of
    rows, each an impact-ordered index.  A search in a block ends only when bounds prove that no
    more than a small part of its rows can be among the best, or when all segments are added;
    those rows are rescored in whole.
    """
    plain = F.col("embedding").cast("array<double>").alias("vector")
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(good.select(F.col("vec_id").cast("long"), plain), "vectors")
    asked = rows.filter(query)
    counted = rows.agg(F.count("*"), F.count(F.when(F.expr(query), 1))).first()
    row_blocks, query_blocks = counted[0] // BLOCK_ROWS + 1, counted[1] // BLOCK_QUERIES + 1

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")
        to_all = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumn(own, place).withColumn(other, to_all)

    left = dealt(rows, "row_block", row_blocks, "query_block", query_blocks).groupBy("row_block", "query_block")
    right = dealt(asked, "query_block", query_blocks, "row_block", row_blocks).groupBy("row_block", "query_block")
    found = left.cogroup(right).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

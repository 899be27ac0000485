"""Embedding near-duplicates: cover trees traversed two at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import Forest
from linkloom.llm.graph import block_pairs, components
from linkloom.llm.vectors import matrix, usable
from linkloom.scratch import written

THRESHOLD = 0.93
#: Vectors of a label that one tree holds; a larger label is cut into trees that meet in pairs.
BLOCK_ROWS = 4096
#: Levels below the root; radii halve from one to the next.
LEVELS = 6
#: Pairs of nodes that are measured in one go.
_AT_ONCE = 1 << 20
#: Room for rounding in bounds, far above that of doubles: bounds may only spare what is certain.
_SLACK = 1e-6


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


class _Tree:
    """Nested levels over unit vectors: a node's centre is within its radius of all it holds.

    Rows are ordered so that the nodes of each level are ranges of rows.  ``starts[k]`` are the
    ends of the ranges of level ``k``, ``centre[k]`` and ``radius[k]`` their centres and covering
    radii; the last level is the rows themselves.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.arange(n)
        starts, centres = [np.array([0, n])], [np.array([0])]
        for level in range(1, LEVELS + 1):
            cuts, heads = [], []
            for begin, end in zip(starts[-1][:-1], starts[-1][1:]):
                cover = self._cover(x, order[begin:end], 2.0 / 2**level) if end - begin > 1 else np.zeros(1, int)
                arranged = np.argsort(cover, kind="stable")
                members = order[begin:end][arranged]
                first = np.searchsorted(cover[arranged], np.arange(cover.max() + 1))
                order[begin:end] = members
                cuts.append(begin + first)
                heads.append(members[first])
            starts.append(np.append(np.concatenate(cuts), n))
            centres.append(np.concatenate(heads))
        self.order, self.x = order, x[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.starts = [*starts, np.arange(n + 1)]
        self.centre = [*(place[c] for c in centres), np.arange(n)]
        self.radius = []
        for cut, centre in zip(self.starts, self.centre):
            own = np.repeat(np.arange(len(centre)), np.diff(cut))
            far = _distance(np.einsum("ij,ij->i", self.x, self.x[centre[own]]))
            far[centre[own] == np.arange(n)] = 0.0
            self.radius.append(np.maximum.reduceat(far, cut[:-1]))

    @staticmethod
    def _cover(x: np.ndarray, rows: np.ndarray, radius: float) -> np.ndarray:
        """For each row the number of the first chosen centre within ``radius``.

        Of each number the first row is the centre, and the first row of all, the centre of the
        level above, is chosen first.
        """
        cover, number = np.full(len(rows), -1), 0
        while (left := np.flatnonzero(cover < 0)).size:
            tried = left[:256]
            close = _distance(x[rows[tried]] @ x[rows[left]].T) <= radius
            close[np.arange(len(tried)), np.arange(len(tried))] = True
            free = np.ones(len(left), bool)
            for i in range(len(tried)):
                if free[i]:
                    got = close[i] & free
                    cover[left[got]] = number
                    free &= ~close[i]
                    number += 1
        return cover

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = self.starts[level + 1]
        cut = self.starts[level]
        return np.searchsorted(below, cut[nodes]), np.searchsorted(below, cut[nodes + 1])


class _Links:
    """What is found between the rows of two trees: weights of linked rows, and connecting links."""

    def __init__(self, a: _Tree, b: _Tree, weight_a: np.ndarray, weight_b: np.ndarray):
        self.weight_a, self.weight_b = weight_a, weight_b
        self.sum_a, self.sum_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
        self.forest, self.offset, self.kept = Forest(), len(a.x), []

    def rows(self, a: np.ndarray, b: np.ndarray, shift: int) -> None:
        np.add.at(self.sum_a, a, self.weight_b[b])
        np.add.at(self.sum_b, b, self.weight_a[a])
        self.tie(a, b, shift)

    def tie(self, a: np.ndarray, b: np.ndarray, shift: int) -> None:
        join = self.forest.join
        for x, y in zip(a.tolist(), b.tolist()):
            if join(x, y + shift):
                self.kept.append((x, y))


def _traverse(a: _Tree, b: _Tree, links: _Links, shift: int) -> None:
    """All pairs of rows of two trees whose cosine reaches the threshold."""
    reach = float(np.sqrt(2.0 - 2.0 * THRESHOLD))
    last = LEVELS + 1
    todo = [(0, 0, np.zeros(1, int), np.zeros(1, int))]
    while todo:
        la, lb, na, nb = todo.pop()
        # The coarser side goes down a level; b's nodes are taken in groups so that one product
        # of matrices measures many pairs.
        turn = la > lb
        up, down, nu, nd, lu, ld = (a, b, na, nb, la, lb) if turn else (b, a, nb, na, lb, la)
        begin, end = down.children(ld, nd)
        total = np.cumsum(end - begin)
        if total[-1] > _AT_ONCE and len(nd) > 1:
            half = max(1, int(np.searchsorted(total, total[-1] // 2)))
            todo += [(la, lb, na[:half], nb[:half]), (la, lb, na[half:], nb[half:])]
            continue
        ld += 1
        count = end - begin
        ku = np.repeat(nu, count)
        kd = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        cu, cd = up.centre[lu][ku], down.centre[ld][kd]
        if len(nd) > 1 and (nd == nd[0]).all():  # the same children for each
            dots = (up.x[up.centre[lu][nu]] @ down.x[down.centre[ld][begin[0] : end[0]]].T).ravel()
        else:
            dots = np.einsum("ij,ij->i", up.x[cu], down.x[cd])
        rows_only = lu == last and ld == last
        if rows_only:
            close = np.flatnonzero(dots >= THRESHOLD - _SLACK)
            dots = np.einsum("ij,ij->i", up.x[cu[close]], down.x[cd[close]])
            close = close[dots >= THRESHOLD]
            x, y = (ku[close], kd[close]) if turn else (kd[close], ku[close])
            links.rows(x, y, shift)
            continue
        far = _distance(dots)
        ru, rd = up.radius[lu][ku], down.radius[ld][kd]
        keep = far <= ru + rd + reach + _SLACK
        inside = keep & (far + ru + rd <= reach - _SLACK)
        for u, d in zip(ku[inside], kd[inside]):  # every row of the one links every row of the other
            s, t = slice(*up.starts[lu][u : u + 2]), slice(*down.starts[ld][d : d + 2])
            s, t = (s, t) if turn else (t, s)
            links.sum_a[s] += links.weight_b[t].sum()
            links.sum_b[t] += links.weight_a[s].sum()
            links.tie(np.arange(s.start, s.stop), np.full(s.stop - s.start, t.start), shift)
            links.tie(np.full(t.stop - t.start, s.start), np.arange(t.start, t.stop), shift)
        keep &= ~inside
        if keep.any():
            ku, kd = ku[keep], kd[keep]
            todo.append((lu, ld, ku, kd) if turn else (ld, lu, kd, ku))


def _near(key: tuple, table: pa.Table) -> pa.Table:
    """Of one group: rows ``a`` with ``links`` (weights linked) and connecting links ``a, b``."""
    node, first = table.column("node").to_numpy(), table.column("vec_id").to_numpy()
    copies, own = table.column("copies").to_numpy(), table.column("own_block").to_numpy()
    x = matrix(table.column("embedding")).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay in range
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    same = key[1].as_py() == key[2].as_py()
    sides = [np.arange(len(node))] if same else [np.flatnonzero(own == k.as_py()) for k in key[1:]]
    none = np.zeros(0, np.int64)
    nodes, sums, ends = [none], [none], [(none, none)]
    if all(len(s) for s in sides):
        trees = [_Tree(x[s]) for s in sides]
        rows = [s[t.order] for s, t in zip(sides, trees)]
        a, b = (trees[0], trees[0]) if same else trees
        rows = [rows[0], rows[0]] if same else rows
        links = _Links(a, b, copies[rows[0]], copies[rows[1]])
        _traverse(a, b, links, 0 if same else len(a.x))
        nodes, sums = [node[rows[0]]], [links.sum_a]
        if not same:
            nodes.append(node[rows[1]])
            sums.append(links.sum_b)
        if links.kept:
            i, j = np.array(links.kept).T
            ends.append((first[rows[0][i]], first[rows[1][j]]))
    nodes, sums = np.concatenate(nodes), np.concatenate(sums)
    left, right = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
    gap = [None] * len(left)
    return pa.table({
        "node": pa.concat_arrays([pa.array(nodes), pa.array(gap, pa.int64())]),
        "links": pa.concat_arrays([pa.array(sums), pa.array(gap, pa.int64())]),
        "a": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(left)]),
        "b": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(right)]),
    })


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding``, ``label``.  Two rows of one label link if the cosine
    of their vectors is 0.93 or more; ``component_id`` is the smallest id that links reach and the
    row with it is ``kept``.  Rows whose vector is null, zero or holds null or non-finite
    components, and rows without a label or an id, link with nothing; without an id they have no
    component and are kept.  Shorter vectors end in zeros.  Equal vectors of a label are one node
    with a weight, so copies make no pairs.  Rows that repeat an id each have their own count and
    share a component.  Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label"))
    nonzero = F.exists("embedding", lambda x: x != 0)
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & nonzero
    good = rows.filter(able)
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    dealt = block_pairs(nodes, ["label"], "node", BLOCK_ROWS)
    found = dealt.groupBy("label", "block_a", "block_b").applyInArrow(_near, "node long, links long, a long, b long")
    found = written(found, "vector-links")
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    ties = good.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    tied = good.join(ties, "vec_id").join(nodes.withColumnRenamed("vec_id", "b"), ["label", "embedding"])
    links = found.filter("node is null").select("a", "b").union(tied.select(F.col("vec_id").alias("a"), "b"))
    groups = components(links).withColumnRenamed("node", "vec_id")
    # A label's only vector meets nothing and links its own copies.
    known = nodes.join(counts, "node", "left").join(groups, "vec_id", "left").select(
        "label", "embedding",
        (F.coalesce("links", "copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~able).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = linked.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

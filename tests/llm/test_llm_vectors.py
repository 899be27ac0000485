"""The operators on vectors against brute force and SQL."""

import glob
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from linkloom.llm import contract, covertree, topk

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    want = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall())) and rows


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(260, 6)), 2)
    x[60:140] = x[0] + 0.05 * rng.normal(size=(80, 6))  # a dense group
    x[140:160] = x[1]  # equal vectors
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    rows += [
        (1000, None, 1), (1001, [], 1), (1002, [0.0] * 6, 1), (1003, [NAN] + [1.0] * 5, 1), (1004, [INF] * 6, 1),
        (1005, [None] * 6, 1), (1006, [1.0, 2.0], 0), (1007, [1.0, 2.0, 0.0], 0), (None, [1.0] * 6, 0), (1050, [1.0] * 6, None),
        (50, [1.0] * 6, 0), (50, [1.0] * 6, 0), (None, None, None), (1100, [-5e-324] * 6, 0), (1101, [1e300] * 6, 0),
        (1120, [2.0**46, 0.5], 1), (1130, [-1.7e308, 3.3] * 3, 1), (1131, [2.0**37 + 0.125], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return frame.selectExpr("*", "'clash' as node", "'clash' as vector", "'clash' as links", "'clash' as score").cache()


def _usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [64, None])
def test_best_matches(vectors, monkeypatch, block):
    if block:
        monkeypatch.setattr(topk, "BLOCK_ROWS", block)
        monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    held = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and _usable(r.embedding)]
    whole = [(i, [floor(256 * Fraction(c)) for c in v]) for i, v in held]
    want = Counter()
    for query in {i for i, _ in whole if i % 10 == 0}:
        found = []
        for i, q in whole:
            if i == query:
                scores = [(sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != query]
                found += [(-min(max(s, -(2**63)), 2**63 - 1), j) for s, j in scores]
        for rank, (score, j) in enumerate(sorted(found)[:5], 1):
            want[query, rank, j, -score] += 1
    got = Counter(tuple(r) for r in topk.best_matches(vectors, "vec_id % 10 = 0").collect())
    assert got == want
    assert topk.best_matches(vectors.filter("false"), "true").count() == 0


def test_bounds_exclude_rows_by_proof():
    """Most rows of a block are never rescored, and the best are always among those that are."""
    x = np.random.default_rng(3).normal(scale=30, size=(4000, 24)).astype(np.int64)
    x[:200] = x[0] + np.arange(200)[:, None] % 3
    index = topk._Index(x)
    for i in range(0, 4000, 97):
        left = index.possible(x[i], 5, np.array([i]))
        score = x @ x[i]
        score[i] = -(2**62)
        best = np.flatnonzero(score >= np.sort(score)[-5])
        assert set(best) <= set(left) and (len(left) <= 80 or i < 200)


@pytest.mark.parametrize("block", [16, None])
def test_near_vectors(vectors, monkeypatch, block):
    if block:
        monkeypatch.setattr(covertree, "BLOCK_ROWS", block)
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and _usable(v) and any(v)]
    width = max(len(rows[k][1]) for k in good)
    x = {k: np.array(list(rows[k][1]) + [0.0] * (width - len(rows[k][1]))) for k in good}
    x = {k: v / np.abs(v).max() for k, v in x.items()}
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93:
                links[a].add(b)
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            for b in others:
                low = min(label[rows[a][0]], label[rows[b][0]])
                changed |= label[rows[a][0]] != low or label[rows[b][0]] != low
                label[rows[a][0]] = label[rows[b][0]] = low
    want = Counter((i, len(links[k]), label.get(i), i is None or label[i] == i) for k, (i, _, _) in enumerate(rows))
    got = Counter(tuple(r) for r in covertree.near_vectors(vectors).collect())
    assert got == want
    assert max(n for _, n, _, _ in got) > 30
    assert covertree.near_vectors(vectors.filter("false")).count() == 0


def test_search_adds_postings_in_one_pass_between_looks(monkeypatch):
    """No search leaves out one of the best rows, and segments are added together, not one by one."""
    rng = np.random.default_rng(8)
    passes, add = [], topk._Index._add
    monkeypatch.setattr(topk._Index, "_add", lambda *a: (passes.append(1), add(*a))[1])
    for x in (rng.integers(-150, 150, (3000, 64)), rng.integers(0, 4, (500, 5)), np.zeros((200, 3), int), -rng.integers(2, 9, (300, 1))):
        index = topk._Index(x.astype(np.int64))
        for i in range(0, len(x), 97):
            alive = index.possible(x[i], 5, np.array([i]))
            score = np.where(np.arange(len(x)) == i, -(1 << 40), x @ x[i])
            worst = np.sort(score)[-5]
            assert set(np.flatnonzero(score >= worst)) <= set(alive.tolist()) | {i}
    assert len(passes) < 60 * 31 + 4 * 40  # a look each; there are up to 512 segments a search

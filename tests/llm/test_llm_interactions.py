"""The filter audit against walking every order through every document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import interactions


def _fails(text, repeated):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": repeated,
    }


def _walked(rows, labels):
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    parts = {p or "" for _, _, p in rows}
    judged = [(i, _fails(t or "", i is not None and i > firsts[t or ""]), p or "") for i, t, p in rows]
    for order in permutations("ABCDE"):
        found = {(p, s): Counter() for p in parts for s in range(1, 6)}
        for i, fails, part in judged:
            left = True
            for step, name in enumerate(order, 1):
                at = found[part, step]
                at["redundant"] += fails[name] and not left
                at["unique_fails"] += fails[name] and sum(fails.values()) == 1
                if left and fails[name]:
                    left = False
                    at["removed"] += 1
                    at["good_lost"] += i in good
                    at["toxic_lost"] += i in toxic
                    shapley[part, name] += 1
                at["kept"] += left
        for (part, step), at in found.items():
            out[part, "".join(order), step] = at
    return out, shapley


def _same(got, rows, labels):
    want, shapley = _walked(rows, labels)
    got = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[key][name], (key, name)
        assert r.shapley == shapley[key[0], key[1][key[2] - 1]]


def test_positional_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 31, 32, 33, 1000, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
        assert interactions.positional_counts(words).tolist() == want


def test_audit_on_odd_rows(spark, docs, no_docs, labels):
    docs = docs.withColumns({"part": F.lit(1), "failed": F.lit(2), "text_hash": F.lit(3), "label": F.lit(4)})
    copies = docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 5_000_000)
    docs = docs.unionByName(copies)
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    failures = interactions.text_failures(F.col("text"))
    _same(interactions.audit(docs, labels, failures, repeats="E"), rows, [tuple(r) for r in labels.collect()])
    _same(interactions.audit(docs, labels.filter("false"), failures, repeats="E"), rows, [])
    assert interactions.audit(no_docs, labels, failures, repeats="E").count() == 0


def test_audit_of_other_filters(spark, docs, labels):
    got = interactions.audit(docs, labels, {"x": F.length("text") < 100, "y": F.col("lang") == "en"}).collect()
    parts = {r.source or "" for r in docs.select("source").collect()}
    assert len(got) == len(parts) * 2 * 2 and {r.filter_order for r in got} == {"xy", "yx"}
    short = docs.filter("length(text) < 100").count()
    assert sum(r.removed for r in got if r.filter_order == "xy" and r.step == 1) == short
    assert sum(r.kept for r in got if r.filter_order == "xy" and r.step == 2) == docs.filter("coalesce(length(text) >= 100, true) and coalesce(lang <> 'en', true)").count()
    with pytest.raises(ValueError):
        interactions.audit(docs, labels, dict.fromkeys("abcdef", F.lit(True)))

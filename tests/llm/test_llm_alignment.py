"""Cross-tokenizer alignment against encoding every text whole, and fragments at random byte cuts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import alignment, tokens

ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text", "a  b\tc\n d  \n", " leading", "trailing ", "▁ x▁y", "nul\0 byte",
    " wide 　 spaces \x1c here   too", "naïve café — “quotes” 你好 世界 🙂👍🏽 é", "don't we'll I'm 'tis 's", "ﬁ ① Å",
    "x" * 700, "1234567 " * 50 + "0" * 300, "(((( {{{{ ==== ----" * 30, "AKIA" + "Z9" * 400, " ", "\n", "the the the",
]


@pytest.fixture(scope="module")
def encoders():
    return tokens.pair(*tokens.vocabularies())


def _groups(encoders, text):
    if not text:
        return []
    a, b = encoders.a.encode(" " + text, add_special_tokens=False).ids, encoders.b.encode(text)
    whole = (" " + text).encode()
    x, y = [encoders.a_bytes[i] for i in a], [encoders.b_bytes[i] for i in b]
    if b"".join(x) != whole or b"".join(y) != whole:
        return []
    ends = set(np.cumsum([len(p) for p in x]).tolist()) & set(np.cumsum([len(p) for p in y]).tolist())
    out = {}
    for ids, pieces, side in ((a, x, 0), (b, y, 1)):
        at = group = 0
        for i, piece in zip(ids, pieces):
            out.setdefault(group, ([], []))[side].append(i)
            at += len(piece)
            group += at in ends
    return [out[g] for g in sorted(out)]


def _brute(encoders, rows):
    found = [(doc, _groups(encoders, text)) for doc, text in rows]
    linked = [Counter((i, j) for x, y in groups for i in x for j in y) for _, groups in found]
    held = Counter(pair for links in linked for pair in links)
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, groups), links in zip(found, linked):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()),
        ))
    return sorted(out, key=repr)


def test_alignment_equals_whole_texts(spark, docs, no_docs, encoders):
    odd = spark.createDataFrame([(7_000_000 + i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string")
    frame = docs.select("doc_id", "text", "row", "n_chars").unionByName(odd, allowMissingColumns=True).repartition(3)
    frame = frame.withColumns({"pairs": F.lit(1), "no": F.lit(2)})
    want = _brute(encoders, [(r.doc_id, r.text) for r in frame.collect()])
    got = alignment.alignment(frame)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    # The same with many ranges a text, and with nearly all counts met by the join.
    aligned = alignment.align(frame, size=1500)
    assert sorted(map(tuple, alignment.links(aligned, hot_pairs=20).collect()), key=repr) == want
    assert alignment.alignment(no_docs).count() == 0


def test_fragments_of_any_byte_ranges(encoders):
    rng = np.random.default_rng(4)
    for text in [*ODD, "Some plain words, in a row; 12 of them or so. Ääkköset!"] * 3:
        ids = encoders.encode(text)
        if ids is None:
            continue
        whole = _groups(encoders, text)
        n = len((" " + text).encode())
        cuts = [0, *sorted(rng.choice(n + 1, min(n, 6), replace=False).tolist()), n]
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            parts.append(alignment.range_fragment(encoders, text, low, high))
        left = parts[0]
        for part in parts[1:]:
            left = left + part
        right = parts[-1]
        for part in parts[-2::-1]:
            right = part + right
        for found in (left.whole(), right.whole()):
            assert not len(found.tail[0]) and found.n_groups == len(whole)
            assert found.shown.decode() == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in whole)
            links = Counter(i * alignment._PAIR + j for x, y in whole for i in x for j in y)
            assert dict(zip(found.pairs.tolist(), found.times.tolist())) == links


def test_large_groups_are_counted_by_id(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 7, 50)
    n_a, n_b = np.array([10, 30, 20]), np.array([5, 5, 40])
    want = alignment._summed(*alignment._links(a, b, n_a, n_b)[:2])
    monkeypatch.setattr(alignment, "LISTED_LINKS", 100)
    codes, times, of = alignment._links(a, b, n_a, n_b)
    assert (np.diff(of) >= 0).all() and times.sum() == (n_a * n_b).sum()
    assert all((x == y).all() for x, y in zip(alignment._summed(codes, times), want))


def test_ranges_cover_texts():
    for text in ("one two three " * 40, "one two  three " * 40, "x" * 500, "a" * 90 + " " + "b" * 300 + " c" * 50, "   " * 60 + "z"):
        full = (" " + text).encode()
        for size in (16, 64, 1000):
            at = 0
            for piece, low, high in alignment.ranges(text, size):
                begin = full.index((" " + piece).encode()[low:high], at)
                assert begin == at
                if max(map(len, text.split())) <= size and "  " not in text:  # safe spaces are never far
                    assert len(piece) <= 3 * size + 2
                at += high - low
            assert at == len(full)

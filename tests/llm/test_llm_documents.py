"""The operators on documents against brute force, on rows that break naive code."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from linkloom.llm import lines, mixing, packing, repeats, secrets, simhash


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    a = np.array(found, np.uint64)
    return sum(1 << i for i in range(64) if int(((a >> np.uint64(i)) & np.uint64(1)).sum()) * 2 > len(found))


def test_simhash(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    want = sorted((repr(i), f"{_fingerprint(t):016x}") for i, t in rows)
    assert sorted((repr(r.doc_id), r.fingerprint) for r in got) == want
    # Components over ids: rows link if their fingerprints are close or their ids equal.
    prints = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            prints[r.doc_id].add(int(r.fingerprint, 16))
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    near = [(i, j) for i in ids for j in ids if i < j and any((a ^ b).bit_count() <= 3 for a in prints[i] for b in prints[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert all(r.component_id == (label[r.doc_id] if r.doc_id is not None else None) for r in got)
    assert len(set(label.values())) < len(ids)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, _ in rows if i is None or label[i] == i)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_fingerprints_link_within_groups_that_blocks_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1, 2**62))
    prints = [base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 64, (40, 2))] + [1, 2, 2**63]
    prints = [p & (2**64 - 1) for p in prints]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    monkeypatch.setattr(
        simhash, "fingerprints", lambda d: spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    )
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(None).collect()}
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))


def _line_sets(rows, width):
    for doc, text in rows:
        for number, line in enumerate((text or "").split("\n") if text is not None else []):
            words = line.encode().split()
            shingles = [tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))]
            yield doc, text, number, frozenset(shingles)


def test_repeated_lines(spark, docs, rows, no_docs):
    for width in (5, 1):
        key = {t: spark_key for t, spark_key in _text_keys(spark, rows)}
        found = [((doc is not None, doc or 0, key[t], n), s) for doc, t, n, s in _line_sets(rows, width) if s]
        firsts = {}
        for place, s in sorted(found, key=lambda x: x[0]):
            firsts.setdefault(s, place)
        holding = defaultdict(list)
        for s in firsts:
            for token in s:
                holding[token].append(s)
        like = {s: set() for s in firsts}
        for s in firsts:
            shared = Counter(o for token in s for o in holding[token])
            like[s] = {firsts[o] for o, n in shared.items() if n * 5 >= 4 * (len(s) + len(o) - n)}
        of = {p: s for p, s in found}
        want = {p for p, s in found if min(like[s]) < p}
        places = defaultdict(list)
        for p in of:
            places[p[1] if p[0] else None, p[3]].append(p)
        got = lines.repeated_lines(docs, words=width).collect()
        copies = Counter((r.doc_id, r.text_key, r.line_no) for r in got)
        assert copies == Counter((p[1] if p[0] else None, p[2], p[3]) for p, _ in found if p in want) and got
        for r in got:
            own = next(p for p in places[r.doc_id, r.line_no] if p[2] == r.text_key)
            assert any(p < own and p in like[of[own]] for p in places[r.match_doc_id, r.match_line_no])
    assert lines.repeated_lines(no_docs).count() == 0


def _thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_collide_in_polynomials_differ(spark):
    texts = []
    for n in (8, 64, 512, 1024, 2048):
        word = _thue_morse(n)
        texts += [f"some {x} words around it" for x in (word, word.translate({97: "b", 98: "a"}))]
    texts += [f"x {c * 9} y" for c in "abc"] + ["x aaaaaaaaa y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lines.repeated_lines(frame).collect()
    assert [(r.doc_id, r.match_doc_id) for r in got] == [(13, 10)]


def _text_keys(spark, rows):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string")
    return [(r.text, r.k) for r in texts.select("text", F.xxhash64("text").alias("k")).collect()]


def test_lines_are_cut_from_texts(docs, rows, no_docs):
    gone = defaultdict(set)
    for r in lines.repeated_lines(docs).collect():
        gone[r.doc_id, r.text_key].add(r.line_no)
    from pyspark.sql import functions as F

    want = Counter()
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect():
        out = gone.get((r.doc_id, r.k))
        if not out:
            want[r.doc_id, r.text] += 1
            continue
        left = [x for i, x in enumerate(r.text.split("\n")) if i not in out]
        if left:
            want[r.doc_id, "\n".join(left)] += 1
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_frequent_tokens_are_cut_into_blocks(docs, monkeypatch):
    want = Counter(tuple(r) for r in lines.repeated_lines(docs).collect())
    monkeypatch.setattr(lines, "BLOCK_LINES", 1)
    monkeypatch.setattr(lines, "TASK_TOKENS", 1 << 12)
    assert Counter(tuple(r) for r in lines.repeated_lines(docs).collect()) == want


def _removed(texts, n=400):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        cut = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                cut[i : i + n] = b"\1" * n
        runs = sum(1 for i, x in enumerate(cut) if x and (i == 0 or not cut[i - 1]))
        kept = bytes(c for c, x in zip(t, cut) if not x)
        yield len(t), sum(cut), runs, hashlib.sha256(kept).hexdigest()


def test_remove_repeats(spark, docs, rows, no_docs, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abc é"), n))
    passages = [word(1200) for _ in range(3)]
    more = [(i, word(int(rng.integers(0, 300))) + passages[i % 3][int(rng.integers(0, 400)) : int(rng.integers(500, 1200))] + word(50)) for i in range(80)]
    more += [(900, "a" * 2500), (901, "ab" * 700), (902, passages[0] * 2), (903, passages[1]), (903, passages[1])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    # The two very long texts take brute force too long; others cover them.
    frame = frame.filter("text is null or length(text) < 100000")
    held = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
    texts = [t for _, t in held]

    def digests(df):
        return Counter(
            (r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans),
             r.sha256 if r.kept is None else hashlib.sha256(r.kept).hexdigest(), r.n_shorter)
            for r in df.collect()
        )

    def want(length, shorter):
        return Counter(
            (i, *found, other[1]) for (i, _), found, other in zip(held, _removed(texts, length), _removed(texts, shorter))
        )

    right = want(400, 150)
    assert digests(repeats.cut_repeats(frame, shorter=150)) == right
    # The way for keys with very many surroundings finds the same.
    with monkeypatch.context() as patch:
        patch.setattr(repeats, "KEY_CONTEXTS", 1)
        assert digests(repeats.cut_repeats(frame, shorter=150)) == right
    assert digests(repeats.cut_repeats(frame, 64, 33)) == want(64, 33)
    assert repeats.cut_repeats(no_docs).count() == 0
    long = {r.doc_id: r for r in repeats.cut_repeats(docs).collect() if r.n_bytes > 100_000}
    assert [long[10**9 + k].kept == b"" for k in (3, 4)] == [True, False]
    assert [long[10**9 + k].spans[0].end == long[10**9 + 3].n_bytes for k in (3, 4)] == [True, True]
    with pytest.raises(ValueError):
        repeats.cut_repeats(docs, 31)


def test_strings_that_collide_in_polynomials_differ(spark):
    word = _thue_morse(512).replace("b", "i")  # byte values eight apart
    texts = [f"some text before it {x} and behind" for x in (word, word.translate({97: "i", 105: "a"}))]
    frame = spark.createDataFrame(list(enumerate([*texts, texts[0] + "."])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in repeats.cut_repeats(frame).collect()}
    assert [len(got[i]) for i in range(3)] == [1, 0, 1]


BASE = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
WEAK = [
    ("endpoint", secrets.WEAK["endpoint"]), ("id", secrets.WEAK["id"]), ("weak", secrets.WEAK["weak"]),
]


def _spans(text):
    base = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m)]
    weak = [(m.start(), k + 3, m.end()) for k, (_, p) in enumerate(WEAK) for m in re.finditer(p, text)]
    secret = lambda s: s[1] in (0, 2, 5)
    near = lambda a, b: a[0] - b[2] <= 200 and b[0] - a[2] <= 200
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    every = base + weak
    linked = [a for a in weak if any(near(a, b) for b in every if secret(a) != secret(b)) and not any(over(a, b) for b in base)]
    return sorted(base), sorted(base + linked)


def test_secrets(spark, docs, rows, no_docs):
    key = "AKIA" + "Q" * 16
    odd = [
        "secret: token: abcdef123", f"{key} x PWD = hunter22 {key}Z", "login=bob https://h.example/x" + "." * 300 + "auth: abc",
        "é" * 50 + "user: ann, PassWord='s3cr3t!!' postgres://db.example:5432/x", "token=" + "0123456789abcdef" * 3,
        "https://alone.example", "user=alone", "credential: abcd" + " " * 190 + "user = x", "credential: abcd" + " " * 260 + "user = x",
        "api_key==abcdef apikey = \"zz\" passwd:123456", "token " * 3000 + "secret=abcdefg",
    ]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(7_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    names = ["assign", "access", "hex", "endpoint", "id", "weak"]
    show = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    want = Counter()
    for r in frame.collect():
        base, every = _spans(r.text or "")
        count = Counter(k for _, k, _ in base)
        digest = hashlib.sha256(show(base).encode()).hexdigest()
        want[r.doc_id, count[0], count[1], count[2], len(every) - len(base), digest, show(every)] += 1
    assert Counter(tuple(r) for r in secrets.find_secrets(frame).collect()) == want
    assert sum(w[4] for w in want) > 4
    assert secrets.find_secrets(no_docs).count() == 0


def test_secrets_take_time_in_proportion_to_the_matches(spark):
    def seconds(matches):
        text = " ".join(f"{i:024x}" for i in range(matches)) + " password=abcdef1" * 10
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.perf_counter()
        got = secrets.find_secrets(frame).first()
        assert (got.n_hex, got.n_assign) == (matches, 10)
        return time.perf_counter() - begin

    seconds(10)
    few, many = seconds(4_000), seconds(32_000)
    assert many < 8 * few + 5 and many < 60


def test_mixing(docs, no_docs):
    levels, weights = mixing.document_levels(), mixing.DOCUMENT_WEIGHTS
    got = mixing.mix(docs, levels, weights, (9, 10), 3).collect()
    assert len(got) == docs.count()
    stock, used = Counter(), Counter()
    for r in got:
        leaf = r.domain, r.lang, r.source
        stock[leaf] += r.tokens
        used[leaf] += r.whole_epochs * r.tokens + r.last_tokens
        assert 0 <= r.last_tokens <= r.tokens
    total = sum(stock.values()) * 9 // 10
    assert total - len(stock) <= sum(used.values()) <= total
    assert all(used[k] <= 3 * stock[k] for k in stock)

    def fill(budget, nodes):
        """Water filling by hand: what a full node leaves goes to its siblings."""
        share, open_ = {}, dict(nodes)
        while open_:
            weight = sum(w for w, _ in open_.values())
            full = {k for k, (w, can) in open_.items() if can * weight <= w * budget}
            if not full:
                return share | {k: budget * w // weight for k, (w, _) in open_.items()}
            for k in full:
                share[k] = open_.pop(k)[1]
                budget -= share[k]
        return share

    def down(path, budget, depth):
        if depth == 3:
            assert used[path] == budget
            return
        name = list(levels)[depth]
        kids = {leaf[: depth + 1] for leaf in stock if leaf[:depth] == path}
        nodes = {k: (weights[name].get(k[-1], 1), sum(3 * n for leaf, n in stock.items() if leaf[: depth + 1] == k)) for k in kids}
        for k, given in fill(budget, nodes).items():
            down(k, given, depth + 1)

    down((), min(total, 3 * sum(stock.values())), 0)
    assert mixing.mix(no_docs, levels, weights).count() == 0
    kept = mixing.keep_mixed(docs, levels, weights, (1, 2))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.keep_mixed(docs, levels, {}, (1, 1)).count() == docs.count()


def test_packing(docs, no_docs):
    from pyspark.sql import functions as F

    for shard_pieces in (packing.SHARD_PIECES, 50):
        got = packing.pack(docs, packing.copies(F.col("text")), shard_pieces=shard_pieces).collect()
        sizes = Counter((r.doc_id, (len((r.text or "").encode()) + 3) // 4) for r in docs.select("doc_id", "text").collect())
        want = Counter()
        for (doc, size), n in sizes.items():
            for piece in range(max(1, -(-size // 2048))):
                want[doc, piece, min(2048, size - 2048 * piece)] += n
        assert Counter((r.doc_id, r.piece, r.tokens) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.shard, r.bin].append(r)
        for held in bins.values():
            assert sum(r.tokens for r in held) <= 2048
            for values in ([r.source for r in held if r.source is not None], [r.cluster for r in held if r.cluster is not None]):
                assert len(set(values)) == len(values)
    assert packing.pack(no_docs, "n_chars").count() == 0


def test_texts_without_words_share_a_bin(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, f"s{i}") for i, t in enumerate([None, "", " \n", None, "a word", "a word"])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), packing.copies(F.col("text")))
    bins = {r.doc_id: r.bin for r in got.collect()}
    assert len({bins[i] for i in range(4)}) == 1 and bins[4] != bins[5]


def test_best_fit_goes_on_to_the_tightest_compatible_bin():
    bins = packing._Bins(100)
    assert [bins.put(60, 1), bins.put(70, 2), bins.put(80, 4)] == [0, 1, 2]
    assert bins.put(20, 4) == 1  # bin 2 is tighter, but holds the same
    assert bins.put(20, 1) == 2
    assert bins.put(40, 8) == 0
    assert bins.put(10, 4 | 2) == 3  # bin 1 holds both, the others are full

"""Language-model scores: base against plain counting, the model as a proper and better distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from linkloom.llm import contract, mixture

SF = "/root/testdata/sf0.01"


def _split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def _base(rows, learned):
    counts = Counter()
    for _, text in filter(learned, rows):
        counts.update(_split(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for row in rows:
        tokens = _split(row[1])
        logs = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        out.append((row[0], len(tokens), sum(t in counts for t in tokens), total, round(logs, 4), learned(row)))
    return sorted(out, key=repr)


def _shown(got):
    return sorted(
        ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.learned) for r in got), key=repr
    )


def test_base_scores_of_odd_rows(spark, docs, no_docs, rows, monkeypatch):
    docs = docs.withColumns({"learned": F.lit("x"), "token": F.lit("y"), "n": F.lit(1), "rare": F.lit(0)}).repartition(3)
    learn = F.col("doc_id") % 3 != 0
    want = _base(rows, lambda r: r[0] is not None and r[0] % 3 != 0)
    got = mixture.score(docs, learn).collect()
    assert _shown(got) == want
    assert all(r.score < 0 and 0 < r.bits_per_byte < 60 for r in got)
    monkeypatch.setattr(mixture, "HOT_WORDS", 50)
    assert _shown(mixture.score(docs, learn).collect()) == want
    assert mixture.score(no_docs, learn).count() == 0
    unlearned = mixture.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in unlearned} == {(0, 0)}


def test_scores_depend_on_the_text_alone(spark):
    texts = ["Some words of a text", "other words", "some  WORDS of\na text", "", None, " ", "long " * 3000 + "tail"]
    frame = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    for parts in (1, 4):
        got = mixture.score(frame.repartition(parts, "doc_id"), F.col("doc_id") < 5).collect()
        scores = {r.doc_id: round(r.score, 6) for r in got}
        for i in range(7):
            assert scores[i] == scores[i + 7] == scores[i + 14]
        assert scores[0] == scores[2] and scores[3] == scores[4] == scores[5]


def test_codes_are_complete_and_texts_share_one_unit_of_probability():
    counts = np.zeros((256, 256), np.int64)
    counts[32, 97:123] = np.arange(26) ** 3
    codes = mixture.Codes.of(counts)
    for before in (0, 32, 255):
        own = slice(before * 256, before * 256 + 256)
        assert sum(0.5**n for n in codes.length[own].tolist()) == 1
    rng = np.random.default_rng(0)
    inside = [rng.integers(-60, 60, 1 << bits).astype(np.int8) for bits in mixture.CELL_BITS]
    heads = [rng.integers(-60, 60, 256 << mixture.HEAD_BITS).astype(np.int8) for _ in range(4)]
    model = mixture.Model(codes, inside, heads, mixture.Start.plain(8, 4), mixture.Start.plain(60, 4))
    powers = mixture.Powers(mixture._BASE)
    # All bytes that may follow a beginning share one unit of probability, inside a word and at its first byte.
    words = pa.array([b"ab" + bytes([byte]) for byte in range(256)]).view(pa.string())
    tails = model.tails(words, powers) - model.tails(pa.array(["ab"]), powers)
    assert abs(sum(2.0**-tails) - 1) < 1e-3
    one = model.first_bytes(mixture._Run.of(pa.array(["some words"]), powers))[0]
    assert one == model.first_bytes(mixture._Run.of(pa.array(["", "some words"]), powers))[1]


def test_model_beats_single_tokens_on_unseen_texts(spark):
    got = contract.op13_mixture(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = _base(rows, lambda r: zlib.crc32(str(r[0]).encode()) % 10 != 0)
    assert [(w[0], w[1], w[2], w[3], w[4]) for w in want] == sorted(
        ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr
    )


def test_weights_are_fitted_to_all_training_texts(spark, monkeypatch):
    texts = [f"word{i % 7} and number {i}" for i in range(900)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sums, summed = [], mixture._summed
    monkeypatch.setattr(mixture, "_summed", lambda *args: sums.append(summed(*args)) or sums[-1])
    mixture.score(frame, F.col("doc_id") % 10 != 0).collect()
    learned = [_split(t) for i, t in enumerate(texts) if i % 10]
    heads, tails = sums[: mixture.HEAD_PASSES], sums[mixture.HEAD_PASSES :]
    assert [lanes.tolist() for lanes, *_ in heads] == [[len(learned)]] * mixture.HEAD_PASSES
    # Each decision behind a word's first byte, in each text, is seen once by each pass; a byte takes one at least.
    behind = sum(len(w) for words in learned for w in words if w != "\n")
    seen = [round(s.sum()) for *_, s in tails]
    assert len(seen) == mixture.TAIL_PASSES and len(set(seen)) == 1 and behind <= seen[0] <= 16 * behind


def test_words_are_spelled_in_small_pieces(monkeypatch):
    """However long a batch is; the counts are those of one piece, and a lookup leaves out its own decision."""
    rng = np.random.default_rng(4)
    tokens = pa.array(["".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 40))))) + " " for _ in range(40_000)])
    n = pa.array(rng.integers(1, 9, len(tokens)))
    batch = pa.record_batch([tokens, n], ["token", "n"])
    codes = mixture.Codes.of(np.ones((256, 256), np.int64))
    whole = mixture._spelled(tokens, codes, mixture.Powers(mixture._BASE))
    sizes, spelled = [], mixture._spelled
    monkeypatch.setattr(mixture, "_spelled", lambda words, *rest: (sizes.append(words.nbytes), spelled(words, *rest))[1])
    found = {(t, b): c for t, b, c in mixture._sums(mixture._word_contexts(codes)([batch]))}
    assert len(sizes) > 2 and sum(pc.binary_length(tokens).to_pylist()) / len(sizes) < mixture.FIT_BYTES
    weight, size = n.to_numpy()[whole.word], 2 << mixture._BLOCK_BITS
    for k, cells in enumerate(whole.cells):
        want = np.bincount(cells.astype(np.int64) * 2 + whole.bit, weight, 2 << mixture.CELL_BITS[k]).astype(np.int64)
        for block in range(len(want) // size):
            own = want[block * size : (block + 1) * size]
            assert np.array_equal(found.get((k, block), np.zeros(size, np.int64)), own)
    zeros, ones = ([rng.integers(-9, 9, 1 << bits).astype(np.int8) for bits in mixture.CELL_BITS] for _ in range(2))
    got = mixture._odds(whole.cells, whole.bit, mixture._less(zeros, ones), less=True)
    want = [np.where(whole.bit, one[c], zero[c]) for zero, one, c in zip(zeros, ones, whole.cells)]
    assert np.array_equal(got, np.stack(want, axis=1))


def _random_model(rng):
    codes = mixture.Codes.of(rng.integers(0, 50, (256, 256)))
    inside = [rng.integers(-60, 60, 1 << bits).astype(np.int8) for bits in mixture.CELL_BITS]
    heads = [rng.integers(-60, 60, 256 << mixture.HEAD_BITS).astype(np.int8) for _ in range(4)]
    return mixture.Model(codes, inside, heads, mixture.Start.plain(8, 4), mixture.Start.plain(60, 4))


class _Shared:
    def __init__(self, value):
        self.value = value


def test_table_of_frequent_words_is_made_once(monkeypatch):
    """Not anew for each piece of text; words are told apart even where their hashes agree."""
    vocabulary = [f"w{i} " for i in range(400)] + ["\n"]
    known, order = mixture._Known.of(pa.array(vocabulary), mixture.Powers(mixture._BASE))
    assert sorted(order.tolist()) == list(range(401)) and known.words.to_pylist() == [vocabulary[i] for i in order]
    looked_up, index_in = [], pc.index_in
    monkeypatch.setattr(mixture.pc, "index_in", lambda *args, **kw: looked_up.append(args) or index_in(*args, **kw))
    texts = [" ".join(f"w{(i * k) % 500}" for i in range(300_000)) for k in (1, 3, 7)]
    columns = [pa.array([0, 1, 2]), pa.array([5, 6, 7]), pa.array(texts), pa.array([True, False, True])]
    batch = pa.record_batch(columns, ["row", "doc_id", "text", "learned"])
    counts, tails = np.arange(401)[order], np.ones(401)
    run = mixture._scored(_Shared(_random_model(np.random.default_rng(1))), _Shared((known, counts, tails)), 1000, 401)
    got = pa.Table.from_batches(list(run([batch])))
    assert got.column("n_known").to_pylist() == [sum(t in vocabulary for t in _split_ended(text)) for text in texts]
    assert not looked_up
    words = pa.array(["b ", "other ", "a ", "c "])
    alike = mixture._Known(pa.array(["a ", "b ", "c "]), np.array([7, 7, 9], np.uint64))
    assert alike.places(words, np.array([7, 7, 7, 9], np.uint64)).tolist() == [1, -1, 0, 2] and looked_up
    none = mixture._Known(pa.array([], pa.string()), np.zeros(0, np.uint64))
    assert none.places(words, np.arange(4, dtype=np.uint64)).tolist() == [-1] * 4
    assert len(alike.places(words.slice(0, 0), np.zeros(0, np.uint64))) == 0


def _split_ended(text):
    return [w if w == "\n" else w + " " for w in _split(text)]


def test_contexts_are_counted_by_plain_places(monkeypatch):
    """Places of another type than numpy's own take its slow way, ten times as long."""
    rng = np.random.default_rng(2)
    plain, calls = np.add, []

    class Add:
        def at(self, table, at, times):
            calls.append((table.dtype, at.dtype, np.asarray(times).dtype))
            plain.at(table, at, times)

    monkeypatch.setattr(mixture.np, "add", Add())
    texts = pa.record_batch([pa.array([" ".join(f"w{i}" for i in rng.integers(0, 99, 500)), "", None])], ["text"])
    counted = pa.Table.from_batches(list(mixture._counted([texts])))
    words = counted.filter(pc.is_valid(counted.column("token"))).select(["token", "n"]).combine_chunks().to_batches()
    list(mixture._word_contexts(mixture.Codes.of(np.ones((256, 256), np.int64)))(words))
    assert pc.sum(counted.column("n")).as_py() == 503 and len(calls) == 8
    assert all(at == np.intp and times == table for table, at, times in calls)


def test_mixing_follows_the_plain_form():
    """All lanes at once against one decision after the other."""
    rng = np.random.default_rng(3)
    length = np.array([40, 40, 17, 3])
    odds = rng.integers(-127, 128, (40, 4, 4)).astype(np.int8)
    gate, bit = rng.integers(0, 8, (40, 4)).astype(np.uint8), rng.integers(0, 2, (40, 4)).astype(np.uint8)
    start = mixture.Start.plain(8, 4)
    bits, end = mixture._mix(odds, gate, bit, length, start)
    want, weights, maps = [], [], []
    for lane, n in enumerate(length):
        w, refined, total = start.weights.astype(float), start.map.astype(float), 0.0
        for step in range(n):
            x = np.append(odds[step, lane] / mixture._UNIT, 0.5)
            y = float(bit[step, lane])
            z = min(max(float(x @ w[gate[step, lane]]), -8.0), 8.0)
            p = 1 / (1 + math.exp(-z))
            spot = (z + 8) * 2
            low = min(int(spot), 31)
            part, left, right = spot - low, refined[low], refined[low + 1]
            q = 0.5 * (p + left + (right - left) * part)
            total -= math.log2(min(max(q if y else 1 - q, mixture._LEAST), 1))
            w[gate[step, lane]] += mixture._RATE * (y - p) * x
            refined[low] += mixture._MAP_RATE * (1 - part) * (y - left)
            refined[low + 1] += mixture._MAP_RATE * part * (y - right)
        want.append(total)
        weights.append(w)
        maps.append(refined)
    assert np.allclose(bits, want, rtol=1e-4)
    assert np.allclose(end.weights, np.mean(weights, axis=0), atol=1e-4) and np.allclose(end.map, np.mean(maps, axis=0), atol=1e-4)


def _plain_tail_bits(model, words, segment):
    """Decisions behind first bytes one after the other; weights and map follow each outcome."""
    powers, total, left = mixture.Powers(mixture._BASE), 0.0, 0
    for word in words:
        own = mixture._spelled(pa.array([word]), model.codes, powers)
        odds = mixture._odds(own.cells, own.bit, model.inside)
        for x, gate, bit in zip(odds, mixture._gates(own.gate, odds).tolist(), own.bit.tolist()):
            if not left:
                w, refined, left = model.tail.weights.astype(float), model.tail.map.astype(float), segment
            x = np.append(x / mixture._UNIT, 0.5)
            z = min(max(float(x @ w[gate]), -8.0), 8.0)
            p = 1 / (1 + math.exp(-z))
            low = min(int((z + 8) * 2), 31)
            part = (z + 8) * 2 - low
            q = 0.5 * (p + refined[low] + (refined[low + 1] - refined[low]) * part)
            total -= math.log2(min(max(q if bit else 1 - q, mixture._LEAST), 1))
            w[gate] += mixture._RATE * (bit - p) * x
            refined[low] += mixture._MAP_RATE * (1 - part) * (bit - refined[low])
            refined[low + 1] += mixture._MAP_RATE * part * (bit - refined[low + 1])
            left -= 1
    return total


def test_all_decisions_are_mixed_online(monkeypatch):
    """Also those behind first bytes, in texts that were learned from and others, whatever stays spelled from piece to piece."""
    rng = np.random.default_rng(8)
    model, words = _random_model(rng), [f"{a}{b}" for a in ("stone", "über", "x", "windmill") for b in range(6)]
    texts = [" ".join(rng.choice(words, n)) for n in (60, 3, 1, 25, 60)] + ["", "again " * 40, words[3]]
    texts += texts
    want = [_plain_tail_bits(model, _split_ended(t), 200) for t in texts]
    known, order = mixture._Known.of(pa.array([f"{w} " for w in words[::2]] + ["\n"]), mixture.Powers(mixture._BASE))
    frequent = _Shared((known, np.ones(len(order), np.int64), np.zeros(len(order))))
    powers = mixture.Powers(mixture._BASE)
    heads = [model.first_bytes(mixture._Run.of(pa.array([t]), powers))[0] for t in texts]
    monkeypatch.setattr(mixture, "TAIL_SEGMENT", 200, raising=False)
    columns = [pa.array(range(16)), pa.array(range(16)), pa.array(texts), pa.array([i % 3 == 0 for i in range(16)])]
    batch = pa.record_batch(columns, ["row", "doc_id", "text", "learned"])
    for room, size, lanes in ((1 << 22, 1 << 21, 4096), (0, 1 << 21, 3), (300, 200, 2), (1 << 22, 200, 4096)):
        monkeypatch.setattr(mixture, "TAIL_ROOM", room, raising=False)
        monkeypatch.setattr(mixture, "PIECE_BYTES", size)
        monkeypatch.setattr(mixture, "LANES", lanes)
        monkeypatch.setattr(mixture._pieces, "__defaults__", (size,))
        got = pa.Table.from_batches(list(mixture._scored(_Shared(model), frequent, 1000, 50)([batch])))
        assert np.allclose(np.array(got.column("bits")) - heads, want, rtol=1e-4, atol=1e-3)

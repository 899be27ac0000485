"""Toxicity: a chain of linear models, one for each category."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrays import Powers, flat_bytes, mixed, running, small_pieces, word_ranges

#: Bound of the labelled sample: texts with the smallest hashes of their ids, half of them of the
#: last category if there are as many.
SAMPLE_TEXTS = 4000
#: Hashed features of words and parts of words, and how many of them the models use.
FEATURE_BITS = 20
USED_FEATURES = 4096
FOLDS = 3
#: Descent of one model.
STEPS, RIDGE = 300, 0.01
THRESHOLD = 0.5
_BASE = 0xD6E8FEB86659FD93
#: Bytes of the beginnings of words that are features beside the words.
_HEADS = (4, 6, 8)


def _features(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of what occurs in each text, each once, in order of rows."""
    data, bounds = flat_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, stops = word_ranges(data, bounds)
    up, down = powers.upto(len(data))
    sums = running((data.astype(np.uint64) + np.uint64(1)) * up)
    row = np.searchsorted(bounds[1:], starts, side="right")
    kinds = [mixed((sums[stops] - sums[starts]) * down[starts])]
    for n in _HEADS:
        ends = np.minimum(starts + n, stops)
        kinds.append(mixed((sums[ends] - sums[starts]) * down[starts] + np.uint64(n)))
    feature = np.concatenate(kinds) >> np.uint64(64 - FEATURE_BITS)
    key = np.unique(np.tile(row, len(kinds)).astype(np.uint64) << np.uint64(FEATURE_BITS) | feature)
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Chain:
    """For each category weights of the used features, of earlier categories' logits, a constant."""

    names: list[str]
    used: np.ndarray
    weights: list[np.ndarray]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        place = np.full(1 << FEATURE_BITS, -1)
        place[self.used] = np.arange(len(self.used))
        at = place[feature]
        row, at = row[at >= 0], at[at >= 0]
        out = np.zeros((rows, len(self.names)))
        for j, w in enumerate(self.weights):
            out[:, j] = _sigmoid(_margin(row, at, _logit(out[:, :j]), w, len(self.used)))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logit(p: np.ndarray) -> np.ndarray:
    """Logits, cut so that no earlier category is beyond doubt."""
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def _margin(row: np.ndarray, at: np.ndarray, earlier: np.ndarray, w: np.ndarray, used: int) -> np.ndarray:
    return np.bincount(row, w[at], minlength=len(earlier)) + earlier @ w[used:-1] + w[-1]


def _train(row: np.ndarray, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, used: int) -> np.ndarray:
    """Logistic regression by damped adaptive steps; a class without examples gives a constant."""
    w = np.zeros(used + earlier.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = 4.0 if len(y) and y.max() else -4.0
        return w
    square = np.full(len(w), 1e-8)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        error = _sigmoid(_margin(row, at, earlier, w, used)) - y
        gradient = np.concatenate((np.bincount(at, error[row], minlength=used), error @ earlier, [error.sum()])) + RIDGE * w
        square += gradient**2
        w -= 0.3 * gradient / np.sqrt(square)
    return w


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column]) -> Chain:
    """A chain of ``categories``: conditions on ``labels`` (``doc_id`` and more) by name, in order.
    The last one is what the chain decides.

    The models learn from a bounded sample of the labels, of which the driver holds the features.
    A category's model sees, beside the text, the earlier categories' probabilities; for the rows
    it learns from, these are of models that did not see the row (three folds by hash of the id).
    Labels without an id, conflicting ones and null conditions are not used.
    """
    names = list(categories)
    known = labels.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.array(*[c.cast("int") for c in categories.values()]).alias("y")
    )
    known = known.filter(~F.exists("y", lambda x: x.isNull())).groupBy("doc_id")
    known = known.agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select(
        "doc_id", "y", F.xxhash64("doc_id").alias("h")
    )
    parts = [known.filter(F.element_at("y", -1) == k).orderBy("h", "doc_id").limit(SAMPLE_TEXTS // 2) for k in (0, 1)]
    sample = parts[0].union(parts[1])  # bounded, so it may be broadcast
    share = known.agg(F.avg(F.element_at("y", -1))).first()[0]
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BASE)
        for batch in batches:
            for piece in small_pieces(batch, "text"):
                row, feature = _features(piece.column(0), powers)
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
                packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), piece.column(2), pa.array(packed, pa.binary())], ["h", "y", "features"]
                )

    held = texts.select("text", "h", "y").mapInArrow(run, "h long, y array<int>, features binary").collect()
    held.sort(key=lambda r: (r.h, r.y, bytes(r.features)))
    y = np.array([r.y for r in held], float).reshape(-1, len(names))
    found = [np.frombuffer(r.features, np.int32) for r in held]
    row = np.repeat(np.arange(len(held)), [len(f) for f in found])
    feature = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)

    # The features that tell any category best, by chi squared.
    total = np.bincount(feature, minlength=1 << FEATURE_BITS).astype(float)
    best = np.zeros(len(total))
    for j in range(len(names)):
        rate = y[:, j].mean() if len(y) else 0.0
        hits = np.bincount(feature, y[row, j], minlength=len(total))
        best = np.maximum(best, (hits - total * rate) ** 2 / np.maximum(total * rate * (1 - rate), 1e-9))
    used = np.sort(np.argsort(-best, kind="stable")[:USED_FEATURES])
    used = used[total[used] > 1]
    place = np.full(len(total), -1)
    place[used] = np.arange(len(used))
    at = place[feature]
    row, at = row[at >= 0], at[at >= 0]

    fold = np.array([r.h % FOLDS for r in held], np.int64)
    seen = np.zeros((len(held), 0))
    weights = []
    for j in range(len(names)):
        apart = np.zeros(len(held))
        for f in range(FOLDS):
            learn = fold != f
            number = np.cumsum(learn) - 1
            mine = learn[row]
            w = _train(number[row[mine]], at[mine], seen[learn], y[learn, j], len(used))
            apart[~learn] = _sigmoid(_margin(row, at, seen, w, len(used)))[~learn]
        weights.append(_train(row, at, seen, y[:, j], len(used)))
        seen = np.column_stack((seen, _logit(apart)))
    # The sample holds more of the last category than the labels do: back to their share.
    if len(y) and share and 0 < y[:, -1].mean() < 1 and share < 1:
        rate = y[:, -1].mean()
        weights[-1][-1] += np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    return Chain(names, used, weights)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability for each category, and ``toxic``: 1 if the last is 0.5 or more.

    One row for each row of ``docs``; whole texts.  Null texts count as empty; empty texts get what
    the constants say.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BASE)
        for batch in batches:
            for piece in small_pieces(batch, "text"):
                row, feature = _features(piece.column(1), powers)
                p = chain.probabilities(row, feature, piece.num_rows)
                toxic = pa.array((p[:, -1] >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *map(pa.array, p.T), toxic], ["doc_id", *chain.names, "toxic"]
                )

    schema = "doc_id long, " + "".join(f"`{n}` double, " for n in chain.names) + "toxic int"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)

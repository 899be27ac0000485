"""Quality by compression: which of two dictionaries, of good or of bad text, fits a text better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample: texts of each class for the dictionaries, pieces of them that
#: reach the driver, and texts for the calibration.
DICTIONARY_TEXTS = 4000
DICTIONARY_PIECES = 20_000
CALIBRATION_TEXTS = 4000
DICTIONARY_BYTES = 112_640
#: Bytes of the pieces from which a dictionary is trained, and of those that are compressed alone,
#: so that the dictionary counts in all parts of a long text.
SAMPLE_BYTES = 512
PIECE_BYTES = 1024
LEVEL = 3
#: Score from which a text is called good.
THRESHOLD = 0.7

_PLAIN = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text and a logistic calibration of their difference."""

    dictionaries: tuple[bytes, bytes] | None
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    #: Score of all texts where the labels did not suffice.
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        held = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries or ()]
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **_PLAIN) for d in held]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(_scaled(features, self.low, self.high) @ self.weights, -500, 500)))


def _scaled(features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Features by the range of the calibration, cut there, after a constant."""
    unit = (np.clip(features, low, high) - low) / np.where(high > low, high - low, 1)
    return np.column_stack((np.ones(len(unit)), unit))


def _features(texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Differences of compressed size per byte and per compressed byte, plain ratio, log length."""
    bad, good = compressors
    plain = zstandard.ZstdCompressor(level=LEVEL, **_PLAIN)
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        x = y = 0
        for begin in range(0, len(text), PIECE_BYTES):
            piece = text[begin : begin + PIECE_BYTES]
            x += len(bad.compress(piece))
            y += len(good.compress(piece))
        n = len(text) + 1
        out[i] = (x - y) / n, (x - y) / (x + y + 1), len(plain.compress(text)) / n, np.log(n)
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few pieces to choose from: take them as they are
        return b"".join(pieces)[-DICTIONARY_BYTES:].rjust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (``doc_id``, ``quality`` 0 or 1) over texts of ``docs``.

    Labels that are null, contradict each other or name no document are not used.  Two thirds of
    the labels, by hash, are for the dictionaries and one third for the calibration, each up to
    the bounds above, those with the smallest hashes first.  The sample's ids are broadcast: a
    table of the size of these bounds.  Without labels of both classes every score is the share
    of good labels (0.5 without any).
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").cast("int").alias("good"), F.max("quality").alias("most"))
    known = known.filter("good = most").select(
        "doc_id", "good", F.xxhash64("doc_id").alias("h"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("test")
    )
    parts = [
        known.filter((F.col("good") == good) & ~F.col("test")).orderBy("h", "doc_id").limit(DICTIONARY_TEXTS)
        for good in (0, 1)
    ]
    parts.append(known.filter("test").orderBy("h", "doc_id").limit(CALIBRATION_TEXTS))
    sample = parts[0].union(parts[1]).union(parts[2]).select("doc_id", "good", "test")
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, pieces = [], []
            for label, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                own = [text[i : i + SAMPLE_BYTES] for i in range(0, len(text), SAMPLE_BYTES)]
                pieces += own
                good += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(pieces, pa.binary())], ["good", "piece"])

    pieces = texts.filter("not test").select("good", "text").mapInArrow(cut, "good int, piece binary")
    pieces = pieces.withColumn("h", F.xxhash64("piece"))
    chosen = [
        [bytes(r.piece) for r in pieces.filter(F.col("good") == good).orderBy("h", "piece").limit(DICTIONARY_PIECES).collect()]
        for good in (0, 1)
    ]
    nothing = np.zeros(4)
    model = Model((b"", b""), nothing, nothing, np.zeros(5), 0.5)
    if all(chosen):
        model = Model((_dictionary(chosen[0]), _dictionary(chosen[1])), nothing, nothing, np.zeros(5), 0.5)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compressors = model.compressors()
            for batch in batches:
                found = _features(_bytes(batch.column(1)), compressors)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], ["good", *"abcd"])

        tested = texts.filter("test").select("good", "text")
        rows = tested.mapInArrow(measure, "good int, a double, b double, c double, d double").collect()
        x = np.array(sorted(tuple(r) for r in rows)).reshape(-1, 5)
        good, x = x[:, 0], x[:, 1:]
        if 0 < good.sum() < len(good):
            low, high = x.min(axis=0), x.max(axis=0)
            return Model(model.dictionaries, low, high, _logistic(_scaled(x, low, high), good), 0.5)
    share = known.agg(F.avg("good")).first()[0]
    return Model(None, nothing, nothing, np.zeros(5), 0.5 if share is None else float(share))


def _scores(texts: pa.Array, model: Model, compressors: list) -> np.ndarray:
    if model.dictionaries is None:
        return np.full(len(texts), model.prior)
    return model.score(_features(_bytes(texts), compressors))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row; ``predicted`` is 1 from a score of 0.7.

    Whole texts are compressed, in pieces.  Null texts count as empty.  Empty texts get the score
    of what they resemble most in the calibration, the shortest texts without a difference.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = _scores(batch.column(1), model, compressors)
            predicted = pa.array((found >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), predicted], ["doc_id", "score", "predicted"])

    plain = docs.select("doc_id", F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted good; nothing is shuffled."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            good = _scores(batch.column(place), model, compressors) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

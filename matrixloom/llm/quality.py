"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector shared by all grades, with ordered thresholds (the first is free,
each further one adds the exponential of a free number). x is hashed text: relative frequencies of hashed words, of hashed runs of
other signs and of word shapes, and indicators of how often words and lines repeat, of capitals, of word and text length; DIMS
cells in all. It gives the expected grade and the tail probabilities P(grade >= k) for selection.

Fitted on at most SAMPLE labelled rows (those with the smallest hash of the key); every document is scored on its whole text.

Defined cases: null and empty texts have only the indicators of an empty text and are scored; rows without a key or grade
don't train, a key rated twice counts with its lowest grade; without ratings of two grades all documents get the top grade;
repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

WORDS, SIGNS, MARKS = 1024, 256, 256
DIMS = WORDS + SIGNS + MARKS
SAMPLE = 8000
STEPS = 400
#: Documents whose cells are in memory at a time.
DOCS = 512
RIDGE = 1e-3
KEEP = 0.5

SIGN = ~(K.ALNUM_WORD | K.WHITE)
LINE = np.ones(256, bool)
LINE[[0x0A, 0x0D]] = False


@dataclass
class Model:
    """weights of the DIMS cells and the ordered thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DIMS cells for each document."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)

    def share(rows: np.ndarray, cells: np.ndarray, base: int, size: int, scale: np.ndarray) -> None:
        counts = np.bincount(rows * size + cells, minlength=n * size).reshape(n, size)
        out[:, base : base + size] += np.sqrt(counts / scale[:, None])  # square roots: a few strange signs count

    plain = K.Words(data, offsets, K.PLAIN_WORD)
    total = np.maximum(np.diff(plain.offsets), 1).astype(float)
    words = K.Words(data, offsets, K.ALNUM_WORD)
    share(words.docs(), (words.hashes >> np.uint64(40)).astype(np.int64) % WORDS, 0, WORDS, total)
    signs = K.Words(data, offsets, SIGN)
    share(signs.docs(), (signs.hashes >> np.uint64(40)).astype(np.int64) % SIGNS, WORDS, SIGNS, total)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    lines = K.Words(data, offsets, LINE)

    def repeated(of: K.Words, k: int) -> np.ndarray:
        """The share of runs of k that the document has already had."""
        grams, rows = (K.windows(of.hashes, k), of.docs()[: max(len(of.hashes) - k + 1, 0)]) if k > 1 else (of.hashes, of.docs())
        kinds = (np.unique((rows.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20))) >> np.uint64(44)).astype(np.int64)  # 44 bits tell a document's runs apart
        have = np.bincount(rows, minlength=n)
        return 1 - np.bincount(kinds, minlength=n) / np.maximum(have, 1)

    caps = (data >= 0x41) & (data <= 0x5A)
    same = np.zeros(len(words.hashes), bool)
    if len(same) > 1:
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.docs()[1:] == words.docs()[:-1])
    stats = [
        (per(caps) / size, (0.01, 0.03, 0.06, 0.1, 0.3, 0.5)),
        (per((data >= 0x30) & (data <= 0x39)) / size, (0.005, 0.02, 0.05, 0.1, 0.3)),
        (np.diff(signs.offsets) / total, (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)),
        (repeated(words, 1), (0.2, 0.4, 0.6, 0.8, 0.9, 0.95)),
        (repeated(words, 3), (0.01, 0.05, 0.1, 0.2, 0.4, 0.7)),
        (repeated(lines, 1), (0.01, 0.1, 0.2, 0.4, 0.7)),
        (np.bincount(words.docs(), same, n) / total, (0.005, 0.02, 0.1, 0.3, 0.6)),
        (size / total, (2, 3, 4, 5, 6, 7, 8, 10, 14, 20)),
        (np.diff(plain.offsets), (1, 3, 6, 12, 25, 50, 100, 300, 1000, 3000)),
        (np.diff(lines.offsets) / total, (0.01, 0.03, 0.06, 0.1, 0.2, 0.5)),
    ]
    at = WORDS + SIGNS
    for values, edges in stats:
        out[np.arange(n), at + np.searchsorted(edges, values, "right")] = 1
        at += len(edges) + 1
    assert at <= DIMS
    return out


def fit(x: np.ndarray, grades: np.ndarray, *, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge, by Adam on all rows at once; grades are 0, 1, ... Kinds of grades weigh alike, up to a factor."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(DIMS), np.full(max(top, 1), -50.0))
    share = np.bincount(grades, minlength=top + 1) / len(grades)
    weight = 1 / np.sqrt(np.maximum(share, 1e-3))[grades]
    weight /= weight.sum()
    below = np.clip(np.cumsum(np.bincount(grades, weight, top + 1))[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2)), np.zeros(DIMS)))
    first, second = np.zeros_like(free), np.zeros_like(free)
    rows = np.arange(len(grades))
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:top])
        cuts = free[0] + np.concatenate(([0], np.cumsum(gaps)))
        eta = x @ free[top:].astype(np.float32)
        edge = np.concatenate((np.full((len(rows), 1), -1e3), cuts - eta[:, None], np.full((len(rows), 1), 1e3)), axis=1)
        cdf = 1 / (1 + np.exp(-np.clip(edge, -60, 60)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[rows, grades + 1] - cdf[rows, grades], 1e-9)
        up, low = slope[rows, grades + 1] / p * weight, slope[rows, grades] / p * weight
        by_cut = np.zeros(top + 2)
        np.subtract.at(by_cut, grades + 1, up)
        np.add.at(by_cut, grades, low)
        by_cut = by_cut[1:-1]
        grad = np.concatenate(([by_cut.sum()], [by_cut[k + 1 :].sum() * gaps[k] for k in range(top - 1)], x.T @ (up - low).astype(np.float32) + ridge * free[top:]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        free -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(free[top:].copy(), free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:top])))))


def learn(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", grade: Column | str = "grade", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` rated documents, chosen by the hash of their key; the ratings broadcast are at most that many rows."""
    grade = F.col(grade) if isinstance(grade, str) else grade
    rated = ratings.select(F.col(key).alias("_key"), grade.cast("int").alias("_grade")).where(F.col("_key").isNotNull() & (F.col("_grade") >= 0))
    rated = rated.groupBy("_key").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rated), "_key").select("_key", "_text", "_grade")

    @K.frugal
    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.pieces(offsets, most=DOCS):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([row.tobytes() for row in x], pa.binary()), batch.column(2).slice(i, j - i)], ["key", "x", "grade"])

    schema = T.StructType([T.StructField("key", rows.schema["_key"].dataType), T.StructField("x", T.BinaryType()), T.StructField("grade", T.IntegerType())])
    # The sample, at most `sample` rows of DIMS floats, meets in one task, and only the model comes to the driver.
    found = rows.mapInArrow(take, schema).repartition(1).mapInArrow(_fitted, "weights binary, thresholds binary").first()
    return Model(*(np.frombuffer(x, np.float64).copy() for x in found))


@K.frugal
def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits to all rows (key, x, grade), in the order of their keys, features and grades, to one row: weights and thresholds."""
    table = pa.Table.from_batches([x for x in batches if x.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("key", pa.int64()), ("x", pa.binary()), ("grade", pa.int32())]))])
    if not table.num_rows:
        model = Model(np.zeros(DIMS), np.full(1, -50.0))
    else:
        order = pc.sort_indices(table, [(name, "ascending") for name in ("key", "grade", "x")]).to_numpy()
        chunks = table["x"].chunks  # rows have equal sizes, so their bytes are the matrix
        x = np.concatenate([np.frombuffer(c.buffers()[2], np.float32)[c.offset * DIMS : (c.offset + len(c)) * DIMS].reshape(-1, DIMS) for c in chunks])
        model = fit(x[order], np.asarray(table["grade"]).astype(np.int64)[order])
    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], ["weights", "thresholds"])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, expected_grade, and tail: P(grade >= k) for k = 1, 2, ..."""

    @K.frugal
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for tail, i, j in _tails(data, offsets, model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64()))], [key, "expected_grade", "tail"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, T.StructType([docs.schema[key], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))]))


def _tails(data: np.ndarray, offsets: np.ndarray, model: Model) -> Iterator[tuple[np.ndarray, int, int]]:
    for i, j in K.pieces(offsets, most=DOCS):
        eta = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(float) @ model.weights
        yield 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds, -50, 50))), i, j


def select(docs: DataFrame, model: Model, *, text: str = "text", at_least: int = 1, keep: float = KEEP) -> DataFrame:
    """The rows of docs, unchanged, whose P(grade >= at_least) is keep or more. One scan, no shuffle."""
    place = docs.columns.index(text)

    @K.frugal
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(place))
            for tail, i, j in _tails(data, offsets, model):
                yield batch.slice(i, j - i).filter(pa.array(tail[:, at_least - 1] >= keep))

    return docs.mapInArrow(scan, docs.schema)

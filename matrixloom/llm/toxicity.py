"""Toxicity: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Tokens are lower-cased words; they and their beginnings (PREFIXES bytes) are hashed into 2**BUCKET_BITS cells, so the weights
have a fixed size. A cell's weight is the lower confidence bound of its log-odds between toxic and other labelled documents under
an informative Dirichlet prior (the pooled frequencies, PRIOR times their count); a token has the best weight of its word and
beginnings, which covers inflected and unseen words; all tokens also cost DRIFT, so a text without evidence drifts downwards.
A linear scan (Ruzzo and Tompa 1999) finds every maximal segment; the chance of such a segment in clean text of that
length follows Karlin and Altschul: E = K * n * exp(-lambda * S), with lambda from the clean tokens' scores and K from the
clean documents' best segments. Segments with E below SIGNIFICANT are toxic passages; the document's score is a
logistic function of its best segment's -ln E.

The labelled rows used for learning are at most SAMPLE (those with the smallest hash of the key): three quarters of them
make the weights, the rest the calibration. Equal texts count once there. Scores are made for all documents. Tasks sum their counts
in arrays of 2**BUCKET_BITS numbers; the JVM neither sorts texts nor groups cells, and learning reads few rows at a time.

Defined cases: null, empty and word-free texts have no segment and get the score of "no evidence"; labels without key or
mark are ignored, a key labelled twice counts as toxic if any mark is; without labels of both kinds all scores are 0;
rows with a null key are scored and never held out; repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import FEWER, capped

BUCKET_BITS = 20
SAMPLE = 50_000
PREFIXES = (5, 6, 7, 8, 9)
PRIOR = 0.05
DEVIATIONS = 2.0
DRIFT = 0.25
SIGNIFICANT = 0.01
#: Cells whose counts are a row of the tables between tasks.
PART = 1 << 11
_COUNTS = ["part", "cells", "n0", "n1"]
_COUNTED = "part int, cells binary, n0 binary, n1 binary"


@dataclass
class Model:
    """weights by bucket (without drift), the extreme-value parameters and the logistic calibration."""

    weights: np.ndarray
    decay: float
    scale: float
    slope: float
    offset: float

    def expected(self, score: float, n: int) -> float:
        """How many segments with this score or more clean text of n tokens has."""
        return self.scale * max(n, 1) * math.exp(-min(self.decay * score, 700.0))

    def chance(self, score: float, n: int) -> float:
        """The chance that a document is toxic."""
        x = -math.log(max(self.expected(score, n), 1e-300)) if score > 0 else 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * min(x, 200.0)))))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """The words, and the cells of each (rows: the word, its beginnings)."""
    words = K.Words(data, offsets, K.ALNUM_WORD, PREFIXES)
    return words, np.concatenate([_buckets(words.hashes)[None], _buckets(words.begins)])


def segments(positions: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence that is -drift but at these positions: (score, first, last)."""
    held: list[tuple[float, float, int, int]] = []  # (sum before, sum after, first, last)
    total, next_at = 0.0, 0
    for at, score in zip(positions.tolist(), scores.tolist(), strict=True):
        total -= drift * (at - next_at)
        next_at = at + 1
        low, high, first = total, total + score, at
        total = high
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= low:
                j -= 1
            if j < 0 or held[j][1] >= high:
                break
            low, first = held[j][0], held[j][2]
            del held[j:]
        held.append((low, high, first, at))
    return [(high - low, first, last) for low, high, first, last in held]


def _scan(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int, int]], K.Words, int]]:
    """For each document: tokens, segments (words counted from its first), the words, and where its words start."""
    words, cells = _words(data, offsets)
    own = weights[cells[0]]
    for row in cells[1:]:
        np.maximum(own, weights[row], out=own)
    own -= np.float32(DRIFT)
    good = np.flatnonzero(own > 0)
    cut = np.searchsorted(good, words.offsets)
    for d in range(len(offsets) - 1):
        lead = int(words.offsets[d])
        at = good[cut[d] : cut[d + 1]]
        yield int(words.offsets[d + 1]) - lead, segments(at - lead, own[at].astype(float)) if len(at) else [], words, lead


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, mark: str, train, limit: int) -> DataFrame:
    """At most limit labelled documents with key, _text and _mark; equal texts once. The labels broadcast are at most limit rows."""
    rows = labels.select(F.col(key).alias("_key"), F.col(mark).cast("int").alias("_mark")).where(F.col("_key").isNotNull() & F.col("_mark").isNotNull())
    rows = rows.where(train(F.col("_key"))).groupBy("_key").agg(F.max("_mark").alias("_mark")).orderBy(F.xxhash64("_key"), "_key").limit(limit)
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rows), "_key")


def _changes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows (hash of the text, text, mark), but of equal texts only the first and the first toxic one; and which of these were clean before."""
    toxic: dict[int, bool] = {}
    for batch in batches:
        keep, turned = [], []
        for i, (t, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            had = toxic.get(t)
            if had is None or mark > 0 and not had:
                toxic[t] = mark > 0
                keep.append(i)
                turned.append(had is not None)
        yield batch.take(pa.array(keep, pa.int64())), np.array(turned, bool)


def _firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _ in _changes(batches):
        yield batch


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic (n1) and clean (n0) texts of the task have each cell, a row for each part. Texts aren't kept: one that turns out toxic later moves its cells."""
    n0, n1 = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch, turned in _changes(batches):
        data, offsets = K.text_bytes(batch.column(1))
        marks = np.asarray(batch.column(2)) > 0
        for i, j in K.pieces(offsets):
            words, cells = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            seen = np.unique(cells | (words.docs() << BUCKET_BITS))  # a document counts a cell once
            docs, cells = i + (seen >> BUCKET_BITS), seen & ((1 << BUCKET_BITS) - 1)
            for n, of, step in ((n1, marks, 1), (n0, ~marks, 1), (n0, turned, -1)):
                np.add.at(n, cells[of[docs]], step)
    yield from _packed(n0, n1)


def _packed(n0: np.ndarray, n1: np.ndarray) -> Iterator[pa.RecordBatch]:
    cells = np.flatnonzero(n0 + n1)
    cuts = np.searchsorted(cells, np.arange(0, (1 << BUCKET_BITS) + 1, PART))
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        own = cells[cuts[part] : cuts[part + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (own, n0[own], n1[own]))], _COUNTS)


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of _count."""
    n0, n1 = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for cells, y0, y1 in zip(*(column.to_pylist() for column in batch.columns[1:]), strict=True):
            cells = np.frombuffer(cells, np.int64)  # each once in a row
            n0[cells] += np.frombuffer(y0, np.int64)
            n1[cells] += np.frombuffer(y1, np.int64)
    yield from _packed(n0, n1)


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "toxic", train: Callable = lambda key: F.lit(True), sample: int = SAMPLE) -> Model:
    """Weights and calibration from at most `sample` labelled rows for which train(key) holds."""
    spark = docs.sparkSession
    rows = _sample(docs, labels, key, text, mark, train, sample).withColumn("_fit", F.pmod(F.xxhash64("_text", F.lit(1)), F.lit(4)) > 0)

    texts = rows.where("_fit").select(F.xxhash64("_text").alias("_t"), "_text", "_mark")
    # Once a task before the shuffle, so that copies of a text don't all go to one; once an equal text after it.
    counts = texts.mapInArrow(_firsts, texts.schema).repartition("_t").mapInArrow(_count, _COUNTED).repartition("part").mapInArrow(_total, _COUNTED)
    with capped(spark, FEWER):
        table = counts.toArrow().sort_by("part")  # at most 2**BUCKET_BITS cells
    cells, y0, y1 = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in _COUNTS[1:])
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if not y1.sum() or not y0.sum():
        return Model(weights, 1.0, 1.0, 0.0, -50.0)
    prior = PRIOR * (y1 + y0)
    n1, n0, all_ = y1.sum(), y0.sum(), prior.sum()
    odds = np.log((y1 + prior) / (n1 + all_ - y1 - prior)) - np.log((y0 + prior) / (n0 + all_ - y0 - prior))
    weights[cells] = np.maximum(odds - DEVIATIONS * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)), 0)
    scored = weights[cells] - DRIFT
    p = y0 + prior
    p = p / p.sum()
    low, high = 1e-3, 20.0  # lambda: the clean tokens' mean of exp(lambda * score) is 1
    if (p * scored).sum() < 0 and scored.max() > 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * scored, 600))).sum() < 1 else (low, mid)
    decay = (low + high) / 2 if scored.max() > 0 else 1.0
    shipped = spark.sparkContext.broadcast(weights)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for i, j in K.pieces(offsets):
                found = [(n, max((s for s, _, _ in own), default=0.0)) for n, own, _, _ in _scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shipped.value)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()), batch.column(1).slice(i, j - i)], ["n", "s", "mark"])

    with capped(spark, FEWER):
        table = rows.where(~F.col("_fit")).select("_text", "_mark").mapInArrow(best, "n long, s double, mark int").toArrow()  # at most `sample` rows
    n, s, y = np.asarray(table["n"]).astype(float), np.asarray(table["s"]).astype(float), np.asarray(table["mark"]) > 0
    clean = ~y
    scale = clean.sum() / max((np.maximum(n[clean], 1) * np.exp(-decay * s[clean])).sum(), 1e-9) if clean.any() else 1.0
    model = Model(weights, decay, float(max(scale, 1e-9)), 1.0, 0.0)
    if len(y):
        x = np.array([min(-math.log(max(model.expected(a, int(b)), 1e-300)), 200.0) if a > 0 else 0.0 for a, b in zip(s, n, strict=True)])
        model.slope, model.offset = _logistic(x, y.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression with a weak Gaussian prior, by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b + a * x, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


PASSAGES = "array<struct<start:long,end:long,score:double,expected:double>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", significant: float = SIGNIFICANT) -> DataFrame:
    """For each row: key, score (0 to 1), predicted (1 from 0.5 on) and passages: every significant segment, in code points."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                scores, passages = [], []
                for d, (n, own, words, lead) in enumerate(_scan(part, offsets[i : j + 1] - offsets[i], m.weights)):
                    scores.append(m.chance(max((s for s, _, _ in own), default=0.0), n))
                    found = []
                    base, past = (int(offsets[i + d + x] - offsets[i]) for x in (0, 1))
                    chars = None  # code points before each byte of the text, once it has a passage
                    for s, first, last in own:
                        if (e := m.expected(s, n)) <= significant:
                            if chars is None:
                                chars = np.concatenate(([0], np.cumsum((part[base:past] & 0xC0) != 0x80)))
                            a, b = int(words.starts[lead + first]) - base, int(words.ends[lead + last]) - base
                            found.append({"start": int(chars[a]), "end": int(chars[b]), "score": s, "expected": e})
                    passages.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, _ARROW)], [key, "score", "predicted", "passages"])

    schema = T.StructType([docs.schema[key], *T._parse_datatype_string(f"score double, predicted int, passages {PASSAGES}").fields])
    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, schema)

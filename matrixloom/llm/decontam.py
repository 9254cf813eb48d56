"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every token window.

Words are runs of ASCII digits, ASCII letters (in lower case) and characters beyond ASCII. An item's windows are its runs
of WINDOW consecutive words; an item with fewer words, but some, is one window. A window found by its hash is confirmed
on its words. Every document word inside an occurrence of a window is hit.

The broadcast holds at most MAX_WINDOWS windows. A larger benchmark is dealt with in several parts, each with a scan
of its own over the texts as they came, whose findings are written before the broadcast goes and the next part comes; the
findings are united by row. So one bounded index is in memory at a time whatever the benchmark has, and the result doesn't
depend on the number of parts. For that, rows get numbers and are written once.

Defined cases: a null or empty text, or one without words, has no words and no hits; an item without words (or null)
has no windows; an item with a null id hits but is not named; equal windows of several items name them all; repeated
rows and columns besides the key and the text change nothing; an empty benchmark hits nothing.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import materialize

WINDOW = 10
MAX_WINDOWS = 1_000_000
BITS = 20


class Index:
    """The windows of some items, by length: hashes in order, and their words and items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.known: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = K.Words(raw, np.array([0, len(raw)]), K.ALNUM_WORD)
            n = min(window, len(words.hashes))
            if n:
                low = K.LOWER[raw].tobytes()
                for i, h in enumerate(K.windows(words.hashes, n).tolist()):
                    key = b" ".join(low[s:e] for s, e in zip(words.starts[i : i + n], words.ends[i : i + n], strict=True))
                    self.known.setdefault(n, {}).setdefault(h, {}).setdefault(key, set()).update(() if name is None else (name,))
        self.sieve = {}
        for n, found in self.known.items():
            sieve = np.zeros(1 << BITS, bool)
            sieve[np.fromiter(found, np.uint64, len(found)) >> np.uint64(64 - BITS)] = True
            self.sieve[n] = sieve

    def __len__(self) -> int:
        return sum(map(len, self.known.values()))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray, dict[int, set[str]]]:
        """The words, which of them are hit, and the items by document."""
        words = K.Words(data, offsets, K.ALNUM_WORD)
        docs, hit, items = words.docs(), np.zeros(len(words.hashes), bool), {}
        for n, known in self.known.items():
            hashes = K.windows(words.hashes, n)
            for i in np.flatnonzero(self.sieve[n][hashes >> np.uint64(64 - BITS)] & (docs[: len(hashes)] == docs[n - 1 :])).tolist():
                if found := known.get(int(hashes[i])):
                    key = b" ".join(K.LOWER[data[s:e]].tobytes() for s, e in zip(words.starts[i : i + n], words.ends[i : i + n], strict=True))
                    if key in found:
                        hit[i : i + n] = True
                        items.setdefault(int(docs[i]), set()).update(found[key])
        return words, hit, items


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of hit words."""
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _parts(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[Index]:
    """Indexes of at most about `most` windows, over all items."""
    part: list[tuple[str | None, str]] = []
    size = 0
    for name, words in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        part.append((name, words))
        size += len(words or "") // 2 + 1  # at least the windows it can have
        if size >= most:
            yield Index(part, window)
            part, size = [], 0
    if part:
        yield Index(part, window)


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _indexes(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> tuple[Index, Iterator[Index] | None]:
    """The first index, and all of them if there are several."""
    found = (index for index in _parts(benchmark, item, text, window, most) if len(index))
    first = next(found, None) or Index([], window)
    second = next(found, None)
    return first, itertools.chain([first, second], found) if second else None


def _each(rows: DataFrame, by: str, text: str, indexes: Iterator[Index]) -> Iterator[DataFrame]:
    """What each part finds, written; its broadcast is gone before the next one comes. After the first part, rows without hits are left out."""
    for i, index in enumerate(indexes):
        shipped = rows.sparkSession.sparkContext.broadcast(index)
        found = _scanned(rows, by, text, shipped)
        yield materialize(found.where("size(hits) > 0") if i else found, "hits")
        shipped.destroy()


def _scanned(docs: DataFrame, key: str, text: str, index) -> DataFrame:
    """For each row: key, and what one part finds."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.pieces(offsets):
                words, hit, items = index.value.scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spans: list[list] = [[] for _ in range(j - i)]
                at = words.docs()
                hit_from = np.flatnonzero(hit)
                if len(hit_from):
                    edges = np.flatnonzero((np.diff(hit_from) > 1) | (np.diff(at[hit_from]) > 0))
                    for a, b in zip(hit_from[np.concatenate(([0], edges + 1))].tolist(), hit_from[np.concatenate((edges, [len(hit_from) - 1]))].tolist(), strict=True):
                        d = int(at[a])
                        lead, base = int(words.offsets[d]), int(offsets[i + d] - offsets[i])
                        spans[d].append({"first": a - lead, "last": b - lead, "start": int(words.starts[a]) - base, "end": int(words.ends[b]) - base})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(words.offsets), pa.int64()), pa.array(spans, _HITS), pa.array([sorted(items.get(d, ())) for d in range(j - i)], pa.list_(pa.string()))],
                    [key, "n_words", "hits", "items"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, T.StructType([docs.schema[key], *FOUND.fields]))


def _united(every: list[DataFrame], by: str) -> DataFrame:
    """What several parts find, united by a column; runs that meet are one."""
    merged = functools.reduce(DataFrame.unionByName, every).groupBy(by).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = F.expr(
        "aggregate(array_sort(hits), cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>), (done, x) -> "
        "if(size(done) > 0 and element_at(done, -1).last + 1 >= x.first, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last), 'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end)))), "
        "concat(done, array(x))))"
    )
    return merged.withColumn("hits", united)


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """For each row of docs: key, n_words, hits (runs of hit words: first and last word, start and end byte) and items (names in order)."""
    first, every = _indexes(benchmark, item, text, window, max_windows)
    if every is None:
        return _scanned(docs, key, text, docs.sparkSession.sparkContext.broadcast(first))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    numbered = materialize(rows, "numbered").select(F.struct("_row", "_key").alias("_id"), "_text")
    return _united(list(_each(numbered, "_id", "_text", every)), "_id").select(F.col("_id._key").alias(key), "n_words", "hits", "items")


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated, from what hits() returns."""
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.last - x.first + 1)")
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _stripped(raw: bytes, spans: Iterable[tuple[int, int]]) -> str:
    """The text without these spans of bytes."""
    left, done = [], 0
    for start, end in spans:
        left.append(raw[done:start])
        done = end
    return b"".join([*left, raw[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, most_hit: float = 0.5, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the hit passages; a document with more than most_hit of its words hit goes as a whole.

    All other rows and columns stay as they are. One scan, no shuffle, for a benchmark within max_windows windows. For a larger
    one, each part scans the original texts, and the rows are cut once, by the hits of all parts; they are joined with these by number.
    """
    place = docs.columns.index(text)
    schema = docs.schema
    first, every = _indexes(benchmark, item, text, window, max_windows)
    if every is not None:
        return _cut(docs, place, every, most_hit)

    def strip(batches: Iterable[pa.RecordBatch], index=docs.sparkSession.sparkContext.broadcast(first)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(place))
            for i, j in K.pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                words, hit, items = index.value.scan(part, offsets[i : j + 1] - offsets[i])
                rows = batch.slice(i, j - i)
                if items or hit.any():
                    at, texts, keep = words.docs(), rows.column(place).to_pylist(), np.ones(j - i, bool)
                    for d in np.unique(at[hit]).tolist():
                        own = hit[words.offsets[d] : words.offsets[d + 1]]
                        if own.mean() > most_hit:
                            keep[d] = False
                            continue
                        base = int(offsets[i + d] - offsets[i])
                        texts[d] = _stripped(texts[d].encode(), ((int(words.starts[words.offsets[d] + a]) - base, int(words.ends[words.offsets[d] + b]) - base) for a, b in zip(*_runs(own), strict=True)))
                    rows = rows.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type)).filter(pa.array(keep))
                yield rows

    return docs.mapInArrow(strip, schema)


def _cut(docs: DataFrame, place: int, indexes: Iterator[Index], most_hit: float) -> DataFrame:
    """docs cut by the hits of several parts. Columns go by position, whatever their names."""
    schema, names = docs.schema, [f"_c{i}" for i in range(len(docs.columns))]
    numbered = materialize(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    united = _united([x.where("size(hits) > 0") for x in _each(numbered, "_row", names[place], indexes)], "_row")
    n_hit = F.expr("aggregate(hits, 0L, (n, x) -> n + x.last - x.first + 1)")
    found = united.select("_row", (n_hit / F.col("n_words") > most_hit).alias("_gone"), F.expr("transform(hits, x -> x.start)").alias("_starts"), F.expr("transform(hits, x -> x.end)").alias("_ends"))

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts = columns[place].to_pylist()
            for d, (starts, ends) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if starts:
                    texts[d] = _stripped(texts[d].encode(), zip(starts, ends, strict=True))
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return numbered.join(found, "_row", "left").where("not coalesce(_gone, false)").select(*names, "_starts", "_ends").mapInArrow(strip, schema)


def items_digest(names: Iterable[str]) -> str:
    """The digest of item names, as digest() has it."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

"""Suffix-array dedup: remove every byte that lies in a LENGTH-byte string which also starts anywhere else.

Suffixes are bucketed, and one bucket at a time is sorted, with long ties resolved by the ranks of a difference-cover sample
(Kärkkäinen 2007, blockwise suffix sorting). What makes it affordable on a cluster is which suffixes are sorted:

1. Anchors. Each LENGTH-byte window has an anchor, the least of its GRAM-byte grams by hash (the leftmost of equals). Consecutive
   windows with one anchor are a run, so the runs, about 1.5 % of the bytes, partition all window starts. Equal windows have
   equal anchors at equal places. So an anchor's gram is the bucket of its windows' suffixes.
2. Runs are shuffled by gram, packed into blocks. Runs with equal content (from their first window's first byte to their last
   window's last) prove each other's windows repeated without sorting: whole copies and the insides of long repeats end here.
   Grams with one kind of run have no other repeats: ends of unique text.
3. What remains are grams with several kinds of runs: the borders of repeats. One run of each kind is fetched from its
   document, and each bucket's suffixes are sorted. Runs are laid out with their anchors at multiples of COVER_MOD, so that two
   suffixes at equal distance from their anchors lie at the same residue, and one look-up in the cover sample's ranks orders what
   follows their first 16 bytes. Neighbours in that order that share LENGTH bytes are repeated.
4. A gram with more than MANY kinds of runs (a line that very many documents share, in different surroundings) isn't gathered:
   its windows are told apart by 128-bit fingerprints instead, in sorted streams.

Found intervals meet their documents by row number. Only documents with intervals, and those with borders, are shuffled.

Rows are told apart by numbers, given and written once with their texts. Defined cases: a null
text is empty; texts shorter than LENGTH bytes lose nothing; matches never cross texts; equal rows repeat each other; very
long texts are handled in stretches; rows with a null key are treated like others; an empty table gives an empty result.
Runs are compared by two 64-bit hashes of unlike kinds (of their gram's bytes, and of all their 8-byte words, mixed); windows of
sorted buckets by their bytes; windows of case 4 by two fingerprints with independent weights for each of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import materialize, only_ids

LENGTH = 200
GRAM = 64
MANY = 4000
#: Runs in a bucket on average, and bytes of runs that are sorted at a time.
BUCKET_RUNS = 250_000
BLOCK = 1 << 20
# A perfect difference set modulo 31; every difference of two residues occurs.
COVER_MOD, COVER = 31, (0, 1, 3, 8, 12, 18)
U = np.uint64

_IN_COVER = np.zeros(COVER_MOD, bool)
_IN_COVER[list(COVER)] = True
#: From each residue, how far it is to the next one in the cover: below 16.
_TO_COVER = np.array([next(d for d in range(COVER_MOD) if _IN_COVER[(q + d) % COVER_MOD]) for q in range(COVER_MOD)])
assert _TO_COVER.max() < 16 and len({(a - b) % COVER_MOD for a in COVER for b in COVER}) == COVER_MOD


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(packed: bytes, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays: kinds gives each one's type and length."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of some texts: first and last window start, anchor, hash of the gram, hash of the content."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U), none.astype(U)
    up, down = K.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(data * up[:n], out=sums[1:])
    grams = K.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    value = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    w = length - gram + 1
    padded = np.full(-(-len(value) // w) * w, U(2**64 - 1), U)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U(0xFFFFFFFF)).astype(np.int64)
    mark = np.zeros(n + 2, np.int8)
    long = np.diff(offsets) >= length
    mark[offsets[:-1][long]] += 1
    mark[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(mark[:m], dtype=np.int8) > 0
    change = np.ones(m, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    end = np.ones(m, bool)
    end[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(valid & end)
    anchor = anchor[first]
    mixed = np.zeros(n - 6, U)  # mixing makes the sum unlike one of bytes, which regular strings can deceive
    np.cumsum(K.mix(_words(np.concatenate([data, np.zeros(8, np.uint8)]))[: n - 7]) * up[: n - 7], out=mixed[1:])
    content = K.mix((mixed[last + length - 7] - mixed[first]) * down[first] + K.mix((anchor - first).astype(U) << U(16) ^ (last - first).astype(U)))
    return first, last, anchor, grams[anchor], content


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, byte where it begins in the first, bytes, offsets); texts beyond two pieces come in stretches that share length - 1 bytes."""
    for i, j in K.pieces(offsets):
        if j - i == 1 and offsets[j] - offsets[i] > 2 * K.PIECE:
            size = int(offsets[j] - offsets[i])
            for at in range(0, size - length + 1, K.PIECE):
                part = data[offsets[i] + at : min(offsets[i] + at + K.PIECE + length - 1, offsets[j])]
                yield i, j, at, part, np.array([0, len(part)])
        else:
            yield i, j, 0, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _make_runs(length: int, gram: int, buckets: int):
    """Texts to packed runs: bucket, number, and arrays (gram, content, row, first, last - first, anchor - first)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0)).astype(np.int64)
            data, offsets = K.text_bytes(batch.column(1))
            for i, _, at, part, cut in _stretches(data, offsets, length):
                first, last, anchor, h, r = window_runs(part, cut, length, gram)
                if not len(first):
                    continue
                bucket = (h % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                doc = np.searchsorted(cut, first, "right") - 1
                columns = [x[order] for x in (h, r, rows[i + doc], (first - cut[doc] + at).astype(np.int64), (last - first).astype(np.int16), (anchor - first).astype(np.int16))]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.diff(edges)[full].astype(np.int32)), pa.array([_pack(*(c[edges[b] : edges[b + 1]] for c in columns)) for b in full], pa.binary())], ["bucket", "n", "packed"]
                )

    return scan


def _by_bucket(batches: Iterable[pa.RecordBatch], read) -> Iterator[list]:
    """What read(row) gives for all rows of a bucket; rows come sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != at and held:
                yield held
                held = []
            at = row["bucket"]
            held.append(read(row))
    if held:
        yield held


_RUN = ["<u8", "<u8", "<i8", "<i8", "<i2", "<i2"]
_FOUND = "kind int, gram long, row long, first long, span int, anchor int, done boolean, many boolean"


def _match_runs(many: int):
    """Buckets of runs to: kind 0, runs whose content comes twice; kind 1, one run of each content, for grams with several."""

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches, lambda x: _unpack(x["packed"], [(k, x["n"]) for k in _RUN])):
            h, r, row, first, span, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((r, h))
            h, r, row, first, span, anchor = (x[order] for x in (h, r, row, first, span, anchor))
            new_gram = np.ones(len(h), bool)
            new_gram[1:] = h[1:] != h[:-1]
            new = new_gram.copy()
            new[1:] |= r[1:] != r[:-1]
            kind = np.cumsum(new) - 1
            twice = (np.bincount(kind) > 1)[kind]
            g = np.cumsum(new_gram) - 1
            kinds = np.bincount(g, new).astype(np.int64)[g]
            for label, at in ((0, np.flatnonzero(twice)), (1, np.flatnonzero(new & (kinds > 1)))):
                for s in range(0, len(at), 50_000):
                    a = at[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), label, np.int32)), pa.array(h[a].view(np.int64)), pa.array(row[a]), pa.array(first[a]), pa.array(span[a].astype(np.int32)), pa.array(anchor[a].astype(np.int32)), pa.array(twice[a]), pa.array(kinds[a] > many)],
                        ["kind", "gram", "row", "first", "span", "anchor", "done", "many"],
                    )

    return match


def _fetch(length: int, buckets: int, many: bool):
    """A text and its border runs to packed runs with their bytes, by bucket; or to the fingerprints of their windows."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            runs = batch.column("runs")
            counts = np.diff(np.asarray(runs.offsets))
            flat = runs.flatten()
            gram, first, span, anchor, done = (np.asarray(flat.field(c)) for c in ("gram", "first", "span", "anchor", "done"))
            doc = np.repeat(np.arange(len(counts)), counts)
            row, start = np.asarray(batch.column("_row"))[doc], offsets[doc] + first
            for s in range(0, len(gram), 4096):
                e = min(s + 4096, len(gram))
                if many:
                    n = span[s:e].astype(np.int64) + 1
                    at = np.repeat(start[s:e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    prints = [_fingerprints(data, at, length, seed) for seed in (1, 2)]
                    which = np.repeat(np.arange(s, e), n)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in prints), pa.array(row[which]), pa.array(first[which] + at - start[which]), pa.array(done[which])], ["a", "b", "row", "first", "done"])
                    continue
                bucket = (gram[s:e].view(U) % U(buckets)).astype(np.int64)
                out = []
                for b in np.unique(bucket).tolist():
                    k = s + np.flatnonzero(bucket == b)
                    size = (span[k] + length).astype(np.int64)
                    text = np.concatenate([data[x : x + n] for x, n in zip(start[k].tolist(), size.tolist(), strict=True)])
                    out.append((b, len(k), len(text), _pack(gram[k].astype("<i8"), row[k].astype("<i8"), first[k].astype("<i8"), span[k].astype("<i2"), anchor[k].astype("<i2"), done[k].astype("u1"), text)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], ["bucket", "n", "size", "packed"])

    return fetch


def _fingerprints(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of the `length` bytes at each place."""
    weights = K.mix(np.arange(1, length + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)
    out = np.zeros(len(at), U)
    for i in range(length):
        out += (data[at + i].astype(U) + U(1)) * weights[i]
    return K.mix(out)


def _words(data: np.ndarray) -> np.ndarray:
    """At each byte, the next 8 bytes as a number that orders like them; data ends with at least 8 bytes of padding."""
    x = data.astype(U)
    for shift in (1, 2, 4):
        ahead = np.zeros_like(x)
        ahead[:-shift] = x[shift:]
        x = (x << U(8 * shift)) | ahead
    return x


def _ranks(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Dense ranks of rows by keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_block(data: np.ndarray, at: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of a block that begin at `at` within their groups, and finds which have `length` bytes in common with a neighbour.

    Suffixes of one group must lie at one residue modulo COVER_MOD. data ends with length + 300 bytes of padding. Returns the order and
    whether each suffix (as given) shares its first `length` bytes with another one of its group.
    """
    words = _words(data)
    sample = np.flatnonzero(_IN_COVER[np.arange(len(data) - 300) % COVER_MOD])
    place = np.full(len(data), -1, np.int64)
    place[sample] = np.arange(len(sample))
    rank, depth = _ranks(tuple(words[sample + 8 * i] for i in range(4))), COVER_MOD
    while depth < length:  # ranks of the sample by ever more bytes: the next ones are those of the sample `depth` bytes further
        further = place[np.minimum(sample + depth, len(data) - 1)]
        rank, depth = _ranks((rank, np.where(further >= 0, rank[further] + 1, 0))), depth * 2
    tie = rank[place[at + _TO_COVER[at % COVER_MOD]]]
    order = np.lexsort((tie, words[at + 8], words[at], groups))
    a, b = at[order[:-1]], at[order[1:]]
    same = groups[order[:-1]] == groups[order[1:]]
    for i in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = words[a[live] + i] == words[b[live] + i]
    repeated = np.zeros(len(at), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return order, repeated


def _sort_buckets(length: int):
    """Buckets of border runs to intervals (row, start, end) of repeated windows."""

    def block(gram, row, first, span, anchor, done, texts):
        size = span.astype(np.int64) + length
        slot = (size + 2 * COVER_MOD - 2) // COVER_MOD * COVER_MOD
        start = np.cumsum(slot) - slot + (-anchor.astype(np.int64)) % COVER_MOD  # anchors at multiples of COVER_MOD
        data = np.zeros(int(slot.sum()) + length + 400, np.uint8)
        data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = texts
        n = span.astype(np.int64) + 1
        run = np.repeat(np.arange(len(n)), n)
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
        groups = (g[run] << 16) + (t - anchor[run] + (1 << 15))
        _, repeated = sort_block(data, start[run] + t, groups, length)
        repeated &= done[run] == 0
        begins = repeated.copy()
        begins[1:] &= ~(repeated[:-1] & (run[1:] == run[:-1]))
        ends = repeated.copy()
        ends[:-1] &= ~(repeated[1:] & (run[1:] == run[:-1]))
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        return pa.RecordBatch.from_arrays([pa.array(row[run[b]]), pa.array(first[run[b]] + t[b]), pa.array(first[run[e]] + t[e] + length)], ["row", "start", "end"])

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: _unpack(x["packed"], [("<i8", x["n"]), ("<i8", x["n"]), ("<i8", x["n"]), ("<i2", x["n"]), ("<i2", x["n"]), ("u1", x["n"]), ("u1", x["size"])])
        for held in _by_bucket(batches, read):
            gram, row, first, span, anchor, done, texts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = span.astype(np.int64) + length
            begin = np.cumsum(size) - size
            order = np.argsort(gram, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], np.diff(gram[order]) != 0, [True])))
            total = np.concatenate(([0], np.cumsum(size[order])))
            s = 0
            while s < len(new) - 1:  # whole grams, of about BLOCK bytes together
                e = max(s + 1, int(np.searchsorted(total[new], total[new[s]] + BLOCK, "right")) - 1)
                k = order[new[s] : new[e]]
                where = np.repeat(begin[k], size[k]) + np.arange(size[k].sum()) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
                yield block(gram[k], row[k], first[k], span[k], anchor[k], done[k], texts[where])
                s = e

    return sort


def _match_prints(length: int):
    """Windows sorted by fingerprint to intervals of those that come twice; nothing but the last window is held."""

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last window, if it hasn't been returned: (a, b, row, first, done)
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, row, first, done = (np.asarray(batch.column(c)) for c in ("a", "b", "row", "first", "done"))
            as_before = np.zeros(len(a), bool)
            as_before[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            as_before[0] = last == (a[0], b[0])
            twice = as_before.copy()
            twice[:-1] |= as_before[1:]
            if as_before[0] and held is not None and not held[1]:
                yield pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[0][1]]), pa.array([held[0][1] + length])], ["row", "start", "end"])
            out = np.flatnonzero(twice & ~done)
            yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(first[out]), pa.array(first[out] + length)], ["row", "start", "end"])
            last = (a[-1], b[-1])
            held = ((int(row[-1]), int(first[-1])), bool(done[-1])) if not twice[-1] else None

    return match


def repeats(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(row, start, end): intervals of bytes that are repeated, by row number; they may overlap. Written to the shared folder.

    rows is a written table with each text and its number, `_row`.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 64
    while buckets * BUCKET_RUNS < total * 2 / (length - gram):
        buckets *= 2
    tasks = min(buckets, 4096)
    rows = rows.select("_row", "text")
    runs = rows.mapInArrow(_make_runs(length, gram, buckets), "bucket int, n int, packed binary")
    found = materialize(runs.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_match_runs(many), _FOUND), "runs")
    borders = found.where("kind = 1")

    def texts_of(chosen: DataFrame) -> DataFrame:
        by_row = chosen.groupBy("row").agg(F.collect_list(F.struct("gram", "first", "span", "anchor", "done")).alias("runs"))  # at most a text's own runs
        return only_ids(rows, chosen.select("row").distinct(), "_row").join(by_row, F.col("_row") == F.col("row")).select("_row", "text", "runs")

    packed = texts_of(borders.where("not many")).mapInArrow(_fetch(length, buckets, False), "bucket int, n int, size int, packed binary")
    sorted_ = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(length), "row long, start long, end long")
    prints = texts_of(borders.where("many")).mapInArrow(_fetch(length, buckets, True), "a long, b long, row long, first long, done boolean")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    streamed = prints.repartition(n, "a").sortWithinPartitions("a", "b").mapInArrow(_match_prints(length), "row long, start long, end long")
    copies = found.where("kind = 0").select("row", F.col("first").alias("start"), (F.col("first") + F.col("span") + length).alias("end"))
    return copies.union(materialize(sorted_, "borders")).union(materialize(streamed, "prints"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: key, n_bytes, spans (maximal removed runs: start and end byte) and kept (the remaining bytes)."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("text")), "numbered")
    found = repeats(numbered, length=length)
    rows = numbered.select("_row", F.col("_key").alias(key), F.col("text").alias("_text"))
    ids = materialize(found.select("row").distinct(), "rows")
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            found = batch.column(2)
            counts = np.where(np.asarray(found.is_valid()), np.diff(np.asarray(found.offsets)), 0) if batch.num_rows else np.empty(0, np.int64)
            flat = found.flatten()
            begins, ends = np.asarray(flat.field("start")), np.asarray(flat.field("end"))
            at = np.concatenate(([0], np.cumsum(counts)))
            for i, j in K.pieces(offsets):
                spans, kept = [], []
                for d in range(i, j):
                    s, e = begins[at[d] : at[d + 1]], ends[at[d] : at[d + 1]]
                    raw = data[offsets[d] : offsets[d + 1]]
                    if not len(s):
                        spans.append([])
                        kept.append(raw.tobytes())
                        continue
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    s, e = s[new], e[np.concatenate((new[1:], [True]))]
                    spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                    kept.append(b"".join(raw[a:b].tobytes() for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    by_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # at most a text's own runs and borders
    touched = only_ids(rows, ids, "_row").join(by_row, F.col("_row") == F.col("row"), "left").select(key, "_text", "found")
    untouched = only_ids(rows, ids, "_row", others=True).select(key, "_text", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("found"))
    return touched.mapInArrow(cut, schema).union(untouched.mapInArrow(cut, schema))

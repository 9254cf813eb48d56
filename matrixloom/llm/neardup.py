"""MinHash near-dedup: fast similarity sketching, banding, and exact verification on full shingle sets.

Sketch (Dahlgaard, Knudsen, Thorup 2017): each shingle is thrown into one of T bins in each of up to T rounds, a lower round
always winning; in the rounds after, bin j takes the least hash of all shingles. So every coordinate fills, after O(n + T log T)
expected hashes, and the share of equal coordinates concentrates around the Jaccard similarity like that of T independent ones.

Banding: BANDS bands of ROWS coordinates. Two documents of similarity 0.75 share no band with chance (1 - 0.75**5)**48, about 2 in a
million. Documents with equal shingle sets (by a 128-bit hash) are one class before banding, so copies never meet each other.

Verification keeps every link's effect without all pairs of a bucket: in two rounds each member of a bucket meets one pivot (the
least by a hash, then the greatest), and confirmed links join components. Buckets whose members are all in one component are
done. In what remains, members outside a bucket's largest component meet its members of other components in blocks of BLOCK; those
whose sketches are at least ESTIMATE alike (more than 5 deviations below 0.75) are confirmed where they meet. A link is confirmed on whole texts: 100 * |A & B| >= 75 * |A | B|.

Texts travel only for candidates: a bitmap of fixed size spares the others the shuffle. A pivot with many members is dealt to
several tasks of at most SHARE members each.

Words are what lies between ASCII white space, A-Z in lower case; the set holds each 5 consecutive words, or the whole sequence of
fewer. Defined cases: null, empty and word-free texts have the empty set and link with nothing; rows that repeat a doc_id are
one document with all their texts, which it connects (each row is returned); rows with a null doc_id are returned with their set
size, no component, and not kept; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components, extended
from .shared import materialize, only_ids, release, tidied

SHINGLE = 5
SIMILAR = (75, 100)
ROWS, BANDS = 5, 48
BINS = ROWS * BANDS
#: Least share of equal coordinates for members of different components to be verified.
ESTIMATE = 0.6
BLOCK = 512
SHARE = 250
U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sets as 64-bit hashes, each in order, end to end; and offsets."""
    words = K.Words(data, offsets)
    count = np.diff(words.offsets)
    docs = words.docs()
    rows, hashes = [], []
    grams = K.windows(words.hashes, n)
    whole = docs[: len(grams)] == docs[n - 1 :] if len(grams) else np.empty(0, bool)
    rows.append(docs[: len(grams)][whole])
    hashes.append(grams[whole])
    for k in range(1, n):
        short = words.offsets[:-1][count == k]
        if len(short):
            rows.append(np.flatnonzero(count == k))
            hashes.append(K.windows(words.hashes, k)[short])
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def sketches(hashes: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of `bins` coordinates for each set; all ones for an empty set."""
    n = len(offsets) - 1
    empty = U(2**64 - 1)
    out = np.full(n * bins, empty, U)
    size = np.diff(offsets)
    todo = np.flatnonzero(size)
    for r in range(2 * bins):
        if not len(todo):
            break
        at = np.repeat(todo, size[todo])
        first = np.repeat(offsets[todo] - np.concatenate(([0], np.cumsum(size[todo])[:-1])), size[todo])
        own = K.mix(hashes[np.arange(len(at)) + first] ^ K.mix(np.array([r + 1], U)))
        value = (U(r) << U(54)) | (own >> U(10))
        if r < bins:
            cell = (own & U(0xFFFFFFFF)) * U(bins) >> U(32)  # low bits choose the bin, high bits the order
            np.minimum.at(out, at * bins + cell.astype(np.int64), value)
        else:
            starts = np.concatenate(([0], np.cumsum(size[todo])[:-1]))
            where = todo * bins + (r - bins)
            out[where] = np.minimum(out[where], np.minimum.reduceat(value, starts))
        todo = todo[(out.reshape(n, bins)[todo] == empty).any(axis=1)]
    return out.reshape(n, bins)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A key for each band."""
    x = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), x.shape[:2]).copy()
    for i in range(ROWS):
        out = K.mix(out * U(0x9FB21C651E98DF25) + x[:, :, i])
    return out.view(np.int64)


@K.frugal
def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and text to id, n_shingles, two hashes of the set, band keys, and coordinates cut to a byte."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        for i, j in K.pieces(offsets, K.PIECE // 2, most=2048):
            hashes, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sketch = sketches(hashes, cut)
            size = np.diff(cut)
            total = lambda x, cut=cut: np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))
            sums = [total(K.mix(hashes ^ U(seed))) for seed in (0x1234567, 0x89ABCDEF01)]
            a, b = (K.mix(s[cut[1:]] - s[cut[:-1]] + size.astype(U)).view(np.int64) for s in sums)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(bands(sketch).ravel()))
            cells = pa.array([row.tobytes() for row in K.mix(sketch).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(a), pa.array(b), keys, cells], ["id", "n_shingles", "a", "b", "bands", "cells"])


@K.frugal
def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot and share, with the pivot itself first; gives the members that link with it."""
    pivot, pivot_set = None, None
    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        pivots, shares, ids = (np.asarray(batch.column(c)) for c in ("pivot", "share", "id"))
        linked = np.zeros(len(ids), bool)
        for i, j in K.pieces(offsets, K.PIECE // 2):
            hashes, cut = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(i, j):
                own = hashes[cut[k - i] : cut[k - i + 1]]
                if (pivots[k], shares[k]) != pivot:
                    assert ids[k] == pivots[k], "the pivot comes first"
                    pivot, pivot_set = (pivots[k], shares[k]), own.copy()
                elif ids[k] != pivots[k]:
                    linked[k] = _links_with(pivot_set, own)
        yield pa.RecordBatch.from_arrays([pa.array(pivots[linked]), pa.array(ids[linked])], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (pivot, id) that link, as (a, b); written to the shared folder."""
    pairs = materialize(pairs, "pairs")
    counts = materialize(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "shares")
    dealt = pairs.join(counts, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id")
    heads = counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("pivot").alias("id"))
    ids = materialize(pairs.select("id").union(pairs.select("pivot")).distinct(), "ids")
    rows = dealt.union(heads).join(only_ids(texts, ids, "id"), "id").select("pivot", "share", "id", "text", (F.col("id") != F.col("pivot")).alias("member"))
    n = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartition(n, "pivot", "share").sortWithinPartitions("pivot", "share", "member", "id")
    return materialize(sorted_rows.mapInArrow(_verify, "a long, b long"), "links")


def _pivots(members: DataFrame, last: bool) -> DataFrame:
    """(pivot, id): each member with its bucket's least, or greatest, member by hash, where they aren't in one component (c) yet."""
    order = F.struct(F.xxhash64("id"), "id", "c")
    pivot = members.groupBy("key").agg((F.max if last else F.min)(order).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.id").alias("pivot"), F.col("p.c").alias("pc"))
    return members.join(materialize(pivot, "pivots"), "key").where("c <> pc").select("pivot", "id").distinct()


def _grouped(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """The buckets' members with their component, without buckets that lie in one component. Written to the shared folder."""
    members = materialize(buckets.join(groups.select("id", F.col("component_id").alias("g")), "id", "left").select("key", "band", "id", F.coalesce("g", "id").alias("c")), "members")
    mixed = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return materialize(members.join(materialize(mixed, "mixed"), "key"), "open")


def _links_with(pivot_set: np.ndarray, own: np.ndarray) -> bool:
    """Whether two sets, in order, are similar enough."""
    if not len(own) or not len(pivot_set):
        return False
    at = np.minimum(np.searchsorted(pivot_set, own), len(pivot_set) - 1)
    both = int((pivot_set[at] == own).sum())
    return SIMILAR[1] * both >= SIMILAR[0] * (len(own) + len(pivot_set) - both)


@K.frugal
def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and blocks: each member of a minority (side 1) meets the block's members (side 0) of other components.

    A pair is looked at in the first band that it shares, and once of the two ways round; a member that links with a component needs
    no more links with it. Gives the links found.
    """
    held: list[tuple] = []
    at = None

    def links():
        ids, groups, side, small, cells, keys, texts = (np.concatenate(x) if i < 6 else [t for y in x for t in y] for i, x in enumerate(zip(*held, strict=True)))
        sets: dict[int, np.ndarray] = {}

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                raw = np.frombuffer((texts[k] or "").encode(), np.uint8)
                sets[k] = shingle_sets(raw, np.array([0, len(raw)]))[0]
            return sets[k]

        all_ = np.flatnonzero(side == 0)
        a, b = [], []
        for i in np.flatnonzero(side == 1).tolist():
            others = all_[(groups[all_] != groups[i]) & (~small[all_] | (ids[all_] > ids[i]))]
            if not len(others):
                continue
            others = others[(keys[others] == keys[i]).argmax(axis=1) == at[3]]
            alike = (cells[others] == cells[i]).mean(axis=1)
            order = np.argsort(-alike, kind="stable")
            done = set()
            for k in others[order[: int((alike >= ESTIMATE).sum())]].tolist():
                if groups[k] not in done and _links_with(set_of(i), set_of(k)):
                    done.add(groups[k])
                    a.append(min(ids[i], ids[k]))
                    b.append(max(ids[i], ids[k]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        names = list(zip(*(np.asarray(batch.column(c)).tolist() for c in ("key", "x", "y", "band")), strict=True))
        ids, groups, side = (np.asarray(batch.column(c)) for c in ("id", "c", "side"))
        small = batch.column("small").to_numpy(zero_copy_only=False)
        cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(ids), BINS)
        keys = np.asarray(batch.column("bands").flatten()).reshape(len(ids), BANDS)
        texts = batch.column("text").to_pylist()
        s = 0
        while s < len(names):
            e = s + 1
            while e < len(names) and names[e] == names[s]:
                e += 1
            if names[s] != at:
                if held:
                    yield links()
                held, at = [], names[s]
            held.append((ids[s:e], groups[s:e], side[s:e], small[s:e], cells[s:e], keys[s:e], texts[s:e]))
            s = e
    if held:
        yield links()


def _remaining(members: DataFrame, sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) that still join components: between members of different components in a bucket.

    Pairs inside a bucket's largest component need no look, so only members of its other components, the minority, meet all members. Both
    are dealt to blocks of about BLOCK, and a block of the minority meets each block of all: rows grow with the bucket times the
    blocks of its minority, mostly one. Pairs are looked at where they meet, and only links leave.
    """
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
    blocks = largest.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"), F.greatest(F.ceil((F.col("n") - F.col("top.n")) / BLOCK), F.lit(1)).cast("int").alias("ko"), F.col("top.c").alias("top"))
    placed = members.join(materialize(blocks, "blocks"), "key").select("key", "band", "id", "c", "k", "ko", (F.col("c") != F.col("top")).alias("small"), F.xxhash64("id", F.lit(5)).alias("m"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    everyone = placed.select("key", "band", F.pmod("m", "k").cast("int").alias("x"), each("ko").alias("y"), F.lit(0).alias("side"), "id", "c", "small")
    minority = placed.where("small").select("key", "band", each("k").alias("x"), F.pmod("m", "ko").cast("int").alias("y"), F.lit(1).alias("side"), "id", "c", "small")
    ids = materialize(members.select("id").distinct(), "ids")
    known = only_ids(sketched.select("id", "cells", "bands"), ids, "id").join(only_ids(texts, ids, "id"), "id")
    rows = everyone.union(minority).join(known, "id")
    n = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet, "a long, b long"), "links")


def _groups(sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """What _connected() gives, without the tables that it needs on the way."""
    return tidied(sketched.sparkSession, lambda: _connected(sketched, texts))


def _connected(sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component_id) for each row (by number) that is linked with another. sketched and texts are written tables with a row's number as id.

    Rows with equal sets are one class, for which the one with the least number stands; the classes' rows follow it in the end.
    """
    spark = sketched.sparkSession
    worded = sketched.where("n_shingles > 0")
    classes = materialize(worded.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    copies = materialize(worded.select("id", "a", "b").join(classes, ["a", "b"]).where("id <> rep").select("id", "rep"), "copies")
    reps = worded.join(copies.select("id"), "id", "left_anti")
    keyed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = materialize(keyed.join(materialize(shared, "shared"), "key"), "buckets")
    release(spark)
    groups = components(tidied(spark, lambda: _confirmed(_pivots(buckets.withColumn("c", F.col("id")), False), texts)), "a", "b")
    release(spark)
    groups = extended(groups, tidied(spark, lambda: _confirmed(_pivots(_grouped(buckets, groups), True), texts)), "a", "b")
    release(spark)
    groups = extended(groups, tidied(spark, lambda: _remaining(_grouped(buckets, groups), worded, texts)), "a", "b")
    release(spark)
    of = groups.select(F.col("id").alias("rep"), F.col("component_id").alias("_c"))
    followed = copies.join(of, "rep", "left").select("id", F.coalesce("_c", "rep").alias("component_id"))
    heads = copies.select(F.col("rep").alias("id")).distinct().join(groups.select("id"), "id", "left_anti").select("id", F.col("id").alias("component_id"))
    return materialize(groups.union(followed).union(heads), "groups")


def _sketched(texts: DataFrame) -> DataFrame:
    """The sketches of the texts of a table (id, text), written to the shared folder."""
    return materialize(texts.mapInArrow(_sketch, "id long, n_shingles long, a long, b long, bands array<long>, cells binary"), "sketches")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_shingles, component_id (the smallest key reachable by links) and kept (whether that is its own key).

    Inside, rows go by numbers that are given and written once.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(text).alias("text")), "numbered")
    texts = numbered.select("id", "text")
    sketched = _sketched(texts)
    nameless = numbered.where("key is null").select("id")
    own = sketched if nameless.isEmpty() else materialize(sketched.join(nameless, "id", "left_anti"), "sketches")
    groups = _groups(own, texts)
    keyed = numbered.select("id", "key")
    repeated = materialize(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if not repeated.isEmpty():
        groups = extended(groups, materialize(keyed.join(repeated, "key").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")), "links"), "a", "b")
    placed = materialize(keyed.join(groups, "id", "left").select("id", "key", F.coalesce("component_id", "id").alias("c")), "placed")
    least = materialize(placed.groupBy("c").agg(F.min("key").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    out = sketched.select("id", "n_shingles").join(placed.join(least, "c", "left"), "id")
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, one with the smallest key (rows without a key come last); all columns.

    Rows are told by numbers, given and written once with the rows, so rows that repeat a key or have none are documents like
    others; rows without words all stay. Columns go by position, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = lambda c: F.col(names[docs.columns.index(c)])
    rows = materialize(docs.toDF(*names).withColumn("id", F.monotonically_increasing_id()), "numbered")
    order = F.struct(at(key).isNull().alias("none"), at(key).alias("key"), F.col("id").alias("id"))
    gone = tidied(docs.sparkSession, lambda: _gone(rows.select("id", at(text).alias("text")), rows.select("id", order.alias("o"))))
    return rows.join(gone, "id", "left_anti").select(*names).toDF(*docs.columns)


def _gone(texts: DataFrame, order: DataFrame) -> DataFrame:
    """The rows (id) that aren't the first of their group by order (id, o)."""
    groups = _groups(_sketched(texts), texts)
    placed = materialize(order.join(groups, "id").select("id", "component_id", "o"), "placed")
    first = materialize(placed.groupBy("component_id").agg(F.min("o").alias("first")), "first")
    return materialize(placed.join(first, "component_id").where("id <> first.id").select("id"), "gone")

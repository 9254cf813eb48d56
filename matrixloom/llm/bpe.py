"""BPE encoding and decoding through a table of distinct words.

Texts are split into words at places where the tokenizer always starts a new pre-token: white space, and the borders
between ASCII letters (or those of Latin-1), single ASCII digits, and ASCII signs other than the apostrophe. ASCII letters
are lowered, as the tokenizer does. So a text's ids are its words' ids, end to end. Texts with "<|", where special tokens may
be, are split at white space only and keep their case.

The table of distinct words has two parts, and each word is encoded once, by the library itself. Frequent words: all texts are counted,
and the HOT words that come most often (short ones, so that their table has a fixed size) are encoded and broadcast; for this choice,
which decides on nothing but speed, a word counts in stretches of text where it comes twice. All other words: each text lists its
own once, with their place; the lists are shuffled by word, and where equal words meet, the word is encoded once.

Ids come back by position: a text becomes a sequence of word numbers, and the ids of its rare words return by row (file and
place in it, which don't change with a scan's splits; rows that don't come from a file are numbered and written once) and place. Texts themselves are never shuffled: only the sequences, compressed. Decoding joins ids with the vocabulary's pieces.

Frequent words are matched by 64-bit hashes and lengths, others by their bytes.

Defined cases: null and empty texts have no ids and decode to an empty text; very long words and texts are handled whole;
rows are told apart by that, so null and repeated keys keep a result each; words the tokenizer gives no
ids add nothing; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import materialize, release, with_row

#: Words in the broadcast, and the longest of them in bytes: it has at most HOT * (LONGEST + its ids).
HOT = 1 << 18
LONGEST = 48
SLOTS = 20
WHITE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = WHITE
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[[*range(0x30, 0x3A)]] = DIGIT
KIND[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = SIGN
#: Borders by the kinds on both sides: a new pre-token always starts there.
BORDER = np.zeros((5, 5), bool)
BORDER[[LETTER, DIGIT, SIGN, SIGN, DIGIT, DIGIT, LETTER], [SIGN, SIGN, LETTER, DIGIT, DIGIT, LETTER, DIGIT]] = True
BORDER = BORDER.ravel()


class Units:
    """The words of some texts, in bytes: lowered bytes, starts, ends, hashes, and offsets (words before each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = KIND[data]
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = LETTER
        low = K.LOWER[data]
        inside = kind != WHITE
        cut = np.ones(len(data) + 1, bool)  # whether a word that holds this byte starts at it
        if len(data):
            cut[1:-1] = ~inside[:-1] | BORDER[kind[:-1] * 5 + kind[1:]]
            special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
            for d in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
                s, e = offsets[d], offsets[d + 1]
                low[s:e] = data[s:e]
                cut[s + 1 : e] = ~inside[s : e - 1]
            cut[offsets] = True
        self.low = low
        self.starts = np.flatnonzero(inside & cut[:-1])
        ends = np.ones(len(data), bool)
        ends[:-1] = ~inside[1:] | cut[1:-1]
        self.ends = np.flatnonzero(inside & ends) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hashes, _ = K.hash_spans(low, self.starts, self.ends)

    def words(self, at: np.ndarray) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def read_tokenizer(path: str | None = None) -> str:
    """A tokenizer file's contents; by default the public word-end BPE of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_tokenizers: dict[int, object] = {}


def _tokenizer(text: str):
    """One tokenizer for each process and file."""
    if hash(text) not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(text)
        found.no_padding()
        found.no_truncation()
        _tokenizers[hash(text)] = found
    return _tokenizers[hash(text)]


def pieces_of(tokenizer: str) -> list[str]:
    """The piece of each id: the table that decoding joins with. Its size is the vocabulary's."""
    found = _tokenizer(tokenizer)
    return [found.id_to_token(i) or "" for i in range(found.get_vocab_size(with_added_tokens=True))]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The short words that come twice in a stretch of text, with their number there."""
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(0))
        for i, j in K.pieces(offsets, 4 * K.PIECE):
            units = Units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            _, first, n = np.unique(units.hashes, return_index=True, return_counts=True)
            keep = (n > 1) & (units.ends[first] - units.starts[first] <= LONGEST)
            yield pa.RecordBatch.from_arrays([pa.array(units.words(first[keep]), pa.binary()), pa.array(n[keep])], ["word", "n"])


def _encode(words: list[bytes], tokenizer: str) -> list[bytes]:
    """Each word's ids as little-endian 32-bit integers."""
    found = _tokenizer(tokenizer).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [np.array(x.ids, "<u4").tobytes() for x in found]


def frequent_words(docs: DataFrame, *, text: str = "text", hot: int = HOT) -> DataFrame:
    """(word, n): at most `hot` words of at most LONGEST bytes, those that come most often."""
    words = materialize(docs.select(text).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    bins = sorted(((r["b"], r["n"]) for r in words.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 64).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 * 64 rows
    least, total = 1 << 62, 0
    for b, n in bins:
        total += n
        if total > hot:
            break
        least = int(np.ceil(2 ** (b / 64) - 1e-9))
    return words.where(F.col("n") >= least)


class Flat:
    """Byte strings end to end, to be put together by their numbers."""

    def __init__(self, values: list[bytes] | pa.ChunkedArray):
        if isinstance(values, list):
            values = pa.chunked_array([values], pa.binary())
        parts = [np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) for x in values.chunks if len(x)]
        self.size = np.concatenate([np.empty(0, np.int64), *(np.diff(x) for x in parts)])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(x.buffers()[2], np.uint8)[o[0] : o[-1]] for x, o in zip([x for x in values.chunks if len(x)], parts, strict=True) if o[-1] > o[0])])

    def gather(self, numbers: np.ndarray, more: Flat | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The strings of some numbers end to end, and how long each is; numbers beyond these strings are those of `more`."""
        n, size, start, data = len(self.size), self.size, self.start, self.data
        if more is not None and len(more.size):
            size, start, data = np.concatenate((size, more.size)), np.concatenate((start, more.start + len(data))), np.concatenate((data, more.data))
        assert not len(numbers) or numbers.max() < max(n, len(size))
        lengths = size[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat((start[numbers] - ends + lengths).astype(np.int32 if len(data) + (ends[-1] if len(ends) else 0) < 2**31 else np.int64), lengths)
        at += np.arange(len(at), dtype=at.dtype)
        return data[at], lengths


class Hot:
    """The frequent words, most frequent first: a table from hashes to numbers, and the numbers' ids and decoded texts (a space after each)."""

    def __init__(self, table: pa.Table):
        words = Flat(table["word"])
        hashes, _ = K.hash_spans(words.data, words.start, words.start + words.size)
        self.size = words.size.astype(np.int32)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)
        self.ids, self.decoded = Flat(table["ids"]), Flat(table["text"])
        self.first = np.zeros(1 << SLOTS, np.int32)
        self.first[self.hashes >> np.uint64(64 - SLOTS)] = np.arange(len(order), dtype=np.int32)

    def numbers(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of words of these hashes and bytes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        out = self.first[hashes >> np.uint64(64 - SLOTS)].astype(np.int64)
        rest = np.flatnonzero(self.hashes[out] != hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes[rest]), len(self.hashes) - 1)
        out[rest] = np.where(self.hashes[at] == hashes[rest], at, -1)
        number = self.number[out]
        return np.where((out < 0) | (self.size[number] != sizes), -1, number)


def decode_ids(ids: bytes, pieces: list[str]) -> bytes:
    """The text of some ids: their pieces with a space between."""
    return " ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode()


def spaced(ids: bytes, pieces: list[str]) -> bytes:
    """The text of some ids with a space after it; nothing for no ids."""
    return decode_ids(ids, pieces) + b" " if ids else b""


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: frequent words have small numbers, so the upper planes are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = (), tokenizer: str | None = None, hot: int = HOT, decoded: bool = False) -> DataFrame:
    """For each row: the columns `keep`, n_tokens, ids (little-endian 32-bit integers) and, if asked, decoded: the decoded text.

    A kept column that is called like one of the results is left out.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids", "decoded"))
    inner = tuple(f"_keep{i}" for i in range(len(keep)))
    spark = docs.sparkSession
    tokenizer = tokenizer or read_tokenizer()
    frequent = frequent_words(docs, text=text, hot=hot)
    release(spark)
    pieces = pieces_of(tokenizer)
    names, shipped = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(tokenizer)

    def encode_frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _encode(batch.column(0).to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([spaced(x, names.value) for x in ids], pa.binary())], ["word", "n", "ids", "text"])

    table = frequent.mapInArrow(encode_frequent, "word binary, n long, ids binary, text binary").toArrow()  # at most `hot` words of at most LONGEST bytes
    words = spark.sparkContext.broadcast(Hot(table.sort_by([("n", "descending"), ("word", "ascending")])))

    def encode_rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word to (_row, place and ids in one); a word is encoded where it first comes."""
        last, ids = None, b""
        for batch in batches:
            own = batch.column(2).to_pylist()
            fresh = [w for w, before in zip(own, [last, *own], strict=False) if w != before]
            codes = iter(_encode(fresh, shipped.value))
            out = []
            for word, place in zip(own, np.asarray(batch.column(1)).astype("<u4"), strict=True):
                if word != last:
                    last, ids = word, next(codes)
                out.append(place.tobytes() + ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_row", "found"])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row number, and the text as numbers of frequent words, or their count plus the place among the text's other words."""
        table = words.value
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.pieces(offsets):
                units = Units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = table.numbers(units.hashes, units.ends - units.starts)
                raw, n = units.low.tobytes(), len(table.hashes)
                rare = np.flatnonzero(found < 0)
                cut = np.searchsorted(rare, units.offsets)
                sequences, others = [], []
                for d in range(j - i):
                    own = rare[cut[d] : cut[d + 1]]
                    if len(own):
                        places: dict[bytes, int] = {}
                        found[own] = [n + places.setdefault(raw[s:e], len(places)) for s, e in zip(units.starts[own].tolist(), units.ends[own].tolist(), strict=True)]
                        others.append(list(places))
                    else:
                        others.append([])
                    sequences.append(_pack(found[units.offsets[d] : units.offsets[d + 1]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sequences, pa.binary()), pa.array(others, pa.list_(pa.binary())), *(c.slice(i, j - i) for c in batch.columns[2:])], ["_row", "sequence", "others", *inner])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names_ = words.value, names.value
        n = len(table.hashes)
        for batch in batches:
            kept = batch.columns[2:]
            sizes = np.array([zstandard.frame_content_size(x.as_buffer()) for x in batch.column(0)] or [0])
            for i, j in K.pieces(np.concatenate(([0], np.cumsum(sizes))), K.PIECE // 2) if batch.num_rows else ():
                numbers, rare = [], []
                for packed, found in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                    own = _unpack(packed).astype(np.int64)
                    own[own >= n] += len(rare)
                    numbers.append(own)
                    rare += [x[4:] for x in sorted(found or (), key=lambda x: int.from_bytes(x[:4], "little"))]
                cut = np.concatenate(([0], np.cumsum([len(x) for x in numbers])))
                numbers = np.concatenate(numbers)

                def put(hot: Flat, more: Flat, end: int, numbers=numbers, cut=cut) -> list[bytes]:
                    data, lengths = hot.gather(numbers, more)
                    at = np.concatenate(([0], np.cumsum(lengths)))[cut]
                    return [data[a : max(a, b - end)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

                ids_out = put(table.ids, Flat(rare), 0)
                out = [*(x.slice(i, j - i) for x in kept), pa.array([len(x) // 4 for x in ids_out], pa.int64()), pa.array(ids_out, pa.binary())]
                if decoded:
                    out.append(pa.array(put(table.decoded, Flat([spaced(x, names_) for x in rare]), 1), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, out_names)

    chosen = docs.select(F.col(text).alias("_text"), *(F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)))
    numbered = with_row(chosen).select("_row", "_text", *inner)
    kept = [docs.schema[c] for c in keep]
    renamed = [T.StructField(i, f.dataType) for i, f in zip(inner, kept, strict=True)]
    sequences = numbered.mapInArrow(number, T.StructType([*T._parse_datatype_string("_row struct<file:long,row:long>, sequence binary, others array<binary>").fields, *renamed]))
    rare = sequences.select("_row", F.posexplode("others").alias("place", "word"))
    # Frequent words are gone from these; only a very long word may come in very many texts, so those are dealt to several tasks.
    share = F.when(F.length("word") > LONGEST, F.pmod(F.xxhash64("_row"), F.lit(64))).otherwise(0)
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_words = rare.repartition(n, "word", share).sortWithinPartitions("word")
    found = sorted_words.mapInArrow(encode_rare, "_row struct<file:long,row:long>, found binary").groupBy("_row").agg(F.collect_list("found").alias("found"))  # at most a text's own words
    joined = sequences.select("_row", "sequence", *inner).join(found, "_row", "left")
    fields = kept + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + ([T.StructField("decoded", T.StringType())] if decoded else [])
    out_names = [f.name for f in fields]
    return joined.select("sequence", "found", *inner).mapInArrow(assemble, T.StructType(fields))


def decode(encoded: DataFrame, *, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """encoded with the column decoded: each row's ids joined with the vocabulary's pieces."""
    names = encoded.sparkSession.sparkContext.broadcast(pieces_of(tokenizer or read_tokenizer()))
    place = encoded.columns.index(ids)

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x, names.value).decode() if x is not None else None for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(spell, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))

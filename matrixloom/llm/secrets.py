"""Secret scans: fixed patterns, and a token-efficiency test under a public byte-pair vocabulary.

Patterns (leftmost, not overlapping per kind; a match that fails its condition is dropped without another try):
assign (a name like password or token, a sign, and a value of 8 characters or more), access (AKIA keys of 16 characters
or more), hex (32 lower-case hexadecimal digits or more).

The efficiency test looks at runs of [A-Za-z0-9+/_=-] of MIN_RUN characters or more, without what a pattern's match covers:
ordinary words take few tokens, random strings many. Of each run, in this order, `random` is
- all of it, if it has LONG_RUN characters or more and a digit, not only digits, and fewer than EFFICIENCY characters a token;
- all of it, or else the stretches of its tokens that a linear scan finds (maximal sums of EFFICIENCY less each token's
  letters and digits), or else parts between the signs +/_=-, if they look random by their letters and digits alone: MIN_RUN
  characters or more, 3 or more between signs on average, and fewer than EFFICIENCY letters and digits a token. Without a digit,
  one with the case of ordinary words (lower, upper, or first letters upper) has to lie below WORDLIKE, and is no stretch. One
  without a letter isn't looked at.
A stretch is widened to whole parts where these look random too. Known digests and identifiers are never reported alone and
end a stretch: a hexadecimal digest of a usual length, a UUID, or a part that only repeats one character pair.

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans; whole texts are scanned in
linear time whatever their length; repeated rows are scanned alike; other columns play no part.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K

# Fixed patterns, as the contract states them (ASCII only).
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
UUID = re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

MIN_RUN = 12
#: From this length, runs with digits are judged whole with their signs.
LONG_RUN = 16
#: Characters per token below which a run counts as random.
EFFICIENCY = 2.2
#: The same for letters in the case of ordinary words: these have about 2 where they are rare, random ones 1.6.
WORDLIKE = 2.0
#: Lengths in hexadecimal digits of the usual digests: CRC32 doubled, MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (16, 32, 40, 56, 64, 96, 128)
#: Parts from this length can be known ones.
KNOWN_LEAST = min(DIGESTS)

HEX = np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True
RUN = np.zeros(256, bool)
RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: One byte of each pattern that ordinary text has seldom, and that lies in every match: a sign of assignment, or K.
_ACCESS_KEY = b"AKIA"


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file; by default the public byte-level one of 50k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_encoders: dict[int, object] = {}


def _encoder(shipped):
    """One encoder for each process and broadcast."""
    if shipped.value["id"] not in _encoders:
        import tiktoken

        _encoders[shipped.value["id"]] = tiktoken.Encoding("secrets", pat_str=shipped.value["pattern"], mergeable_ranks=shipped.value["ranks"], special_tokens={})
    return _encoders[shipped.value["id"]]


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a kind, none across documents, of at least `least` bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    change = inside[1:] != inside[:-1]
    edges = np.flatnonzero(change)
    starts, ends = edges[::2], edges[1::2]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cut = np.unique(cut[inside[cut + 1] & inside[cut]])  # borders of documents inside a run
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    long = ends - starts >= least
    return starts[long], ends[long]


def known(run: bytes) -> bool:
    """A digest of a usual length or an identifier, which look random but give nothing away."""
    plain = run.strip(b"=-_+/")
    if UUID.fullmatch(plain):
        return True
    if len(plain) in DIGESTS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", plain):
        return True
    return len(set(plain)) <= 2


PART = re.compile(rb"[A-Za-z0-9]+")
#: Letters in the case of ordinary words.
WORD_CASE = re.compile(rb"[A-Z]?[a-z]*|[A-Z]+")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")


def _stretches(scores: list[float]) -> list[tuple[int, int]]:
    """First and last of all maximal scoring segments, in linear time (Ruzzo and Tompa 1999)."""
    held: list[tuple[float, float, int, int, int]] = []  # (sum before, sum after, first, last, the latest with a lower sum before)
    total = 0.0
    for at, score in enumerate(scores):
        low, first = total, at
        total += score
        if score <= 0:
            continue
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= total:
                break
            low, first, back = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = back
        held.append((low, total, first, at, j))
    return [(first, last) for _, _, first, last, _ in held]


def random_stretches(run: bytes, lengths: list[int], min_run: int = MIN_RUN, efficiency: float = EFFICIENCY) -> list[tuple[int, int]]:
    """Starts and ends of what looks random in a run, given the lengths of its tokens; in order, not overlapping."""
    if run.isalpha() and WORD_CASE.fullmatch(run):
        return [(0, len(run))] if len(run) < WORDLIKE * len(lengths) and not known(run) else []
    digits = len(_DIGIT.findall(run))
    if digits == len(run) or known(run):
        return []
    if len(run) >= LONG_RUN and digits and len(run) < efficiency * len(lengths):
        return [(0, len(run))]
    ends = list(accumulate(lengths))
    starts = [0, *ends[:-1]]
    plain = [run[s : s + 1].isalnum() for s in starts]  # a token has signs only or none
    chars = list(accumulate((n if p else 0 for n, p in zip(lengths, plain, strict=True)), initial=0))
    tokens = list(accumulate(plain, initial=0))
    parts = [m.span() for m in PART.finditer(run)]
    if not parts:
        return []

    def looks(s: int, e: int, stretch: bool = False) -> bool:
        i, j = bisect_left(starts, s), bisect_left(ends, e) + 1
        own, n = chars[j] - chars[i], tokens[j] - tokens[i]
        if e - s < min_run or own >= efficiency * n:
            return False
        text = run[s:e]
        pieces = PART.findall(text)
        if own < 3 * len(pieces) or not _LETTER.search(text) or known(text):
            return False
        return bool(_DIGIT.search(text)) or not all(map(WORD_CASE.fullmatch, pieces)) or (not stretch and own < WORDLIKE * n)

    first, last = parts[0][0], parts[-1][1]
    if looks(first, last):
        return [(first, last if run[last:].strip(b"=") else len(run))]
    taken = np.zeros(len(run), bool)  # by known ones, and then by what is found
    for a, z in [*(m.span() for m in UUID.finditer(run)), *(x for x in parts if x[1] - x[0] >= KNOWN_LEAST and known(run[slice(*x)]))]:
        taken[a:z] = True
    scores = [-1e9 if p and taken[s] else efficiency - n if p else 0.0 for s, n, p in zip(starts, lengths, plain, strict=True)]
    out: list[tuple[int, int]] = []
    firsts, lasts = [x[0] for x in parts], [x[1] for x in parts]
    tried = None
    for i, j in _stretches(scores):
        s, e = starts[i], ends[j]
        wide = firsts[bisect_right(firsts, s) - 1], lasts[bisect_left(lasts, e)]
        for a, z in ((s, e),) if wide == tried else (wide, (s, e)):
            if z - a >= min_run and not taken[a:z].any() and looks(a, z, True):
                out.append((a, z))
                taken[a:z] = True
                break
        tried = wide
    for s, e in parts:
        if e - s >= min_run and not taken[s:e].any() and looks(s, e):
            out.append((s, e))
    return sorted(out)


def _uncovered(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range without these."""
    out = []
    for x, z in sorted(covered):
        if x > a:
            out.append((a, min(x, b)))
        a = max(a, z)
        if a >= b:
            return out
    return [*out, (a, b)]


def _patterns(text: bytes) -> list[tuple[int, int, int]]:
    """The matches of assign and access: (start, kind, end) in bytes."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if _ACCESS_KEY in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary_path: str | None = None, pattern: str | None = None, min_run: int = MIN_RUN, efficiency: float = EFFICIENCY) -> DataFrame:
    """For each row: key and spans (kind, start, end), ordered by start and then kind as in KINDS. One scan, no shuffle.

    The vocabulary is read on the driver and shipped: it has a fixed size.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    shipped = docs.sparkSession.sparkContext.broadcast({"ranks": vocabulary(vocabulary_path), "pattern": pattern, "id": f"{vocabulary_path}|{pattern}"})

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {rank: len(token) for token, rank in shipped.value["ranks"].items()}
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.pieces(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
                raw = part.tobytes()
                signs = np.concatenate(([0], np.cumsum((part == 0x3D) | (part == 0x3A) | (part == 0x4B))))[cut]  # = : K
                for d in np.flatnonzero(np.diff(signs)).tolist():
                    found[d] = _patterns(raw[cut[d] : cut[d + 1]])
                for s, e in zip(*runs(part, cut, HEX, LEAST_HEX), strict=True):
                    d = int(np.searchsorted(cut, s, "right")) - 1
                    found[d].append((int(s - cut[d]), 2, int(e - cut[d])))
                starts, ends = runs(part, cut, RUN, min_run)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    d = int(np.searchsorted(cut, s, "right")) - 1
                    a, b = int(s - cut[d]), int(e - cut[d])
                    covered = [(x, z) for x, k, z in found[d] if k != 3 and x < b and a < z]
                    for x, z in _uncovered(a, b, covered) if covered else [(a, b)]:
                        if x > a:  # signs after a match
                            x = z - len(raw[s + x - a : s + z - a].lstrip(b"+/_=-"))
                        if z - x >= min_run:
                            run = raw[s + x - a : s + z - a]
                            lengths = [sizes[t] for t in _encoder(shipped).encode_ordinary(run.decode())]
                            found[d] += [(x + p, 3, x + q) for p, q in random_stretches(run, lengths, min_run, efficiency)]
                out = []
                for d, own in enumerate(found):
                    if own:
                        text_d = part[cut[d] : cut[d + 1]]
                        chars = np.concatenate(([0], np.cumsum((text_d & 0xC0) != 0x80)))
                        own = [{"kind": KINDS[k], "start": int(chars[a]), "end": int(chars[b])} for a, k, b in sorted(own)]
                    out.append(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, _SPANS)], [key, "spans"])

    schema = T.StructType([docs.schema[key], T.StructField("spans", T._parse_datatype_string("array<struct<kind:string,start:long,end:long>>"))])
    return docs.select(key, text).mapInArrow(scan, schema)

"""Blosc buffers (format version 2), by the public description of their layout: a decoder on numpy.

A buffer has a header of 16 bytes, the places of its blocks, and the blocks. A block is one compressed stream or, where the flags allow it,
one for each byte of an item; a stream as long as its content is stored as it is. Filters (bytes or bits of items side by side) are
undone block by block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from ..errors import ConversionError

# Fixed values of the format: flags, the numbers of compressors, and what makes a block be split into streams.
BYTES_SHUFFLED, STORED, BITS_SHUFFLED, WHOLE_BLOCKS = 0x01, 0x02, 0x04, 0x10
COMPRESSORS = {1: "lz4", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128


def decode(raw: bytes) -> bytes:
    """The content of a buffer. A ConversionError where it is damaged or its compressor isn't supported."""
    try:
        return _decode(raw)
    except (struct.error, zlib.error, zstandard.ZstdError, pa.ArrowException, IndexError, ValueError) as e:
        raise ConversionError(f"a blosc buffer is damaged: {e}") from e


def _decode(raw: bytes) -> bytes:
    _, _, flags, item, size, block, packed = struct.unpack_from("<BBBBIII", raw)
    if packed > len(raw):
        raise ValueError(f"it has {len(raw)} of {packed} bytes")
    if flags & STORED:
        return raw[16 : 16 + size]
    compressor = COMPRESSORS.get(flags >> 5)
    if compressor is None:
        raise ConversionError(f"blosc compressor {flags >> 5} is not supported")
    out = []
    starts = struct.unpack_from(f"<{-(-size // block) if block else 0}I", raw, 16)
    for i, at in enumerate(starts):
        n = min(block, size - i * block)
        split = not flags & WHOLE_BLOCKS and item <= MOST_STREAMS and n == block and block % item == 0 and block // item >= LEAST_STREAM
        parts = []
        for _ in range(item if split else 1):
            length = struct.unpack_from("<i", raw, at)[0]
            parts.append(_expand(raw[at + 4 : at + 4 + length], n // item if split else n, compressor))
            at += 4 + length
        out.append(_restored(b"".join(parts), item, flags))
    return b"".join(out)


def _expand(raw: bytes, size: int, compressor: str) -> bytes:
    if len(raw) == size:
        return raw
    if compressor == "zstd":
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if compressor == "zlib":
        return zlib.decompress(raw)
    return pa.Codec("lz4_raw").decompress(raw, size, asbytes=True)


def _restored(block: bytes, item: int, flags: int) -> bytes:
    """A block with its items' bytes back in place; what doesn't fill the last item, or the last eight for bits, was left as it is."""
    if item > 1 and flags & BYTES_SHUFFLED:
        whole = len(block) // item * item
        return np.frombuffer(block, np.uint8, whole).reshape(item, -1).T.tobytes() + block[whole:]
    if flags & BITS_SHUFFLED:
        whole = len(block) // (8 * item) * 8 * item
        bits = np.unpackbits(np.frombuffer(block, np.uint8, whole).reshape(item * 8, -1), axis=1, bitorder="little")  # a row for each bit of an item
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + block[whole:]
    return block

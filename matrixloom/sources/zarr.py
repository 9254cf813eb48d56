"""Zarr v3 arrays and annotated-matrix groups, by the public specification: a reader as a Spark data source, and an exporter.

Codecs: bytes (either order), transpose, zstd, gzip, blosc, crc32c. Shards (sharding_indexed) are read
whole. The data source `zarr_rows` gives packed rows of a row-sparse, column-sparse or dense matrix; each partition reads a range of
major rows and only the chunks that range touches. Paths must be readable by executors (a shared file system).
"""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import AppConfig
from ..errors import ConversionError
from ..functions.scalar import HELD_AS
from ..functions.ship import ship
from ..operators.layout import item_bytes, major_bands, rows_per_partition
from ..operators.matrix import Matrix
from . import blosc
from .annotated import Annotated, frame_from, vector_rows

#: Entries that a task of a source holds at once, or a row's if it has more.
BAND_NNZ = 1 << 24
MISSING_INDEX = (1 << 64) - 1  # of a shard's chunk that isn't there


class Array:
    """A Zarr v3 array in a folder."""

    def __init__(self, path: str):
        self.path = path
        try:
            meta = json.loads(Path(path, "zarr.json").read_text())
        except OSError as e:
            raise ConversionError(f"{path} is not a zarr v3 array: {e}") from e
        if meta.get("node_type") != "array":
            raise ConversionError(f"{path} is not an array")
        self.shape = tuple(meta["shape"])
        self.chunks = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        kind = meta["data_type"]
        if kind != "string" and kind not in HELD_AS:
            raise ConversionError(f"{path}: type {kind!r} is not supported")
        self.kind, self.fill, self.codecs = kind, meta.get("fill_value", 0), meta["codecs"]
        self.attrs = meta.get("attributes", {})
        encoding = meta.get("chunk_key_encoding", {"name": "default"})
        self.separator = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
        self.prefix = "c" + self.separator if encoding["name"] == "default" else ""

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """A chunk, whole; fill values where it isn't stored."""
        try:
            raw = Path(self.path, self.prefix + self.separator.join(map(str, at)) if at else "c").read_bytes()
        except FileNotFoundError:
            return np.full(self.chunks, self.fill if self.kind != "string" else "", self._dtype())
        return self._decode(raw, self.codecs, self.chunks)

    def _dtype(self):
        return np.dtype(object) if self.kind == "string" else np.dtype(self.kind)

    def _decode(self, raw: bytes, codecs: list[dict], shape: tuple[int, ...]) -> np.ndarray:
        order = None
        array_codec = None
        for codec in codecs:
            if codec["name"] == "transpose":
                order = codec["configuration"]["order"]
            elif codec["name"] in ("bytes", "vlen-utf8", "sharding_indexed"):
                array_codec = codec
        for codec in reversed(codecs):
            name = codec["name"]
            if name == "zstd":
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif name == "gzip":
                raw = gzip.decompress(raw)
            elif name in ("blosc", "numcodecs.blosc"):
                raw = blosc.decode(raw)
            elif name == "crc32c":
                raw = raw[:-4]
            elif name not in ("bytes", "vlen-utf8", "transpose", "sharding_indexed"):
                raise ConversionError(f"{self.path}: codec {name!r} is not supported")
        if array_codec is None:
            raise ConversionError(f"{self.path}: no codec from array to bytes")
        if array_codec["name"] == "sharding_indexed":
            return self._shard(raw, array_codec["configuration"], shape)
        if array_codec["name"] == "vlen-utf8":
            n, at, out = struct.unpack_from("<I", raw)[0], 4, []
            for _ in range(n):
                size = struct.unpack_from("<I", raw, at)[0]
                out.append(raw[at + 4 : at + 4 + size].decode())
                at += 4 + size
            return np.array(out, object).reshape(shape)
        endian = array_codec.get("configuration", {}).get("endian", "little")
        dtype = np.dtype(self.kind).newbyteorder("<" if endian == "little" else ">")
        if order is None:
            return np.frombuffer(raw, dtype).reshape(shape)
        stored = np.frombuffer(raw, dtype).reshape([shape[i] for i in order])
        return stored.transpose(np.argsort(order))

    def _shard(self, raw: bytes, conf: dict, shape: tuple[int, ...]) -> np.ndarray:
        inner = tuple(conf["chunk_shape"])
        grid = tuple(s // c for s, c in zip(shape, inner, strict=True))
        checked = any(c["name"] == "crc32c" for c in conf["index_codecs"])
        size = 16 * math.prod(grid) + 4 * checked
        index = raw[-size:] if conf.get("index_location", "end") == "end" else raw[:size]
        places = np.frombuffer(index[: 16 * math.prod(grid)], "<u8").reshape(*grid, 2)
        out = np.full(shape, self.fill if self.kind != "string" else "", self._dtype())
        for at in np.ndindex(*grid):
            begin, length = (int(x) for x in places[at])
            if begin != MISSING_INDEX:
                out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, inner, strict=True))] = self._decode(raw[begin : begin + length], conf["codecs"], inner)
        return out

    def read(self, *ranges: tuple[int, int]) -> np.ndarray:
        """The values in a range for each axis; axes without one are read whole."""
        ranges = (*ranges, *((0, n) for n in self.shape[len(ranges) :]))
        out = np.empty([b - a for a, b in ranges], self._dtype())
        spans = [range(a // c, -(-b // c)) if b > a else range(0) for (a, b), c in zip(ranges, self.chunks, strict=True)]
        for at in np.ndindex(*(len(s) for s in spans)):
            place = tuple(s[i] for s, i in zip(spans, at, strict=True))
            chunk = self.chunk(place)
            target, source = [], []
            for i, c, (a, b) in zip(place, self.chunks, ranges, strict=True):
                low, high = max(a, i * c), min(b, (i + 1) * c)
                target.append(slice(low - a, high - a))
                source.append(slice(low - i * c, high - i * c))
            out[tuple(target)] = chunk[tuple(source)]
        return out


def attributes(path: str) -> dict:
    """The attributes of a group or array."""
    return json.loads(Path(path, "zarr.json").read_text()).get("attributes", {})


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _RowsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.rows = int(options.get("rows_per_partition", 4096))  # read_matrix plans them by bytes
        self.n = int(options["major"])

    def partitions(self):
        return [_Range(i, min(i + self.rows, self.n)) for i in range(0, self.n, self.rows)] or [_Range(0, 0)]

    def read(self, partition):
        a, b = partition.start, partition.end
        if a == b:
            return
        if self.kind == "dense":
            values = Array(self.path).read((a, b))
            for i, row in enumerate(values):
                at = np.flatnonzero(row != 0)
                if len(at):
                    yield a + i, at.tolist(), row[at].tolist()
            return
        indptr = Array(f"{self.path}/indptr").read((a, b + 1)).astype(np.int64)
        for lo, hi in major_bands(indptr, BAND_NNZ):  # bounds memory where rows are uneven
            s, e = int(indptr[lo]), int(indptr[hi])
            indices, data = Array(f"{self.path}/indices").read((s, e)), Array(f"{self.path}/data").read((s, e))
            for i in np.flatnonzero(np.diff(indptr[lo : hi + 1])).tolist():
                x, y = int(indptr[lo + i]) - s, int(indptr[lo + i + 1]) - s
                order = np.argsort(indices[x:y], kind="stable")
                yield a + lo + i, indices[x:y][order].tolist(), data[x:y][order].tolist()


class ZarrRows(DataSource):
    """format("zarr_rows"): (major, indices, data) of a matrix; options path, kind (csr, csc, dense), major, dtype, rows_per_partition."""

    @classmethod
    def name(cls):
        return "zarr_rows"

    def schema(self):
        return f"major bigint, indices array<bigint>, data array<{self.options['dtype']}>"

    def reader(self, schema):
        return _RowsReader(self.options)


def read_matrix(spark: SparkSession, path: str, rows_per_task: int | None = None) -> Matrix:
    """A matrix element: a sparse group or a dense array. A task reads so many rows, by default what a band's budget holds, in whole chunks if they fit."""
    ship(spark)
    spark.dataSource.register(ZarrRows)
    attrs = attributes(path)
    kind = {"csr_matrix": "csr", "csc_matrix": "csc", "array": "dense"}.get(attrs.get("encoding-type", "array"))
    if kind is None:
        raise ConversionError(f"{path}: encoding {attrs.get('encoding-type')!r} is not a matrix")
    values = Array(path if kind == "dense" else f"{path}/data")
    shape = values.shape if kind == "dense" else tuple(attrs["shape"])
    if len(shape) != 2:
        raise ConversionError(f"{path} has {len(shape)} dimensions")
    dtype = HELD_AS[values.kind]
    major, minor = ("col_id", "row_id") if kind == "csc" else ("row_id", "col_id")
    n = shape[1] if kind == "csc" else shape[0]
    row_bytes = shape[1] * item_bytes(dtype) if kind == "dense" else values.shape[0] * (item_bytes(dtype) + 8) / max(n, 1)
    rows = rows_per_task or rows_per_partition(n, row_bytes, spark.sparkContext.defaultParallelism, values.chunks[0] if kind == "dense" else 1)
    df = spark.read.format("zarr_rows").options(path=path, kind=kind, major=n, dtype=dtype, rows_per_partition=rows).load()
    entries = df.select(F.col("major").alias(major), F.inline(F.arrays_zip("indices", "data"))).withColumnsRenamed({"indices": minor, "data": "value"})
    return Matrix.of_entries(entries, shape[0], shape[1])


def read_frame(path: str) -> pd.DataFrame:
    """A dataframe element."""
    attrs = attributes(path)

    def column(p: str):
        a = attributes(p)
        kind = a.get("encoding-type", "array")
        if kind == "categorical":
            codes, labels = Array(f"{p}/codes").read(), Array(f"{p}/categories").read()
            return pd.Categorical.from_codes(codes, [str(x) for x in labels], ordered=bool(a.get("ordered")))
        if kind in ("nullable-integer", "nullable-boolean", "nullable-string-array"):
            values, mask = Array(f"{p}/values").read(), Array(f"{p}/mask").read().astype(bool)
            if kind == "nullable-string-array":
                return pd.array([None if m else v for v, m in zip(values, mask, strict=True)], dtype=object)
            name = "boolean" if kind == "nullable-boolean" else values.dtype.name.capitalize().replace("Uint", "UInt")
            return pd.array([pd.NA if m else v for v, m in zip(values.tolist(), mask, strict=True)], dtype=name)
        if kind not in ("array", "string-array"):
            raise ConversionError(f"{p}: unsupported encoding {kind!r}")
        return Array(p).read()

    names = column(f"{path}/{attrs['_index']}")
    return pd.DataFrame({c: column(f"{path}/{c}") for c in attrs.get("column-order", [])}, index=[str(x) for x in names])


def _children(path: str) -> list[str]:
    """The names of a group's elements, in order; none where there is no group."""
    return sorted(p.name for p in Path(path).iterdir() if (p / "zarr.json").exists()) if os.path.isdir(path) else []


def read_vectors(spark: SparkSession, path: str, id: str):
    """(id, vec) of a dense element of obsm or varm, read by tasks."""
    if attributes(path).get("encoding-type", "array") != "array":
        raise ConversionError(f"{path} is not a dense array")
    return vector_rows(read_matrix(spark, path), id)


def read_uns(path: str) -> tuple[dict, list[str]]:
    """Unstructured entries that a manifest can hold (nested groups, texts, numbers, arrays as lists), and the names of those that are left out."""
    found, left = {}, []
    for name in _children(path):
        own = f"{path}/{name}"
        kind = attributes(own).get("encoding-type", "")
        if kind in ("dict", "") and not _is_array(own):
            inner, missed = read_uns(own)
            found[name], left = inner, left + [f"{name}/{x}" for x in missed]
        elif kind in ("string", "numeric-scalar", "array", "string-array") and _is_array(own):
            values = Array(own).read()
            found[name] = values.tolist()
        else:
            left.append(name)
    return found, left


def _is_array(path: str) -> bool:
    return json.loads(Path(path, "zarr.json").read_text()).get("node_type") == "array"


def load(spark: SparkSession, path: str, cfg: AppConfig) -> Annotated:
    """An annotated-matrix group with all its elements; warnings name what can't be read."""
    obs, var = (frame_from(spark, read_frame(f"{path}/{k}"), i) for k, i in (("obs", "row_id"), ("var", "col_id")))
    out = Annotated(obs, var, read_matrix(spark, f"{path}/X") if os.path.exists(f"{path}/X") else None, {k: read_matrix(spark, f"{path}/layers/{k}") for k in _children(f"{path}/layers")}, kind="zarr")
    if os.path.exists(f"{path}/raw/X"):
        out.raw = read_matrix(spark, f"{path}/raw/X"), frame_from(spark, read_frame(f"{path}/raw/var"), "col_id")
    by_column = lambda p: read_vectors(spark, p, "col_id")
    readers = {"obsm": lambda p: read_vectors(spark, p, "row_id"), "varm": by_column, "raw/varm": by_column if out.raw else None, "obsp": lambda p: read_matrix(spark, p).entries(), "varp": lambda p: read_matrix(spark, p).entries()}
    for group, read in readers.items():
        for name in _children(f"{path}/{group}") if read else ():
            try:
                getattr(out, group.replace("/", "_"))[name] = read(f"{path}/{group}/{name}")
            except ConversionError as e:
                out.warnings.append(f"{group}/{name} is left out: {e}")
    out.uns, left = read_uns(f"{path}/uns")
    out.warnings += [f"uns/{name} is left out: its encoding can't be kept" for name in left]
    return out


# -- export


def write_array(path: str, values: np.ndarray, chunks: tuple[int, ...] | None = None, attrs: dict | None = None, level: int = 3) -> None:
    """An array in memory as a Zarr v3 array, zstd-compressed."""
    os.makedirs(path, exist_ok=True)
    text = values.dtype == object or values.dtype.kind in "US"
    chunks = tuple(max(1, min(c, n)) for c, n in zip(chunks or values.shape, values.shape, strict=True))
    serial = {"name": "vlen-utf8"} if text else {"name": "bytes", "configuration": {"endian": "little"}}
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": "string" if text else values.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "" if text else (False if values.dtype == bool else 0), "codecs": [serial, {"name": "zstd", "configuration": {"level": level, "checksum": False}}], "attributes": attrs or {},
    }
    Path(path, "zarr.json").write_text(json.dumps(meta))
    for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunks, strict=True))):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        whole = np.full(chunks, "" if text else 0, object if text else values.dtype)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        raw = struct.pack("<I", whole.size) + b"".join(struct.pack("<I", len(x)) + x for x in (str(v).encode() for v in whole.ravel())) if text else whole.astype(whole.dtype.newbyteorder("<")).tobytes()
        target = Path(path, "c", *map(str, at))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(zstandard.ZstdCompressor(level=level).compress(raw))


def write_group(path: str, attrs: dict) -> None:
    os.makedirs(path, exist_ok=True)
    Path(path, "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attrs}))


def export_matrix(m: Matrix, path: str, nnz_chunk: int) -> None:
    """A matrix as a row-sparse Zarr group: tasks write whole chunks of the flat arrays and of indptr to the shared path, and hold one chunk at a time."""
    ship(m.df.sparkSession)
    dtype = {v: k for k, v in reversed(HELD_AS.items()) if not k.startswith(("uint", "float16"))}[m.dtype]
    nnz = m.nnz()
    wide = "int64" if nnz > 2**31 - 1 else "int32"
    write_group(path, {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [m.n_rows, m.n_cols]})
    entries = m.numbered().select("position", F.col("value").alias("data"), F.col("col_id").alias("indices"))
    _export(entries, path, nnz, max(1, min(nnz_chunk, nnz)), {"data": dtype, "indices": "int32" if m.n_cols < 1 << 31 else "int64"})
    ends = m.indptr().select((F.col("row_id") + 1).alias("position"), (F.col("indptr") + F.col("nnz")).alias("indptr"))
    first = m.df.sparkSession.range(1).select(F.col("id").alias("position"), F.col("id").alias("indptr"))
    _export(first.union(ends), path, m.n_rows + 1, max(1, min(nnz_chunk, m.n_rows + 1)), {"indptr": wide})


def _export(values: DataFrame, path: str, n: int, chunk: int, arrays: dict[str, str]) -> None:
    """Arrays of n values under a group: values has a position, and a column of each array's name."""
    for name, kind in arrays.items():
        write_array(f"{path}/{name}", np.empty(0, kind), (1,))
        meta = json.loads(Path(path, name, "zarr.json").read_text())
        meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"] = [n], [chunk]
        Path(path, name, "zarr.json").write_text(json.dumps(meta))
        Path(path, name, "c").mkdir(parents=True, exist_ok=True)

    def save(number: int, held: dict) -> None:
        for name, kind in arrays.items():
            whole = np.zeros(chunk, kind)
            joined = np.concatenate(held[name])
            whole[: len(joined)] = joined
            target = Path(path, name, "c", str(number))
            beside = target.with_name(f"{number}.{os.getpid()}.part")
            beside.write_bytes(zstandard.ZstdCompressor(level=3).compress(whole.tobytes()))
            beside.replace(target)  # a task that runs again writes the same

    def put(batches):
        number, held = -1, {}
        for batch in batches:
            at = batch.column("_chunk").to_numpy(zero_copy_only=False)
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in arrays}
            edges = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])) if len(at) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at[a] != number:
                    if number >= 0:
                        save(number, held)
                    number, held = int(at[a]), {name: [] for name in arrays}
                for name, column in columns.items():
                    held[name].append(column[a:b].astype(arrays[name]))
        if number >= 0:
            save(number, held)
        yield from ()

    dealt = values.withColumn("_chunk", F.floor(F.col("position") / chunk).cast("bigint")).repartition("_chunk").sortWithinPartitions("position")
    dealt.mapInArrow(put, "done boolean").count()

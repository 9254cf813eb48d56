"""HDF5 inputs: h5ad files and 10x feature-barcode matrices. They need h5py, which is optional."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import AppConfig
from ..errors import ConversionError
from ..functions.scalar import HELD_AS
from ..functions.ship import ship
from ..operators.layout import item_bytes, major_bands, rows_per_partition
from ..operators.matrix import Matrix
from .annotated import Annotated, frame_from, plain_values, vector_rows

MAGIC = b"\x89HDF\r\n\x1a\n"
#: Entries that a task holds at once, or a row's if it has more.
BAND_NNZ = 1 << 24
GENE_EXPRESSION = "Gene Expression"


def h5py():
    try:
        import h5py as found
    except ImportError as e:
        raise ConversionError("HDF5 inputs need the optional package h5py") from e
    return found


def sniff(path: str) -> str | None:
    """h5ad, tenx, or None, by what the file holds."""
    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            return None
    with h5py().File(path, "r") as f:
        if "matrix" in f and "barcodes" in f["matrix"]:
            return "tenx"
        if any("barcodes" in g and "genes" in g for g in f.values() if hasattr(g, "keys")):
            return "tenx"
        if f.attrs.get("encoding-type") == "anndata" or ("obs" in f and "var" in f):
            return "h5ad"
    return None


class _Rows(InputPartition):
    def __init__(self, start, end):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        n, size = int(self.o["major"]), int(self.o.get("rows_per_partition", 4096))
        return [_Rows(i, min(i + size, n)) for i in range(0, n, size)] or [_Rows(0, 0)]

    def read(self, p):
        if p.start == p.end:
            return
        with h5py().File(self.o["path"], "r") as f:
            x = f[self.o["key"]]
            if self.o["kind"] == "dense":
                for i, row in enumerate(x[p.start : p.end]):
                    at = np.flatnonzero(row != 0)
                    if len(at):
                        yield p.start + i, at.tolist(), row[at].tolist()
                return
            indptr = x["indptr"][p.start : p.end + 1].astype(np.int64)
            for lo, hi in major_bands(indptr, BAND_NNZ):  # bounds memory where rows are uneven
                s, e = int(indptr[lo]), int(indptr[hi])
                indices, data = x["indices"][s:e], x["data"][s:e]
                for i in np.flatnonzero(np.diff(indptr[lo : hi + 1])).tolist():
                    a, b = int(indptr[lo + i]) - s, int(indptr[lo + i + 1]) - s
                    order = np.argsort(indices[a:b], kind="stable")
                    yield p.start + lo + i, indices[a:b][order].tolist(), data[a:b][order].tolist()


class Hdf5Rows(DataSource):
    """format("hdf5_rows"): (major, indices, data) of a matrix in an HDF5 file."""

    @classmethod
    def name(cls):
        return "hdf5_rows"

    def schema(self):
        return f"major bigint, indices array<bigint>, data array<{self.options['dtype']}>"

    def reader(self, schema):
        return _Reader(self.options)


def _matrix(spark: SparkSession, path: str, key: str, kind: str, shape: tuple[int, int], dtype: str, nnz: int = 0) -> Matrix:
    """A matrix of the file as a plan; nnz is that of a sparse one. A task reads what a band's budget holds."""
    ship(spark)
    spark.dataSource.register(Hdf5Rows)
    major, minor = ("col_id", "row_id") if kind == "csc" else ("row_id", "col_id")
    n = shape[1] if kind == "csc" else shape[0]
    row_bytes = shape[1] * item_bytes(dtype) if kind == "dense" else nnz * (item_bytes(dtype) + 8) / max(n, 1)
    rows = rows_per_partition(n, row_bytes, spark.sparkContext.defaultParallelism)
    df = spark.read.format("hdf5_rows").options(path=path, key=key, kind=kind, major=n, dtype=dtype, rows_per_partition=rows).load()
    entries = df.select(F.col("major").alias(major), F.inline(F.arrays_zip("indices", "data"))).withColumnsRenamed({"indices": minor, "data": "value"})
    return Matrix.of_entries(entries, *shape)


def _element(spark: SparkSession, path: str, f, key: str) -> Matrix:
    x = f[key]
    if not hasattr(x, "keys"):
        if len(x.shape) != 2:
            raise ConversionError(f"{key} has {len(x.shape)} dimensions")
        return _matrix(spark, path, key, "dense", x.shape, HELD_AS[x.dtype.name])
    kind = {"csr_matrix": "csr", "csc_matrix": "csc"}.get(x.attrs.get("encoding-type"))
    if kind is None:
        raise ConversionError(f"{key}: encoding {x.attrs.get('encoding-type')!r} is not a matrix")
    return _matrix(spark, path, key, kind, tuple(int(n) for n in x.attrs["shape"]), HELD_AS[x["data"].dtype.name], x["data"].shape[0])


def _text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def _frame(g) -> pd.DataFrame:
    def column(x):
        kind = x.attrs.get("encoding-type", "array")
        if kind == "categorical":
            return pd.Categorical.from_codes(x["codes"][:], _text(x["categories"][:]), ordered=bool(x.attrs.get("ordered", False)))
        if kind in ("nullable-integer", "nullable-boolean"):
            values, mask = x["values"][:], x["mask"][:].astype(bool)
            return pd.array([pd.NA if m else v for v, m in zip(values.tolist(), mask, strict=True)], dtype="boolean" if kind.endswith("boolean") else values.dtype.name.capitalize())
        if kind == "nullable-string-array":
            return pd.array([None if m else v for v, m in zip(_text(x["values"][:]), x["mask"][:].astype(bool), strict=True)], dtype=object)
        values = x[:]
        return _text(values) if values.dtype == object or values.dtype.kind == "S" else values

    return pd.DataFrame({c: column(g[c]) for c in _text(g.attrs.get("column-order", []))}, index=_text(g[g.attrs["_index"]][:]))


def load_h5ad(spark: SparkSession, path: str, cfg: AppConfig) -> Annotated:
    """An h5ad file with all its elements: matrices, vectors and graphs are read by executors, frames by the driver; warnings name what is left out."""
    with h5py().File(path, "r") as f:
        obs, var = frame_from(spark, _frame(f["obs"]), "row_id"), frame_from(spark, _frame(f["var"]), "col_id")
        layers = {k: _element(spark, path, f, f"layers/{k}") for k in _names(f, "layers")}
        raw = (_element(spark, path, f, "raw/X"), frame_from(spark, _frame(f["raw/var"]), "col_id")) if "raw" in f and "X" in f["raw"] else None
        out = Annotated(obs, var, _element(spark, path, f, "X") if "X" in f else None, layers, raw, kind="h5ad")
        for group in ("obsm", "varm", "obsp", "varp", *(("raw/varm",) if raw else ())):
            for name in _names(f, group):
                try:
                    m = _element(spark, path, f, f"{group}/{name}")
                except (ConversionError, KeyError) as e:
                    out.warnings.append(f"{group}/{name} is left out: {e}")
                    continue
                getattr(out, group.replace("/", "_"))[name] = m.entries() if group in ("obsp", "varp") else vector_rows(m, "row_id" if group == "obsm" else "col_id")
        out.uns, left = plain_values(_values(f["uns"]) if "uns" in f else {})
        out.warnings += [f"uns/{name} is left out: its encoding can't be kept" for name in left]
        return out


def _names(f, group: str) -> list[str]:
    return sorted(f[group]) if group in f else []


def _values(g) -> dict:
    """A group as nested dictionaries of values; what isn't plain stays an object that plain_values leaves out."""
    out = {}
    for name in g:
        x = g[name]
        if hasattr(x, "keys"):
            out[name] = _values(x) if x.attrs.get("encoding-type", "dict") in ("dict", "") else x
        else:
            value = x[()]
            texts = isinstance(value, np.ndarray) and value.dtype.kind in "OS"
            out[name] = _text(value) if texts else value.decode() if isinstance(value, bytes) else value
    return out


def load_tenx(spark: SparkSession, path: str, cfg: AppConfig) -> Annotated:
    """A 10x matrix: barcodes are rows; v3 files keep gene-expression features only; 32-bit counts become floats."""
    try:
        with h5py().File(path, "r") as f:
            if "matrix" in f:
                g, key = f["matrix"], "matrix"
                if "features" not in g:
                    raise ConversionError(f"{path} has no features")
                features = g["features"]
                names = _text(features["name"][:])
                probes = "gene_id" in features  # then id is the probe's
                columns = {"gene_ids": _text(features["gene_id" if probes else "id"][:]), **({"probe_ids": _text(features["id"][:])} if probes else {}), "feature_types": _text(features["feature_type"][:])}
                for extra in sorted(features):
                    if extra not in ("id", "gene_id", "name", "feature_type", "_all_tag_keys") and features[extra].shape == (len(names),):
                        values = features[extra][:]
                        columns[extra] = values.astype(bool) if values.dtype.kind == "b" else _text(values)
                var = pd.DataFrame(columns, index=names)
                keep = (var["feature_types"] == GENE_EXPRESSION).to_numpy()
            else:
                groups = [k for k, x in f.items() if "barcodes" in x]
                if len(groups) != 1:
                    raise ConversionError(f"a file with one genome is needed, not {len(groups)}")
                key, g = groups[0], f[groups[0]]
                var = pd.DataFrame({"gene_ids": _text(g["genes"][:])}, index=_text(g["gene_names"][:]))
                keep = np.ones(len(var), bool)
            marked = {"filtered_barcodes": g["filtered_barcodes"][:].astype(bool)} if key == "matrix" and "filtered_barcodes" in g else {}
            obs = pd.DataFrame(marked, index=_text(g["barcodes"][:]))
            dtype, nnz = HELD_AS[g["data"].dtype.name], g["data"].shape[0]
    except ConversionError:
        raise
    except Exception as e:
        raise ConversionError(f"{path} can't be read as a 10x file: {e}") from e
    m = _matrix(spark, path, key, "csr", (len(obs), len(var)), dtype, nnz)
    m = gene_expression(m, spark.createDataFrame([(int(i),) for i in np.flatnonzero(keep)], "col_id bigint")) if not keep.all() else m
    return Annotated(frame_from(spark, obs, "row_id"), frame_from(spark, var[keep], "col_id"), m.cast("float") if dtype == "int" else m, kind="tenx")


def gene_expression(m: Matrix, kept) -> Matrix:
    """Only the kept features, numbered anew."""
    return m.keep_cols(kept)

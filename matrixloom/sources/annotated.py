"""What every source gives: an annotated matrix as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConversionError, ValidationError
from ..functions.lineage import stable
from ..functions.scalar import HELD_AS
from ..operators.frames import Column, Frame, normalise
from ..operators.matrix import Matrix


@dataclass
class Annotated:
    """obs and var frames, X, and what goes with them. Tables of obsm and varm are (row_id or col_id, vec); of obsp and varp entries."""

    obs: Frame
    var: Frame
    X: Matrix | None
    layers: dict[str, Matrix] = field(default_factory=dict)
    raw: tuple[Matrix, Frame] | None = None
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)
    raw_varm: dict[str, DataFrame] = field(default_factory=dict)
    lazy: bool = True
    kind: str = "memory"
    warnings: list[str] = field(default_factory=list)

    @property
    def shape(self) -> tuple[int, int]:
        return self.obs.n, self.var.n


def eager(a: Annotated) -> Annotated:
    """The same matrix with every matrix and table written once to the shared folder, so that the input is read only once."""
    if not a.lazy:
        return a
    matrix = lambda m: m and replace(m, df=stable(m.df, "eager"))
    tables = {g: {k: stable(df, "eager") for k, df in getattr(a, g).items()} for g in ("obsm", "varm", "obsp", "varp", "raw_varm")}
    return replace(a, X=matrix(a.X), layers={k: matrix(m) for k, m in a.layers.items()}, raw=(matrix(a.raw[0]), a.raw[1]) if a.raw else None, **tables, lazy=False)


def require_matrix(a: Annotated) -> None:
    """At least a row, a column, and X of that shape."""
    if a.X is None:
        raise ValidationError("there is no X")
    if a.obs.n < 1 or a.var.n < 1:
        raise ValidationError(f"a matrix needs a row and a column, not {a.obs.n} x {a.var.n}")
    for name, m in (("X", a.X), *((f"layers/{k}", m) for k, m in a.layers.items())):
        if (m.n_rows, m.n_cols) != a.shape:
            raise ValidationError(f"{name} is {m.n_rows} x {m.n_cols}, the frames are {a.obs.n} x {a.var.n}")


def matrix_from(spark: SparkSession, x) -> Matrix:
    """A 2-D numpy array (values other than zero), sparse arrays by row or column (entries as they are), or a Matrix.

    Sparse arrays come as a row-sparse tuple (data, indices, indptr, shape), or as an object of format csr or csc with these attributes.
    """
    if isinstance(x, Matrix):
        return x
    if isinstance(x, np.ma.MaskedArray):
        raise ConversionError("masked arrays are not supported")
    kind = getattr(x, "format", "csr" if isinstance(x, tuple) and len(x) == 4 else None)
    if isinstance(x, np.ndarray):
        if x.ndim != 2:
            raise ConversionError(f"a matrix has two dimensions, not {x.ndim}")
        rows, cols = np.nonzero(x)
        values, shape, dtype = x[rows, cols], x.shape, x.dtype
    elif kind in ("csr", "csc"):
        *arrays, shape = x if isinstance(x, tuple) else (x.data, x.indices, x.indptr, x.shape)
        values, minor, indptr = (np.asarray(a) for a in arrays)
        n_major = shape[0] if kind == "csr" else shape[1]
        if len(values) != len(minor) or len(indptr) != n_major + 1 or indptr[-1] != len(values) or (np.diff(indptr) < 0).any():
            raise ConversionError("indptr, indices and data don't fit together")
        major, dtype = np.repeat(np.arange(n_major), np.diff(indptr)), values.dtype
        rows, cols = (major, minor) if kind == "csr" else (minor, major)
    elif isinstance(kind, str):
        raise ConversionError(f"sparse matrices of format {kind} are not supported; make them csr or csc")
    else:
        raise ConversionError(f"matrices of type {type(x).__name__} are not supported")
    held = HELD_AS.get(dtype.name)
    if held is None:
        raise ConversionError(f"values of type {dtype.name} are not supported")
    data = pd.DataFrame({"row_id": rows.astype(np.int64), "col_id": cols.astype(np.int64), "value": values.tolist() if held.startswith("decimal") else values})
    df = spark.createDataFrame(data, "row_id bigint, col_id bigint, value " + ("bigint" if held.startswith("decimal") else held)) if len(data) else spark.createDataFrame([], f"row_id bigint, col_id bigint, value {held}")
    return Matrix(df, "entries", int(shape[0]), int(shape[1]), held)


def frame_from(spark: SparkSession, table: pd.DataFrame | Frame, id: str) -> Frame:
    """A pandas frame, its index as names; pandas categories keep their order."""
    if isinstance(table, Frame):
        return table
    known, out = {}, {id: np.arange(len(table), dtype=np.int64), "name": [str(x) for x in table.index]}
    types = [f"{id} bigint", "name string"]
    for c in table.columns:
        values = table[c]
        if isinstance(values.dtype, pd.CategoricalDtype):
            known[c] = Column(str(c), "categorical", "string", tuple(map(str, values.cat.categories)), bool(values.cat.ordered))
            out[c] = [None if pd.isna(v) else str(v) for v in values]
            types.append(f"`{c}` string")
        elif pd.api.types.is_extension_array_dtype(values.dtype) and not pd.api.types.is_string_dtype(values.dtype):
            held = HELD_AS[values.dtype.name.lower() if values.dtype.name != "boolean" else "bool"]
            kind = "boolean" if held == "boolean" else "array"
            known[c] = Column(str(c), f"nullable-{kind}", held)
            out[c] = [None if pd.isna(v) else v for v in values.astype(object)]
            types.append(f"`{c}` {held}")
        elif values.dtype.name in HELD_AS:
            out[c] = values.tolist()
            types.append(f"`{c}` {HELD_AS[values.dtype.name]}")
        else:
            out[c] = [None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v) for v in values]
            types.append(f"`{c}` string")
    rows = list(zip(*out.values(), strict=True))
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows]
    return normalise(spark.createDataFrame(rows, ", ".join(types)), id, len(table), known=known)


def vectors_from(spark: SparkSession, x, id: str) -> DataFrame:
    """(id, vec) of a 2-D array, or a DataFrame that already is."""
    if isinstance(x, DataFrame):
        return x
    held = HELD_AS[x.dtype.name]
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], f"{id} bigint, vec array<{held}>")


def from_arrays(spark: SparkSession, X, obs: pd.DataFrame | Frame, var: pd.DataFrame | Frame, *, layers=None, raw=None, obsm=None, varm=None, obsp=None, varp=None, uns=None) -> Annotated:
    """An annotated matrix from arrays and frames in memory, or from engine objects."""
    return Annotated(
        frame_from(spark, obs, "row_id"), frame_from(spark, var, "col_id"), matrix_from(spark, X) if X is not None else None,
        {k: matrix_from(spark, m) for k, m in (layers or {}).items()},
        (matrix_from(spark, raw[0]), frame_from(spark, raw[1], "col_id")) if raw else None,
        {k: vectors_from(spark, v, "row_id") for k, v in (obsm or {}).items()}, {k: vectors_from(spark, v, "col_id") for k, v in (varm or {}).items()},
        {k: v if isinstance(v, DataFrame) else matrix_from(spark, v).entries() for k, v in (obsp or {}).items()},
        {k: v if isinstance(v, DataFrame) else matrix_from(spark, v).entries() for k, v in (varp or {}).items()},
        dict(uns or {}),
    )


def vector_rows(m: Matrix, id: str) -> DataFrame:
    """(id, vec) of a matrix; a row of zeros has a vector like others."""
    zero = F.lit(0).cast(m.dtype)
    cells = m.entries().groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "value"))).alias("cells"))  # one row of the array
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(m.n_cols - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("cells", i), zero))
    rows = m.df.sparkSession.range(m.n_rows).withColumnRenamed("id", "row_id").join(cells, "row_id", "left")
    return rows.select(F.col("row_id").alias(id), F.coalesce(vec, F.array_repeat(zero, m.n_cols)).alias("vec"))


def is_annotated(x) -> bool:
    """Whether an object has the attributes of an annotated matrix."""
    return all(hasattr(x, name) for name in ("X", "obs", "var"))


def from_object(spark: SparkSession, x) -> Annotated:
    """An annotated matrix in memory, by its attributes X, obs, var, layers, raw, obsm, varm, obsp, varp and uns; warnings name what is left out."""
    said = []

    def read(group: str, owner, take) -> dict:
        out = {}
        for name, value in dict(getattr(owner, group, None) or {}).items():
            try:
                out[name] = take(value)
            except (ConversionError, KeyError, TypeError, ValueError) as e:
                said.append(f"{group}/{name} is left out: {e}")
        return out

    def vectors(id: str):
        def take(value):
            if isinstance(value, pd.DataFrame):
                raise ConversionError("it is a table, not an array")
            return vector_rows(matrix_from(spark, value), id) if hasattr(value, "format") else vectors_from(spark, np.asarray(value), id)

        return take

    raw = getattr(x, "raw", None)
    uns, left = plain_values(dict(getattr(x, "uns", None) or {}))
    out = from_arrays(
        spark, x.X, x.obs, x.var, layers=dict(getattr(x, "layers", None) or {}), raw=(raw.X, raw.var) if raw is not None else None, obsm=read("obsm", x, vectors("row_id")), varm=read("varm", x, vectors("col_id")),
        obsp=read("obsp", x, lambda v: matrix_from(spark, v).entries()), varp=read("varp", x, lambda v: matrix_from(spark, v).entries()), uns=uns,
    )
    if raw is not None:
        out.raw_varm = read("varm", raw, vectors("col_id"))
    out.lazy = bool(getattr(x, "isbacked", False))
    out.warnings = said + [f"uns/{name} is left out: its type can't be kept" for name in left]
    return out


def plain_values(values: dict) -> tuple[dict, list[str]]:
    """What of unstructured entries a manifest can hold (texts, numbers, lists of them, nested dictionaries), and the names of the rest."""
    kept, left = {}, []
    for name, value in values.items():
        if isinstance(value, dict):
            kept[str(name)], inner = plain_values(value)
            left += [f"{name}/{x}" for x in inner]
        elif isinstance(value, np.ndarray | np.generic) and value.dtype.kind in "biufUSO":
            listed = value.tolist()
            kept[str(name)] = [v.decode() if isinstance(v, bytes) else v for v in listed] if isinstance(listed, list) else listed
        elif value is None or isinstance(value, str | int | float | bool) or (isinstance(value, list) and all(v is None or isinstance(v, str | int | float | bool) for v in value)):
            kept[str(name)] = value
        else:
            left.append(str(name))
    return kept, left

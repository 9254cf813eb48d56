"""A store: immutable Parquet data under a root, and a manifest that says which files make up which element.

An operation writes new files first and the manifest last, by one rename; so it happens whole or not at all, and a failed one
leaves nothing but files that it deletes.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_LEVEL, AppConfig, ChunkConfig
from ..errors import StorageError, ValidationError
from ..functions.lineage import held
from ..operators.frames import Column, Frame
from ..operators.layout import auto_factor, check_write_unit, dense_chunks, dense_shards, flat_chunk, item_bytes, rows_per_file
from ..operators.matrix import MAJOR, Matrix
from .files import Files

FORMAT, VERSION = "matrixloom-store", 1
#: Columns of a stretch of a dense matrix in its files, at most; a tile's row is several stretches, of which those without entries aren't written.
STRETCH = 32
MANIFEST = "manifest.json"


@dataclass(frozen=True)
class OpResult:
    """What an operation returns."""

    path: str
    n_obs: int
    n_vars: int
    snapshot_id: str | None = None


class Store:
    """The elements of one manifest. Writing methods change a copy of the manifest in memory; commit() publishes it."""

    def __init__(self, spark: SparkSession, files: Files, manifest: dict):
        self.spark, self.files, self.manifest = spark, files, manifest
        self._new: list[str] = []

    # -- opening

    @staticmethod
    def empty(spark: SparkSession, files: Files) -> Store:
        return Store(spark, files, {"format": FORMAT, "version": VERSION, "n_obs": 0, "n_vars": 0, "elements": {}, "uns": {}})

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        files = Files(spark, path)
        if not files.exists(MANIFEST):
            raise StorageError(f"{path} is not a store: it has no {MANIFEST}")
        manifest = files.read(MANIFEST)
        if manifest.get("format") != FORMAT:
            raise StorageError(f"{path} is not a store of this engine")
        return Store(spark, files, manifest)

    # -- reading

    @property
    def n_obs(self) -> int:
        return self.manifest["n_obs"]

    @property
    def n_vars(self) -> int:
        return self.manifest["n_vars"]

    @property
    def uns(self) -> dict:
        return self.manifest["uns"]

    def keys(self, group: str) -> list[str]:
        """The names in a group: layers, obsm, varm, obsp, varp."""
        return sorted(k.removeprefix(f"{group}/") for k in self.manifest["elements"] if k.startswith(f"{group}/"))

    def matrix_keys(self) -> list[str]:
        """The elements that matrix operations take: X, layers and raw/X."""
        return [k for k in ("X", *(f"layers/{x}" for x in self.keys("layers")), "raw/X") if k in self.manifest["elements"]]

    def has(self, key: str) -> bool:
        return key in self.manifest["elements"]

    def _element(self, key: str) -> dict:
        try:
            return self.manifest["elements"][key]
        except KeyError:
            raise ValidationError(f"there is no element {key!r}; there are {', '.join(sorted(self.manifest['elements'])) or 'none'}") from None

    def _read(self, element: dict) -> DataFrame:
        return self.spark.read.options(**self.files.options).schema(element["schema"]).parquet(*(self.files.uri(p) for p in element["paths"]))

    def matrix(self, key: str = "X") -> Matrix:
        e = self._element(key)
        return Matrix(self._read(e), e["layout"], e["shape"][0], e["shape"][1], e["dtype"], e.get("stretch", e["chunks"][1]) if e["layout"] == "dense" else 2048)

    def frame(self, key: str) -> Frame:
        e = self._element(key)
        return Frame(self._read(e), e["id"], e["n"], tuple(Column(**c | {"categories": tuple(c["categories"])}) for c in e["columns"]))

    def table(self, key: str) -> DataFrame:
        """An element of obsm, varm (id, vec) or obsp, varp (row_id, col_id, value)."""
        return self._read(self._element(key))

    # -- writing

    def _write(self, df: DataFrame, key: str, *, records: int | None = None, level: int | None = None) -> dict:
        path = f"data/{key}/{uuid.uuid4().hex}"
        self._new.append(path)
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(DEFAULT_LEVEL if level is None else max(level, 1)))
        (writer.option("maxRecordsPerFile", records) if records else writer).parquet(self.files.uri(path))
        return {"paths": [path], "schema": df._jdf.schema().toDDL()}

    def put_matrix(self, key: str, m: Matrix, cfg: AppConfig | None = None, *, chunks: ChunkConfig | None = None, source: str | None = None, layout: str | None = None, nnz: int | None = None, filed: bool = False) -> None:
        """Writes a matrix in a layout: packed, range-partitioned along its axis, files of about a chunk, or of a band's budget under auto_shard.

        A matrix that changes its layout is packed once, into the shared folder; it is counted, sampled and read from there. For a dense one
        its entries or packed rows are held there instead, unless they are filed in a store already, so that the zeros of its stretches are
        made as the files are written.
        """
        chunks = chunks or (cfg or AppConfig()).chunks
        layout = layout or (cfg or AppConfig()).io.layout
        rows, cols = dense_chunks(m.n_rows, m.n_cols, chunks)
        stretch = min(cols, STRETCH)
        same = m.layout == layout and (layout != "dense" or m.col_chunk == stretch)
        packed = m if same or (layout == "dense" and m.layout == "csr") else m.to("entries" if layout == "dense" else layout)
        axis = MAJOR.get(layout, "row_id")
        order = [axis, "part"] if layout in MAJOR else ["row_id", "col_block"]
        with nullcontext(packed.df) if same or (filed and packed is m) else held(packed.df, "packed") as table:
            if nnz is None:
                nnz = replace(packed, df=table).nnz()
            records = self._records(m, layout, nnz, chunks, (rows, cols), stretch)
            if same or layout != "dense":
                placed = table.repartitionByRange(axis).sortWithinPartitions(*order)
            else:
                placed = replace(packed, df=table).dense_in_order(stretch).df
            element = self._write(placed, key, records=records, level=chunks.clevel)
        self.manifest["elements"][key] = element | {"kind": "matrix", "layout": layout, "shape": [m.n_rows, m.n_cols], "dtype": m.dtype, "nnz": nnz, "chunks": [rows, cols], "config": asdict(chunks), "source": source}
        if layout == "dense":
            self.manifest["elements"][key]["stretch"] = stretch

    @staticmethod
    def _records(m: Matrix, layout: str, nnz: int, chunks: ChunkConfig, tile: tuple[int, int], stretch: int) -> int:
        """Packed rows of a file."""
        if layout in MAJOR:
            n = m.n_rows if layout == "csr" else m.n_cols
            size = flat_chunk(nnz, n, chunks.row_chunk if layout == "csr" else chunks.col_chunk, chunks) * (item_bytes(m.dtype) + 4)
            check_write_unit(size)
            return rows_per_file(nnz, n, chunks, layout) * (auto_factor(size) if chunks.auto_shard else 1)
        size = tile[0] * m.n_cols * item_bytes(m.dtype)
        check_write_unit(size)
        shard = dense_shards((m.n_rows, m.n_cols), tile, auto_factor(size) if chunks.auto_shard else chunks.shard_factor) or tile
        return shard[0] * max(1, -(-m.n_cols // stretch))

    def add_files(self, key: str, df: DataFrame, *, rows: int, nnz: int = 0) -> None:
        """More rows of an element in files of their own; the files it has stay."""
        e = dict(self._element(key))
        added = self._write(df, key)
        e["paths"] = e["paths"] + added["paths"]
        if "shape" in e:
            e["shape"], e["nnz"] = [e["shape"][0] + rows, e["shape"][1]], e["nnz"] + nnz
        self.manifest["elements"][key] = e

    def put_frame(self, key: str, frame: Frame) -> None:
        element = self._write(frame.df.select(frame.id, "name", *frame.names), key)
        self.manifest["elements"][key] = element | {"kind": "frame", "id": frame.id, "n": frame.n, "columns": [asdict(c) for c in frame.columns]}

    def grow_frame(self, key: str, rows: DataFrame, frame: Frame) -> None:
        """More rows of a frame in files of their own; frame is the whole, with the same columns and perhaps other encodings."""
        e = dict(self._element(key))
        old = self._read(e).columns
        added = self._write(rows.select(*old), key)
        self.manifest["elements"][key] = e | {"paths": e["paths"] + added["paths"], "n": frame.n, "columns": [asdict(frame.column(c)) for c in old if c in frame.names]}

    def put_table(self, key: str, df: DataFrame) -> None:
        self.manifest["elements"][key] = self._write(df, key) | {"kind": "table"}

    def drop(self, key: str) -> None:
        self._element(key)
        del self.manifest["elements"][key]

    def copy_from(self, other: Store, key: str) -> None:
        """An element of another store: by reference in the same root, else its files are read and written once, values untouched."""
        e = dict(other._element(key))
        if other.files.root != self.files.root:
            e |= self._write(other._read(e), key)
        self.manifest["elements"][key] = e

    def config_of(self, key: str) -> ChunkConfig:
        """The chunk configuration an element was written with, as it was asked for."""
        return ChunkConfig(**self._element(key)["config"])

    # -- publishing

    def check(self) -> None:
        """A StorageError unless X is there, and all elements fit its shape."""
        elements = self.manifest["elements"]
        if "X" not in elements:
            raise StorageError("the store has no X")
        shape = [self.n_obs, self.n_vars]
        for key in ("X", *(f"layers/{k}" for k in self.keys("layers"))):
            if elements[key]["shape"] != shape:
                raise StorageError(f"{key} is {elements[key]['shape']}, the store {shape}")
        if "raw/X" in elements and elements["raw/X"]["shape"][0] != self.n_obs:
            raise StorageError("raw/X has another number of rows")
        for key, n in (("obs", self.n_obs), ("var", self.n_vars)):
            if key in elements and elements[key]["n"] != n:
                raise StorageError(f"{key} has {elements[key]['n']} rows, not {n}")

    def commit(self) -> None:
        """Publishes the manifest in place of the one before."""
        self.check()
        self.files.replace(MANIFEST, self.manifest)
        self._new.clear()

    def abort(self) -> None:
        """Deletes what this object has written and not published."""
        for path in self._new:
            self.files.delete(path)
        self._new.clear()

    def __repr__(self) -> str:
        lines = [f"<Store {self.files.root}  {self.n_obs} x {self.n_vars}>"]
        lines += [f"  {key}: {e['kind']}{' ' + e['layout'] if 'layout' in e else ''}" for key, e in sorted(self.manifest["elements"].items())]
        return "\n".join(lines)

    def used(self) -> set[str]:
        return {p for e in self.manifest["elements"].values() for p in e["paths"]}


def check_target(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Fails before anything is read if the target is there and mustn't be replaced."""
    files = Files(spark, path)
    if files.exists() and (files.names() or files.exists(MANIFEST)) and not overwrite:
        raise StorageError(f"{path} exists; set overwrite to replace it")


@contextmanager
def new_store(spark: SparkSession, path: str, overwrite: bool = False):
    """A store to fill; published at the end, and without a trace if the block fails. A store it replaces stays readable until then."""
    check_target(spark, path, overwrite)
    files = Files(spark, path)
    fresh = not files.exists()
    old = Store.open(spark, path).used() if files.exists(MANIFEST) else set()
    store = Store.empty(spark, files)
    try:
        yield store
        store.commit()
    except BaseException:
        store.abort()
        if fresh:
            files.delete()
        raise
    for p in old - store.used():
        files.delete(p)


def verified(store: Store, before: dict | None = None) -> dict[str, int]:
    """Reads matrices and frames: packed arrays, coordinates, counts against the manifest. A StorageError names what is wrong.

    before: the elements of a manifest that was verified; of an element that only got more files since, only these are read.
    """
    out = {}
    for key in store.matrix_keys():
        e, old = store._element(key), _kept(store, key, before)
        first, known = (old["shape"][0], old["nnz"]) if old else (0, 0)
        fresh = e["paths"][len(old["paths"]) if old else 0 :]
        if not fresh:
            out[key] = known
            continue
        found = replace(store.matrix(key), df=store._read(e | {"paths": fresh})).verify()
        if found["nnz"] and found["r0"] < first:
            raise StorageError(f"added rows of {key} begin at {found['r0']}, not after {first} rows")
        if e["layout"] != "dense" and found["nnz"] != e["nnz"] - known:
            raise StorageError(f"{key} holds {found['nnz'] + known} entries, the manifest says {e['nnz']}")
        out[key] = found["nnz"] + known
    for key, n in (("obs", store.n_obs), ("var", store.n_vars)):
        if store.has(key):
            e, old = store._element(key), _kept(store, key, before)
            known = old["n"] if old else 0
            fresh = e["paths"][len(old["paths"]) if old else 0 :]
            got = store._read(e | {"paths": fresh}).agg(F.count("*"), F.countDistinct(e["id"]), F.min(e["id"])).first() if fresh else (0, 0, None)
            if tuple(got)[:2] != (n - known, n - known) or (got[0] and got[2] < known):
                raise StorageError(f"{key} has {got[0] + known} rows, not {n}")
    return out


def _kept(store: Store, key: str, before: dict | None) -> dict | None:
    """The element as it was before, if all its files are still the first ones."""
    old, e = (before or {}).get(key), store._element(key)
    return old if old and old.get("layout") == e.get("layout") and e["paths"][: len(old["paths"])] == old["paths"] else None

"""Which loader reads a path: registered kinds, and detection by content."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..config import AppConfig
from ..errors import ConversionError
from ..plans.files import Files, is_remote
from ..plans.store import MANIFEST, Store
from . import hdf5, zarr
from .annotated import Annotated, eager, from_object, is_annotated
from .tables import load_tables

Loader = Callable[[SparkSession, str, AppConfig], Annotated]
Sniffer = Callable[[str], str | None]


def load_store(spark: SparkSession, path: str, cfg: AppConfig) -> Annotated:
    """A store of this engine."""
    return of_store(Store.open(spark, path))


def of_store(store: Store) -> Annotated:
    raw = (store.matrix("raw/X"), store.frame("raw/var")) if store.has("raw/X") else None
    groups = {g: {k: store.table(f"{g}/{k}") for k in store.keys(g)} for g in ("obsm", "varm", "obsp", "varp")}
    return Annotated(store.frame("obs"), store.frame("var"), store.matrix(), {k: store.matrix(f"layers/{k}") for k in store.keys("layers")}, raw, **groups, uns=dict(store.uns), raw_varm={k: store.table(f"raw/varm/{k}") for k in store.keys("raw/varm")}, kind="store")


_loaders: dict[str, Loader] = {"store": load_store, "tables": load_tables, "zarr": zarr.load, "h5ad": hdf5.load_h5ad, "tenx": hdf5.load_tenx}
_sniffers: list[tuple[str, Sniffer]] = []


def register_source(kind: str, loader: Loader, *, sniffer: Sniffer | None = None) -> None:
    """Adds an input kind, or replaces it; its sniffer is asked before the built-in ones, in order of registration."""
    _loaders[kind] = loader
    if sniffer:
        _sniffers[:] = [x for x in _sniffers if x[0] != kind] + [(kind, sniffer)]


def kinds() -> list[str]:
    return sorted(_loaders)


def detect_format(spark: SparkSession, path: str) -> str:
    """The kind of an input, by its content, never its name."""
    files = Files(spark, path)
    if not files.exists():
        raise ConversionError(f"{path} does not exist")
    for _, sniffer in _sniffers:
        if found := sniffer(path):
            return found
    if files.exists(MANIFEST):
        return "store"
    if files.exists("repo.json"):
        return "repo"
    if files.exists("zarr.json"):
        return "zarr"
    if files.exists("entries.parquet"):
        return "tables"
    if not is_remote(path) and os.path.isfile(path) and (found := hdf5.sniff(path)):
        return found
    raise ConversionError(f"the format of {path} is not recognised; name it with fmt (--from): {', '.join(kinds())}")


def open_source(spark: SparkSession, source, cfg: AppConfig | None = None, *, fmt: str | None = None) -> Annotated:
    """An input as an annotated matrix: a path, an object with the attributes of one, or an Annotated as it is. Without cfg.io.lazy it is read at once."""
    cfg = cfg or AppConfig()
    if not isinstance(source, Annotated) and is_annotated(source):
        source = from_object(spark, source)
    if isinstance(source, Annotated):
        return source if cfg.io.lazy else eager(source)
    kind = fmt or detect_format(spark, source)
    if kind not in _loaders:
        raise ConversionError(f"there is no source kind {kind!r}; there are {', '.join(kinds())}")
    found = _loaders[kind](spark, source, cfg)
    return found if cfg.io.lazy else eager(found)

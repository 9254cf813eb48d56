"""The operations on stores: convert, concat, rechunk, sort, append (and its plan), add_layer. Each ends in one manifest commit."""

from __future__ import annotations

import copy
import warnings
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig, validated
from ..errors import ConversionError, LoomError, StorageError, ValidationError
from ..functions.lineage import stable
from ..functions.runtime import stage
from ..functions.scalar import lossless
from ..operators.frames import ColumnPlan, Frame, added_rows, duplicate_names, extend, plan_columns, same_names, with_sort_keys
from ..operators.layout import check_chunk_axis
from ..operators.matrix import Matrix, sort_permutation
from ..sources.annotated import Annotated, require_matrix
from ..sources.registry import of_store, open_source
from .repo import Repo
from .store import OpResult, Store, check_target, new_store, verified

NO_BRANCH = "branch and message need a repository"


# -- opening targets


def _target(spark: SparkSession, output, cfg: AppConfig, branch, message, metadata: dict):
    """A context that gives an empty store to fill, published as a plain store or as one commit."""
    if isinstance(output, Repo) or cfg.io.backend == "repo":
        repo = output if isinstance(output, Repo) else (Repo(spark, output) if Repo.exists(spark, output) else Repo.create(spark, output))
        return repo.writing(branch=branch, message=message or metadata["op"], metadata=metadata, empty=True)
    if branch or message:
        raise ValidationError(NO_BRANCH)
    return new_store(spark, output, cfg.io.overwrite)


def _opened(spark: SparkSession, store) -> Store:
    """A store for reading: a path to a plain store or a repository, a Repo, or a Store."""
    if isinstance(store, Store):
        return store
    if isinstance(store, Repo):
        return store.store()
    return Repo(spark, store).store() if Repo.exists(spark, store) else Store.open(spark, store)


def _path(target) -> str:
    return target.path if isinstance(target, Repo) else target.files.root if isinstance(target, Store) else target


class _InPlace:
    """An existing store that an operation changes: published when the block ends well, untouched otherwise."""

    def __init__(self, spark: SparkSession, store, branch, message, metadata, commit: bool):
        self.spark, self.target, self.branch, self.message, self.metadata, self.publish = spark, store, branch, message, metadata, commit
        is_repo = isinstance(store, Repo) or (isinstance(store, str) and Repo.exists(spark, store))
        if not commit and not isinstance(store, Repo):
            raise ValidationError("commit=False needs a Repo, to which the change stays staged" if is_repo else "commit=False only applies to a repository")
        if not is_repo and (branch or message):
            raise ValidationError(NO_BRANCH)
        self.repo = store if isinstance(store, Repo) else Repo(spark, store) if is_repo else None
        self.snapshot_id = None

    def __enter__(self) -> Store:
        if self.repo:
            self.context = self.repo.writing(branch=self.branch, message=self.message or self.metadata["op"], metadata=self.metadata, publish=self.publish)
            self.store = self.context.__enter__()
        else:
            self.store = Store.open(self.spark, self.target)
        return self.store

    def __exit__(self, kind, error, trace):
        if self.repo:
            done = self.context.__exit__(kind, error, trace)
            self.snapshot_id = self.repo.tip if self.publish and error is None else None
            return done
        if error is not None:
            self.store.abort()
            return False
        self.store.commit()
        return False


# -- convert


def _write(store: Store, a: Annotated, cfg: AppConfig) -> None:
    """All elements of an annotated matrix into an empty store."""
    store.manifest |= {"n_obs": a.obs.n, "n_vars": a.var.n, "uns": a.uns}
    store.put_frame("obs", a.obs)
    store.put_frame("var", a.var)
    store.put_matrix("X", a.X, cfg)
    for name, m in a.layers.items():
        store.put_matrix(f"layers/{name}", m, cfg)
    if a.raw:
        store.put_matrix("raw/X", a.raw[0], cfg)
        store.put_frame("raw/var", a.raw[1])
        for name, df in a.raw_varm.items():
            store.put_table(f"raw/varm/{name}", df)
    for group in ("obsm", "varm", "obsp", "varp"):
        for name, df in getattr(a, group).items():
            store.put_table(f"{group}/{name}", df)


@stage("convert")
def convert(spark: SparkSession, inputs, *, output, cfg: AppConfig | None = None, fmt: str | None = None, branch: str | None = None, message: str | None = None) -> OpResult:
    """One input into a store, or several stacked by rows. Inputs are paths, annotated matrices, or a list of them."""
    cfg = validated(cfg or AppConfig())
    inputs = list(inputs) if isinstance(inputs, (list, tuple)) else [inputs]
    if not inputs:
        raise ValidationError("there is no input")
    check_chunk_axis(cfg.chunks, cfg.io.layout)
    if not isinstance(output, Repo) and cfg.io.backend == "plain":
        check_target(spark, output, cfg.io.overwrite)  # before any input is opened
    if len(inputs) > 1:
        return concat(spark, inputs, output=output, cfg=cfg, branch=branch, message=message)
    source = inputs[0]
    if isinstance(source, Repo) or (isinstance(source, str) and fmt in (None, "repo") and Repo.exists(spark, source)):
        raise ValidationError("the input is a repository already: use rechunk or sort")
    a = open_source(spark, source, cfg, fmt=fmt)
    if a.kind == "store":
        raise ValidationError("the input is a store already: use rechunk or sort")
    for text in a.warnings:
        warnings.warn(text, stacklevel=2)
    require_matrix(a)
    if cfg.grouping.enabled:
        a = sorted_rows(a, list(cfg.grouping.sort_by))
    with _target(spark, output, cfg, branch, message, {"op": "convert", "source": str(source) if isinstance(source, str) else a.kind}) as store:
        _write(store, a, cfg)
    return _result(output, a.obs.n, a.var.n)


def _result(output, n_obs: int, n_vars: int) -> OpResult:
    return OpResult(_path(output), n_obs, n_vars, output.tip if isinstance(output, Repo) else None)


def concat(spark: SparkSession, inputs: list, *, output, cfg: AppConfig | None = None, branch: str | None = None, message: str | None = None) -> OpResult:
    """Rows of all inputs below each other; X, obs and var only. Columns must be the same, or are projected to concat.obs_columns."""
    cfg = validated(cfg or AppConfig())
    parts = [open_source(spark, x, cfg) for x in inputs]
    for a in parts:
        require_matrix(a)
    for a in parts[1:]:
        if a.var.n != parts[0].var.n or not same_names(parts[0].var.df, a.var.df, "col_id"):
            raise ValidationError("inputs differ in their var names or order")
    obs = stack_frames([a.obs for a in parts], cfg.concat.obs_columns)
    x = parts[0].X.stacked(*(a.X for a in parts[1:]))
    whole = Annotated(obs, parts[0].var, x, kind="concat")
    if cfg.grouping.enabled:
        whole = sorted_rows(whole, list(cfg.grouping.sort_by))
    with _target(spark, output, cfg, branch, message, {"op": "convert", "inputs": len(parts)}) as store:
        _write(store, whole, cfg)
    return _result(output, obs.n, parts[0].var.n)


def stack_frames(frames: list[Frame], columns: tuple[str, ...] = ()) -> Frame:
    """Rows of several frames with the same columns, or projected to `columns`. Categories must be the same sets; numbers widen with a warning."""
    if columns:
        for f in frames:
            if missing := [c for c in columns if c not in f.names]:
                raise ValidationError(f"obs columns {', '.join(missing)} are missing in an input")
            if left := [c for c in f.names if c not in columns]:
                warnings.warn(f"obs columns left out: {', '.join(left)}", stacklevel=2)
    elif any(f.names != frames[0].names for f in frames):
        raise ValidationError("inputs differ in their obs columns; name the common ones with obs_columns")
    names = list(columns) or frames[0].names
    out = []
    for name in names:
        own = [f.column(name) for f in frames]
        if len({c.encoding == "categorical" for c in own}) > 1 or len({frozenset(c.categories) for c in own}) > 1:
            raise ValidationError(f"categories of {name!r} differ between inputs")
        kinds = {c.type for c in own}
        nullable = next((c.encoding for c in own if c.encoding.startswith("nullable-")), own[0].encoding)
        if len(kinds) > 1:
            if not kinds <= {"tinyint", "smallint", "int", "bigint", "float", "double"}:
                raise ValidationError(f"column {name!r} is {' and '.join(sorted(kinds))} in different inputs")
            wide = "double" if kinds & {"float", "double"} else "bigint"
            warnings.warn(f"column {name!r} becomes {wide}", stacklevel=2)
            out.append(replace(own[0], encoding=nullable, type=wide))
        else:
            out.append(replace(own[0], encoding=nullable))
    parts, at = [], 0
    for f in frames:
        parts.append(f.df.select((F.col(f.id) + F.lit(at).cast("bigint")).alias(f.id), "name", *(F.col(c.name).cast(c.type).alias(c.name) for c in out)))
        at += f.n
    return Frame(reduce(DataFrame.unionByName, parts), frames[0].id, at, tuple(out))


# -- rechunk


@stage("rechunk")
def rechunk(spark: SparkSession, store, *, output, matrix: str = "X", cfg: AppConfig | None = None, branch: str | None = None, message: str | None = None) -> OpResult:
    """A copy of a store with one matrix on another chunk grid, in its own layout; all else is copied as it is."""
    cfg = validated(cfg or AppConfig())
    source = _opened(spark, store)
    if matrix not in source.matrix_keys():
        raise ValidationError(f"there is no matrix {matrix!r}; there are {', '.join(source.matrix_keys())}")
    m = source.matrix(matrix)
    check_chunk_axis(cfg.chunks, m.layout)
    level = cfg.chunks.clevel if cfg.chunks.clevel is not None else source.config_of(matrix).clevel
    with _target(spark, output, cfg, branch, message, {"op": "rechunk", "matrix": matrix}) as target:
        target.manifest |= {"n_obs": source.n_obs, "n_vars": source.n_vars, "uns": source.uns}
        for key in source.manifest["elements"]:
            if key != matrix:
                target.copy_from(source, key)
        element = source._element(matrix)
        again = replace(m, df=m.entries(), layout="entries") if m.layout == "dense" else m
        target.put_matrix(matrix, again, chunks=replace(cfg.chunks, clevel=level), layout=element["layout"], nnz=element["nnz"], source=element["source"])
    return _result(output, source.n_obs, source.n_vars)


# -- sort


def permutation(obs: Frame, by: list[str]) -> DataFrame:
    """obs with new_row_id: its place in a stable sort by columns, categories in their own order."""
    if not by:
        raise ValidationError("sort needs at least one column")
    keyed, keys = with_sort_keys(obs, by)
    for name in by:
        if obs.column(name).type in ("float", "double") and obs.df.where(F.isnan(name)).limit(1).count():
            raise ValidationError(f"column {name!r} has NaN, which has no place in an order")
    return sort_permutation(keyed, keys).drop(*keys)


def sorted_rows(a: Annotated, by: list[str]) -> Annotated:
    """All that is aligned with rows in sorted order: obs, X, layers, raw/X, obsm, and both axes of obsp."""
    placed = permutation(a.obs, by)
    perm = stable(placed.select("row_id", "new_row_id"), "permutation")
    obs = replace(a.obs, df=placed.drop("row_id").withColumnRenamed("new_row_id", "row_id").select("row_id", "name", *a.obs.names))
    moved = lambda df: df.join(perm, "row_id").drop("row_id").withColumnRenamed("new_row_id", "row_id").select(*df.columns)
    graph = lambda df: Matrix.of_entries(df, a.obs.n, a.obs.n).permuted(perm, cols=True).entries()
    return replace(
        a, obs=obs, X=a.X.permuted(perm), layers={k: m.permuted(perm) for k, m in a.layers.items()}, raw=(a.raw[0].permuted(perm), a.raw[1]) if a.raw else None,
        obsm={k: moved(df) for k, df in a.obsm.items()}, obsp={k: graph(df) for k, df in a.obsp.items()},
    )


@stage("sort")
def sort(spark: SparkSession, store, *, output, by: list[str], cfg: AppConfig | None = None, branch: str | None = None, message: str | None = None) -> OpResult:
    """A copy of a store with its rows sorted; every matrix keeps its layout and chunks."""
    cfg = validated(cfg or AppConfig())
    source = _opened(spark, store)
    if not by:
        raise ValidationError("sort needs at least one column")
    a = of_store(source)
    require_matrix(a)
    done = sorted_rows(a, list(by))
    with _target(spark, output, cfg, branch, message, {"op": "sort", "by": list(by)}) as target:
        target.manifest |= {"n_obs": source.n_obs, "n_vars": source.n_vars, "uns": source.uns}
        target.put_frame("obs", done.obs)
        rows = {"X": done.X, **{f"layers/{k}": m for k, m in done.layers.items()}, **({"raw/X": done.raw[0]} if done.raw else {})}
        for key, m in rows.items():
            e = source._element(key)
            target.put_matrix(key, m, chunks=source.config_of(key), layout=e["layout"], nnz=e["nnz"], source=e["source"])
        for group in ("obsm", "obsp"):
            for name, df in getattr(done, group).items():
                target.put_table(f"{group}/{name}", df)
        for key in source.manifest["elements"]:
            if key not in target.manifest["elements"]:
                target.copy_from(source, key)
    return _result(output, source.n_obs, source.n_vars)


# -- append


@dataclass(frozen=True)
class AppendPlan:
    """What append would do; nothing is written."""

    n_new: int
    drop_obsm: tuple[str, ...]
    drop_obsp: tuple[str, ...]
    drop_layers: tuple[str, ...]
    append_layers: tuple[str, ...]
    n_duplicate_names: int
    notes: tuple[str, ...]
    columns: ColumnPlan

    def drops(self) -> list[str]:
        return [*(f"obsm/{k}" for k in self.drop_obsm), *(f"obsp/{k}" for k in self.drop_obsp), *(f"layers/{k}" for k in self.drop_layers)]


def layer_decisions(store: list[str], cells: list[str]) -> list[tuple[str, str]]:
    """(layer, append | drop | leave out) by where it is."""
    return [(k, "append" if k in cells else "drop") for k in sorted(store)] + [(k, "leave out") for k in sorted(set(cells) - set(store))]


def _plan(target: Store, cells: Store, include_new: bool) -> AppendPlan:
    notes = []
    for name, s in (("store", target), ("cells", cells)):
        if s.matrix().layout != "csr":
            raise ValidationError(f"X of the {name} is {s.matrix().layout}; append needs csr")
    if target.has("raw/X"):
        raise ValidationError("the store has raw; drop raw first")
    if cells.has("raw/X"):
        notes.append("raw of the cells is left out")
    mine, theirs = target.frame("var"), cells.frame("var")
    if mine.n != theirs.n or not same_names(mine.df, theirs.df, "col_id"):
        raise ValidationError("store and cells differ in their var names or order")
    if target.matrix().dtype != cells.matrix().dtype:
        raise ValidationError(f"X is {target.matrix().dtype} in the store and {cells.matrix().dtype} in the cells")
    decisions = layer_decisions(target.keys("layers"), cells.keys("layers"))
    shared = tuple(k for k, d in decisions if d == "append")
    for k in shared:
        own, new = target.matrix(f"layers/{k}"), cells.matrix(f"layers/{k}")
        if (new.n_rows, new.n_cols) != (cells.n_obs, cells.n_vars):
            raise ValidationError(f"layer {k!r} of the cells is {new.n_rows} x {new.n_cols}")
        if not lossless(new.dtype, own.dtype):
            raise ValidationError(f"layer {k!r} loses values as {own.dtype}: it is {new.dtype} in the cells")
        if own.layout == "csc":
            notes.append(f"layer {k!r} is csc and is written anew")
    if left := [k for k, d in decisions if d == "leave out"]:
        notes.append(f"layers only the cells have, left out: {', '.join(left)}")
    columns = plan_columns(target.frame("obs"), cells.frame("obs"), include_new=include_new)
    marked = duplicate_names(cells.frame("obs").df.select("row_id", "name"), "name", "row_id", target.frame("obs").df.select("name"))
    again = marked.where("duplicate").count()
    if again == cells.n_obs:
        raise ValidationError("every name of the cells is in the store or repeats; they seem to have been appended before")
    dropped = tuple(k for k, d in decisions if d == "drop")
    return AppendPlan(cells.n_obs, tuple(target.keys("obsm")), tuple(target.keys("obsp")), dropped, shared, again, (*notes, *columns.notes), columns)


def plan_append(spark: SparkSession, store, *, cells, include_new_obs: bool = False) -> AppendPlan:
    """Checks whether cells fit a store, and says what appending them would do."""
    return _plan(_opened(spark, store), _opened(spark, cells), include_new_obs)


@stage("append")
def append(spark: SparkSession, store, *, cells, drop_derived: bool = False, include_new_obs: bool = False, cfg: AppConfig | None = None, branch: str | None = None, message: str | None = None, commit: bool = True, uns: dict | None = None) -> OpResult:
    """Adds the rows of another store: new files for csr and dense matrices, csc layers anew. All or nothing, plain stores too.

    uns: entries to set in the store's uns by the same commit.
    """
    cfg = validated(cfg or AppConfig())
    new = _opened(spark, cells)
    place = _InPlace(spark, store, branch, message, {"op": "append", "cells": _path(cells)}, commit)
    with place as target:
        plan = _plan(target, new, include_new_obs)  # on the branch that is written
        if plan.drops() and not drop_derived:
            raise ValidationError(f"append would drop {', '.join(plan.drops())}; set drop_derived to agree")
        for note in plan.notes:
            warnings.warn(note, stacklevel=2)
        if plan.n_duplicate_names:
            warnings.warn(f"{plan.n_duplicate_names} of {plan.n_new} names are in the store or repeat", stacklevel=2)
        warnings.warn("rows sorted before are no longer contiguous; sort again", stacklevel=2)
        for key in plan.drops():
            if hint := target._element(key).get("source"):
                warnings.warn(f"{key} goes; add_layer from {hint} makes it again", stacklevel=2)
            target.drop(key)
        n, old_n = new.n_obs, target.n_obs
        before = copy.deepcopy(target.manifest["elements"])
        for key in ("X", *(f"layers/{k}" for k in plan.append_layers)):
            own, more = target.matrix(key), new.matrix(key).cast(target.matrix(key).dtype)
            e = target._element(key)
            if own.layout == "csc":
                both = replace(own, df=own.entries(), layout="entries").stacked(replace(more, df=more.entries(), layout="entries"))
                target.put_matrix(key, both, chunks=target.config_of(key), layout="csc", source=e["source"])
                continue
            if own.layout == "csr":
                packed = more.to("csr")
            else:  # the cells' files have their rows in order; stretches of the same width aren't moved again
                packed = more if (more.layout, more.col_chunk) == ("dense", own.col_chunk) else more.dense_in_order(own.col_chunk)
            shifted = packed.df.withColumn("row_id", F.col("row_id") + F.lit(old_n).cast("bigint")).select(*own.df.columns)
            placed = shifted if own.layout == "dense" else shifted.repartitionByRange("row_id").sortWithinPartitions("row_id")
            target.add_files(key, placed, rows=n, nnz=more.nnz())
        obs, cells_obs = target.frame("obs"), new.frame("obs")
        both = extend(obs, cells_obs, plan.columns)
        if set(both.names) == set(obs.names):
            target.grow_frame("obs", added_rows(obs, cells_obs, plan.columns), both)
        else:
            target.put_frame("obs", both)
        target.manifest["n_obs"] = old_n + n
        target.manifest["uns"] = {**target.uns, **(uns or {})}
        try:
            verified(target, before)
        except (StorageError, ConversionError) as e:
            raise StorageError(f"the appended store doesn't verify, and nothing was published: {e}") from e
        result = OpResult(_path(store), target.n_obs, target.n_vars)
    return replace(result, snapshot_id=place.snapshot_id)


# -- layers


@stage("add_layer")
def add_layer(spark: SparkSession, store, *, layer: str, matrix: str = "X", layout: str = "csc", overwrite: bool = False, cfg: AppConfig | None = None, branch: str | None = None, message: str | None = None, commit: bool = True) -> OpResult:
    """Copies a matrix into a layer with a layout of its own; values stay as they are."""
    cfg = validated(replace(cfg or AppConfig(), io=replace((cfg or AppConfig()).io, layout=layout)))
    check_chunk_axis(cfg.chunks, layout)
    place = _InPlace(spark, store, branch, message, {"op": "add_layer", "matrix": matrix, "layer": layer, "layout": layout}, commit)
    with place as target:
        if matrix not in target.matrix_keys():
            raise ValidationError(f"there is no matrix {matrix!r}; there are {', '.join(target.matrix_keys())}")
        if target.has(f"layers/{layer}") and not overwrite:
            raise ValidationError(f"layer {layer!r} exists; set overwrite to replace it")
        m = target.matrix(matrix)
        if (m.n_rows, m.n_cols) != (target.n_obs, target.n_vars):
            raise ValidationError(f"{matrix} is {m.n_rows} x {m.n_cols}, the store {target.n_obs} x {target.n_vars}")
        if matrix == "raw/X" and not same_names(target.frame("raw/var").df, target.frame("var").df, "col_id"):
            raise ValidationError("raw/var differs from var")
        target.put_matrix(f"layers/{layer}", m, cfg, layout=layout, source=matrix, nnz=target._element(matrix)["nnz"], filed=True)
        result = OpResult(_path(store), target.n_obs, target.n_vars)
    return replace(result, snapshot_id=place.snapshot_id)


__all__ = ["AppendPlan", "LoomError", "add_layer", "append", "concat", "convert", "plan_append", "rechunk", "sort"]

"""Frozen configuration objects; flags overlay them with apply_overrides()."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, replace

from .errors import ValidationError

LAYOUTS = ("csr", "csc", "dense")
BACKENDS = ("plain", "repo")
DENSE_CHUNK = 2048
NNZ_CHUNK = 9_000_000
DEFAULT_LEVEL = 3


@dataclass(frozen=True)
class IOConfig:
    overwrite: bool = False
    layout: str = "csr"
    lazy: bool = True
    backend: str = "plain"


@dataclass(frozen=True)
class ChunkConfig:
    row_chunk: int | None = None
    col_chunk: int | None = None
    nnz_chunk: int = NNZ_CHUNK
    cpus: int | None = None
    shard_factor: int = 1
    auto_shard: bool = False
    clevel: int | None = None


@dataclass(frozen=True)
class GroupingConfig:
    enabled: bool = False
    sort_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class ConcatConfig:
    obs_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class AppConfig:
    io: IOConfig = field(default_factory=IOConfig)
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    grouping: GroupingConfig = field(default_factory=GroupingConfig)
    concat: ConcatConfig = field(default_factory=ConcatConfig)


def validated(cfg: AppConfig) -> AppConfig:
    """cfg, or a ValidationError that names the field."""
    if cfg.io.layout not in LAYOUTS:
        raise ValidationError(f"layout must be one of {', '.join(LAYOUTS)}, not {cfg.io.layout!r}")
    if cfg.io.backend not in BACKENDS:
        raise ValidationError(f"backend must be one of {', '.join(BACKENDS)}, not {cfg.io.backend!r}")
    if cfg.grouping.enabled and not cfg.grouping.sort_by:
        raise ValidationError("grouping is enabled but sort_by names no column")
    for name in ("row_chunk", "col_chunk", "nnz_chunk", "cpus", "shard_factor"):
        value = getattr(cfg.chunks, name)
        if value is not None and value < 1:
            raise ValidationError(f"{name} must be at least 1, not {value}")
    if cfg.chunks.clevel is not None and not 0 <= cfg.chunks.clevel <= 9:
        raise ValidationError(f"clevel must be from 0 to 9, not {cfg.chunks.clevel}")
    if cfg.chunks.shard_factor > 1 and cfg.io.layout != "dense":
        warnings.warn("shard_factor only applies to dense output", stacklevel=2)
    return cfg


def apply_overrides(cfg: AppConfig, **flags) -> AppConfig:
    """cfg with every flag that isn't None, each in the group that has a field of its name."""
    groups = {}
    for name, value in flags.items():
        if value is None:
            continue
        group = next((g.name for g in fields(cfg) if name in {f.name for f in fields(getattr(cfg, g.name))}), None)
        if group is None:
            raise ValidationError(f"no configuration field is called {name!r}")
        groups.setdefault(group, {})[name] = tuple(value) if isinstance(value, list) else value
    if "sort_by" in groups.get("grouping", {}):
        groups["grouping"].setdefault("enabled", bool(groups["grouping"]["sort_by"]))
    return validated(replace(cfg, **{g: replace(getattr(cfg, g), **x) for g, x in groups.items()}))

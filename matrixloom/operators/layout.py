"""Layout arithmetic: chunk shapes, flat chunks, bands of rows, and the warnings that go with them."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DENSE_CHUNK, ChunkConfig
from .ordinals import with_prefix_sum

#: Bytes of a band, and what writing adds to it.
BAND_BYTES = 512 << 20
WRITE_COPY = 0.85
#: Bytes of a value; wider types (decimals) take 16.
ITEM_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def dense_chunks(n_rows: int, n_cols: int, cfg: ChunkConfig) -> tuple[int, int]:
    """The tile shape: what is asked for, or the default, but never beyond the matrix."""
    return min(cfg.row_chunk or DENSE_CHUNK, max(n_rows, 1)), min(cfg.col_chunk or DENSE_CHUNK, max(n_cols, 1))


def dense_shards(shape: tuple[int, int], chunks: tuple[int, int], factor: int) -> tuple[int, int] | None:
    """Rows and columns of a shard: whole chunks, no more than the axis has; None without sharding."""
    if factor <= 1:
        return None
    return tuple(c * min(factor, max(1, math.ceil(n / c))) for n, c in zip(shape, chunks, strict=True))


def flat_chunk(nnz: int, n_major: int, per_major: int | None, cfg: ChunkConfig) -> int:
    """Nonzeros of a chunk of a sparse matrix: so many rows' (columns') worth, or the flat default; from 1 to nnz."""
    wanted = math.ceil(per_major * nnz / n_major) if per_major and n_major else cfg.nnz_chunk
    return max(1, min(wanted, max(nnz, 1)))


def rows_per_file(nnz: int, n_major: int, cfg: ChunkConfig, layout: str) -> int:
    """How many packed rows a file holds so that it has about a flat chunk of nonzeros."""
    per = cfg.row_chunk if layout == "csr" else cfg.col_chunk
    chunk = flat_chunk(nnz, n_major, per, cfg)
    return max(1, math.ceil(chunk * max(n_major, 1) / max(nnz, 1)))


def item_bytes(dtype: str) -> int:
    return ITEM_BYTES.get(dtype, 16)


def auto_factor(chunk_bytes: float, budget: int = BAND_BYTES) -> int:
    """How many chunks a file holds under auto_shard: what a band's budget has room for, at least one."""
    return max(1, int(budget / (max(chunk_bytes, 1) * (1 + WRITE_COPY))))


def rows_per_partition(n_major: int, major_bytes: float, cpus: int, grain: int = 1) -> int:
    """Rows (columns) that one task of a source reads: the first of plan_bands."""
    bands = plan_bands(n_major, major_bytes, cpus=cpus, grain=grain)
    return bands[0][1] if bands else 1


def check_chunk_axis(cfg: ChunkConfig, layout: str) -> list[str]:
    """Warns of chunk settings that the layout doesn't use."""
    idle = {"csr": ["col_chunk"], "csc": ["row_chunk"], "dense": []}[layout]
    said = [f"{name} has no effect on {layout} output" for name in idle if getattr(cfg, name) is not None]
    for text in said:
        warnings.warn(text, stacklevel=2)
    return said


def fixed_bands(n: int, size: int) -> list[tuple[int, int]]:
    """[0, n) in bands of `size`."""
    return [(i, min(i + size, n)) for i in range(0, n, size)]


def plan_bands(n_rows: int, row_bytes: float, *, budget: int = BAND_BYTES, cpus: int = 1, unit: int = 1, grain: int = 1) -> list[tuple[int, int]]:
    """Bands of whole write units: within the budget, at least one for each cpu, and multiples of the source's grain where one fits."""
    if n_rows <= 0:
        return []
    most = max(1, int(budget / max(row_bytes * (1 + WRITE_COPY), 1e-9)))
    units = max(1, min(most // unit, math.ceil(math.ceil(n_rows / unit) / max(cpus, 1))))
    rows = units * unit
    both = math.lcm(unit, grain)
    if both <= rows:
        rows -= rows % both
    return fixed_bands(n_rows, rows)


def major_bands(indptr: Sequence[int], max_nnz: int) -> list[tuple[int, int]]:
    """Greedy bands of at most max_nnz nonzeros, at least one row each."""
    out, start = [], 0
    for row in range(1, len(indptr)):
        if indptr[row] - indptr[start] > max_nnz and row - 1 > start:
            out.append((start, row - 1))
            start = row - 1
    if len(indptr) > 1:
        out.append((start, len(indptr) - 1))
    return out


def weighted_bands(counts: DataFrame, row: str, nnz: str, max_nnz: int) -> DataFrame:
    """counts with band: rows whose nonzeros begin in one stretch of max_nnz share a band. Distributed; bands may exceed max_nnz by a row."""
    return with_prefix_sum(counts, [row], nnz, "_at").withColumn("band", F.floor(F.col("_at") / max_nnz).cast("bigint")).drop("_at")


def check_write_unit(unit_bytes: float, budget: int = BAND_BYTES) -> bool:
    """Warns if a single write unit exceeds the budget of a band."""
    if unit_bytes * (1 + WRITE_COPY) <= budget:
        return True
    warnings.warn(f"one write unit takes {unit_bytes / 1e6:.0f} MB, more than a band's budget", stacklevel=2)
    return False

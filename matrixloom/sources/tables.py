"""A folder of Parquet tables: entries (row_id, col_id, value), obs (row_id, name, ...) and var (col_id, name, ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import AppConfig
from ..operators.frames import normalise
from ..operators.matrix import Matrix, require_unique
from .annotated import Annotated


def load_tables(spark: SparkSession, path: str, cfg: AppConfig) -> Annotated:
    """Frames number their rows from 0; a coordinate must not come twice."""
    entries, obs, var = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("entries", "obs", "var"))
    n_obs, n_vars = obs.count(), var.count()
    require_unique(entries)
    return Annotated(normalise(obs, "row_id", n_obs), normalise(var, "col_id", n_vars), Matrix.of_entries(entries, n_obs, n_vars), kind="tables")

"""Small annotated matrices, and readers that turn engine objects into arrays."""

import numpy as np
import pandas as pd

from matrixloom.sources.annotated import from_arrays


def small(spark, n=12, m=6, seed=0, **more):
    """Whole-number float32 values on a slanted stripe of the matrix, with gaps by the seed; the second row is empty. One category of three kinds."""
    rng = np.random.default_rng(seed)
    i, j = np.indices((n, m))
    x = np.where(((2 * i + 3 * j + seed) % 5 < 2) & (rng.random((n, m)) < 0.9), 1 + (i * m + j) % 8, 0).astype(np.float32)
    x[1] = 0
    obs = pd.DataFrame({"kind": pd.Categorical.from_codes((np.arange(n) * 7 + seed) % 3, ["tall", "short", "mid"])}, index=[f"row-{seed}-{r}" for r in range(n)])
    for k, v in more.pop("obs", {}).items():
        obs[k] = v
    return x, from_arrays(spark, x, obs, pd.DataFrame(index=[f"col-{c}" for c in range(m)]), **more)


def dense(matrix, dtype=float):
    out = np.zeros((matrix.n_rows, matrix.n_cols), dtype)
    for r in matrix.entries().collect():
        assert out[r.row_id, r.col_id] == 0, "a coordinate comes twice"
        out[r.row_id, r.col_id] = r.value
    return out


def table(frame):
    return frame.df.orderBy(frame.id).toPandas()

import math

import numpy as np
import pytest
from helpers import dense, small
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matrixloom.errors import ConversionError, ValidationError
from matrixloom.operators import layout, matrix
from matrixloom.operators.matrix import Matrix, require_unique
from matrixloom.operators.ordinals import with_ordinal, with_prefix_sum
from matrixloom.config import ChunkConfig
from matrixloom.sources.annotated import matrix_from


@pytest.mark.parametrize("source", ["csr", "csc", "dense"])
@pytest.mark.parametrize("target", ["csr", "csc", "dense", "entries"])
def test_layouts_hold_the_same_values(spark, source, target):
    x, a = small(spark)
    assert (dense(a.X.to(source, col_chunk=4).to(target, col_chunk=3)) == x).all()


def test_parts_bound_packed_arrays(spark, monkeypatch):
    monkeypatch.setattr(matrix, "PART", 4)
    x, a = small(spark, 20, 9)
    packed = a.X.to("csc")
    assert packed.df.agg(F.max(F.size("indices"))).first()[0] <= 4
    assert (dense(packed) == x).all()
    assert [r.nnz for r in packed.col_nnz().orderBy("col_id").collect()] == (x != 0).sum(0).tolist()


def test_nan_stays_negative_zero_goes_explicit_zero_stays(spark):
    m = matrix_from(spark, np.array([[np.nan, -0.0], [0.0, 1.0]]))
    kept = sorted((r.row_id, r.col_id) for r in m.entries().collect())
    assert kept == [(0, 0), (1, 1)]
    sparse = matrix_from(spark, (np.array([0.0, 2.0]), np.array([1, 0]), np.array([0, 1, 2]), (2, 2)))
    assert sparse.to("csr").to("csc").nnz() == 2


def test_counts_and_positions(spark):
    x, a = small(spark)
    assert [r.nnz for r in a.X.row_nnz().orderBy("row_id").collect()] == (x != 0).sum(1).tolist()
    assert [r.indptr for r in a.X.indptr().orderBy("row_id").collect()] == np.concatenate(([0], np.cumsum((x != 0).sum(1))[:-1])).tolist()
    flat = a.X.numbered().orderBy("position").collect()
    rows, cols = np.nonzero(x)
    assert [(r.row_id, r.col_id, r.position) for r in flat] == list(zip(rows.tolist(), cols.tolist(), range(len(rows)), strict=True))
    assert [r.position for r in a.X.flat(3, 7).orderBy("position").collect()] == [3, 4, 5, 6]


def test_selections(spark):
    x, a = small(spark)
    for source in ("csr", "csc", "dense"):
        m = a.X.to(source, col_chunk=4)
        assert (dense(m.rows(2, 7))[2:7] == x[2:7]).all()
        assert (dense(m.cols(1, 4))[:, 1:4] == x[:, 1:4]).all()
        block = m.block(2, 6, 1, 5).orderBy("row_id", "col_id").collect()
        assert [r.value for r in block] == x[2:6, 1:5].ravel().tolist()
    kept = spark.createDataFrame([(4,), (1,)], "col_id bigint")
    assert (dense(a.X.keep_cols(kept)) == x[:, [1, 4]]).all()
    assert (dense(a.X.to("csc").transposed()) == x.T).all()


def test_stacking_checks_and_shifts(spark):
    (x, a), (y, b) = small(spark, 5), small(spark, 4, seed=3)
    for source in ("csr", "dense", "csc"):
        both = a.X.to(source, col_chunk=4).stacked(b.X.to(source, col_chunk=4))
        assert (dense(both) == np.vstack([x, y])).all()
    with pytest.raises(ConversionError):
        a.X.stacked(small(spark, 4, 5)[1].X)
    with pytest.raises(ConversionError):
        a.X.stacked(b.X.cast("double"))


def test_verify_finds_faults(spark):
    bad = spark.createDataFrame([(0, 0, 1.0), (5, 0, 1.0)], "row_id bigint, col_id bigint, value double")
    with pytest.raises(ConversionError):
        Matrix.of_entries(bad, 2, 2).verify()
    with pytest.raises(ConversionError):
        require_unique(bad.union(bad))
    with pytest.raises(ValidationError):
        Matrix.of_entries(bad, 6, 1).to("coo")
    with pytest.raises(ConversionError):
        matrix_from(spark, np.zeros(3))


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_ordinals_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("k"), "id", F.lit(3).alias("n"))
    got = with_ordinal(df, ["k", "id"], "o", partitions).toPandas().sort_values(["k", "id"])
    assert got.o.tolist() == list(range(500))
    sums = with_prefix_sum(df, ["k", "id"], "n", "s", partitions).toPandas().sort_values(["k", "id"])
    assert sums.s.tolist() == [3 * i for i in range(500)]


def test_ordinals_of_nothing(spark):
    assert with_ordinal(spark.range(0), ["id"], "o").count() == 0


@given(st.integers(1, 5000), st.floats(1, 1e6), st.integers(1, 8), st.integers(1, 64), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_bands_tile_the_rows(n, row_bytes, cpus, unit, grain):
    bands = layout.plan_bands(n, row_bytes, budget=1 << 20, cpus=cpus, unit=unit, grain=grain)
    assert bands[0][0] == 0 and bands[-1][1] == n
    assert all(a[1] == b[0] for a, b in zip(bands, bands[1:], strict=False))
    assert all(s % unit == 0 for s, _ in bands)
    assert len(bands) >= min(cpus, math.ceil(n / unit)) or len(bands) >= math.ceil(n / unit / math.ceil(math.ceil(n / unit) / cpus))


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 80))
@settings(max_examples=60, deadline=None)
def test_major_bands_hold_at_most_max_nnz(counts, most):
    indptr = [0, *np.cumsum(counts).tolist()]
    bands = layout.major_bands(indptr, most)
    assert [i for a, b in bands for i in range(a, b)] == list(range(len(counts)))
    assert all(indptr[b] - indptr[a] <= most or b - a == 1 for a, b in bands)


@given(st.integers(1, 300), st.integers(1, 300), st.integers(1, 40), st.integers(2, 9))
@settings(max_examples=40, deadline=None)
def test_shards_are_whole_chunks(rows, cols, chunk, factor):
    chunks = layout.dense_chunks(rows, cols, ChunkConfig(row_chunk=chunk, col_chunk=chunk))
    shards = layout.dense_shards((rows, cols), chunks, factor)
    assert all(s % c == 0 and s <= c * factor for s, c in zip(shards, chunks, strict=True))
    assert layout.dense_shards((rows, cols), chunks, 1) is None


def test_flat_chunks():
    cfg = ChunkConfig(nnz_chunk=100)
    assert layout.flat_chunk(0, 5, None, cfg) == 1
    assert layout.flat_chunk(1000, 10, 3, cfg) == 300
    assert layout.flat_chunk(50, 10, None, cfg) == 50
    with pytest.warns(UserWarning):
        layout.check_chunk_axis(ChunkConfig(col_chunk=3), "csr")

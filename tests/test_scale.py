"""What queries move grows with the entries of a matrix, not with its cells."""

import numpy as np
import pytest
from helpers import dense, small
from pyspark.sql import functions as F

import matrixloom as ml
from matrixloom.config import AppConfig, ChunkConfig
from matrixloom.plans.catalogue import QUERIES
from matrixloom.plans.store import STRETCH, Store

ORDERS, SUPPLIERS = 200, 40_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Some orders of three suppliers each, among many suppliers; the last order has none."""
    path = str(tmp_path_factory.mktemp("wide"))
    ids = spark.range(ORDERS)
    status = F.when(F.col("id") % 2 == 0, "F").otherwise("O")
    ids.select(F.col("id").alias("o_orderkey"), status.alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority"), F.lit(1.0).alias("o_totalprice")).write.parquet(f"{path}/orders.parquet")
    spark.range(SUPPLIERS).select(F.col("id").alias("s_suppkey"), F.format_string("S%06d", "id").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{path}/supplier.parquet")
    line = ids.where(F.col("id") < ORDERS - 1).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_k"))
    key = (F.col("l_orderkey") * 977 + F.col("_k") * (SUPPLIERS // 2 - 1)) % SUPPLIERS
    line.select("l_orderkey", key.cast("bigint").alias("l_suppkey"), (F.col("_k") + 2).cast("double").alias("l_quantity")).write.parquet(f"{path}/lineitem.parquet")
    return path


def facts(spark, path):
    return {(r.l_orderkey, r.l_suppkey): int(r.l_quantity) for r in spark.read.parquet(f"{path}/lineitem.parquet").collect()}


def written(spark, run):
    """What run returns, and the records that its stages wrote for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_dense_rows_are_filled_without_moving_their_zeros(spark, wide):
    rows, moved = written(spark, lambda: QUERIES["dense_pack"](spark, wide).collect())
    found = facts(spark, wide)
    assert sorted(r.row_id for r in rows) == list(range(ORDERS - 1))
    for r in rows:
        values = r.row_values.split(",")
        assert len(values) == SUPPLIERS and {(r.row_id, c): int(v) for c, v in enumerate(values) if v != "0"} == {k: v for k, v in found.items() if k[0] == r.row_id}
    # Both spines are numbered by one shuffle and joined by another; stretches of zeros alone would add 1250 records a row.
    assert moved < 2 * (SUPPLIERS + ORDERS) + 10 * len(found)


def test_dense_layers_hold_stretches_near_their_entries(spark, wide):
    got = QUERIES["append_dense_layer"](spark, wide)
    half = ORDERS // 2
    expected = {(k // 2 + half * (k % 2), c): v for (k, c), v in facts(spark, wide).items()}
    assert {(r.row_id, r.col_id): int(r.value) for r in got.collect()} == expected and got.count() == len(expected)
    files = got.inputFiles()
    values = spark.read.parquet(*files).agg(F.sum(F.size("values"))).first()[0]
    assert values <= STRETCH * len(expected)  # a tile of 2048 columns isn't written for each
    store = Store.open(spark, files[0].split("/data/")[0])
    assert store._element("layers/copy")["chunks"][1] == 2048


def test_dense_files_of_other_widths(spark, tmp_path):
    """Stores from before stretches, whose tiles are as wide as their stretches; cells of another width are cut anew."""
    (x, a), (y, b) = small(spark, 9), small(spark, 5, seed=1)
    paths = [str(tmp_path / "s"), str(tmp_path / "cells")]
    for path, what, width in zip(paths, (a, b), (4, 5), strict=True):
        ml.convert(spark, what, output=path)
        ml.add_layer(spark, path, layer="tiles", layout="dense", cfg=AppConfig(chunks=ChunkConfig(col_chunk=width)))
        store = Store.open(spark, path)
        assert store.matrix("layers/tiles").col_chunk == store.manifest["elements"]["layers/tiles"].pop("stretch") == width
        store.commit()
    with pytest.warns(UserWarning):
        ml.append(spark, paths[0], cells=paths[1])
    assert (dense(Store.open(spark, paths[0]).matrix("layers/tiles")) == np.vstack([x, y])).all()

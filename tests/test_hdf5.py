"""HDF5 inputs on a stand-in for h5py, which is sent to the workers; with the real package these tests are skipped."""

import importlib.util
from pathlib import Path

import numpy as np
import pytest
from helpers import dense, small, table

import matrixloom as ml
from matrixloom.errors import ConversionError
from matrixloom.plans.store import Store

pytestmark = [pytest.mark.filterwarnings("ignore"), pytest.mark.skipif(importlib.util.find_spec("h5py") is not None, reason="h5py is installed")]


@pytest.fixture(scope="module")
def h5(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).parent / "fakes" / "h5py.py"))
    import h5py

    return h5py


def sparse(h5, x, layout="csr"):
    y = x if layout == "csr" else x.T
    rows, cols = np.nonzero(y)
    indptr = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(y)))))
    return h5.Group({"data": h5.Dataset(y[rows, cols]), "indices": h5.Dataset(cols.astype(np.int32)), "indptr": h5.Dataset(indptr.astype(np.int32))}, **{"encoding-type": f"{layout}_matrix", "shape": x.shape})


def names(h5, prefix, n, **columns):
    index = h5.Dataset(np.array([f"{prefix}{i}".encode() for i in range(n)], object))
    return h5.Group({"_index": index, **columns}, **{"encoding-type": "dataframe", "_index": "_index", "column-order": list(columns)})


def h5ad(h5, x):
    n, m = x.shape
    kind = h5.Group({"codes": h5.Dataset((np.arange(n) % 3 - 1).astype(np.int8)), "categories": h5.Dataset(np.array([b"z", b"y"], object))}, **{"encoding-type": "categorical", "ordered": False})
    age = h5.Group({"values": h5.Dataset(np.arange(n)), "mask": h5.Dataset(np.arange(n) == 2)}, **{"encoding-type": "nullable-integer"})
    raw = h5.Group({"X": sparse(h5, x * 2, "csc"), "var": names(h5, "g", m), "varm": h5.Group({"load": h5.Dataset(np.ones((m, 2)))})})
    uns = h5.Group({"colours": h5.Dataset(np.array([b"red", b"blue"], object)), "n": h5.Dataset(np.int64(3)), "deep": h5.Group({"a": h5.Dataset(1.5)}, **{"encoding-type": "dict"}), "odd": h5.Group(**{"encoding-type": "csr_matrix"})})
    return h5.Group(
        {
            "X": sparse(h5, x), "obs": names(h5, "c", n, kind=kind, age=age), "var": names(h5, "g", m), "layers": h5.Group({"full": h5.Dataset(x + 1)}), "raw": raw, "uns": uns,
            "obsm": h5.Group({"pca": h5.Dataset(np.arange(2.0 * n).reshape(n, 2)), "table": h5.Group(**{"encoding-type": "dataframe"})}), "obsp": h5.Group({"near": sparse(h5, np.eye(n, k=1), "csc")}),
        },
        **{"encoding-type": "anndata"},
    )


@pytest.mark.parametrize("eager", [False, True])
def test_h5ad(spark, tmp_path, h5, eager):
    x, _ = small(spark)
    h5.save(tmp_path / "a.h5ad", h5ad(h5, x))
    path = str(tmp_path / "a.h5ad")
    assert ml.detect_format(spark, path) == "h5ad"
    cfg = ml.config.apply_overrides(ml.config.AppConfig(), lazy=not eager)
    assert ml.open_source(spark, path, cfg).lazy is not eager
    with pytest.warns(UserWarning) as said:
        ml.convert(spark, path, output=str(tmp_path / "s"), cfg=cfg)
    assert sorted(str(w.message).split(" is")[0] for w in said if "left out" in str(w.message)) == ["obsm/table", "uns/odd"]
    s = Store.open(spark, str(tmp_path / "s"))
    assert (dense(s.matrix()) == x).all() and (dense(s.matrix("layers/full")) == x + 1).all() and (dense(s.matrix("raw/X")) == x * 2).all()
    obs = table(s.frame("obs"))
    assert obs.name[0] == "c0" and obs.kind.tolist()[:3] == [None, "z", "y"] and obs.age.isna().tolist()[:4] == [False, False, True, False]
    assert [list(r.vec) for r in s.table("obsm/pca").orderBy("row_id").collect()] == np.arange(24.0).reshape(12, 2).tolist()
    assert [list(r.vec) for r in s.table("raw/varm/load").collect()] == [[1.0, 1.0]] * 6 and s.keys("varm") == [] and s.keys("raw/varm") == ["load"]
    assert sorted((r.row_id, r.col_id) for r in s.table("obsp/near").collect()) == [(i, i + 1) for i in range(11)]
    assert s.uns == {"colours": ["red", "blue"], "n": 3, "deep": {"a": 1.5}}


def texts(h5, values):
    return h5.Dataset(np.array([v.encode() for v in values], object))


def tenx(h5, x, **more):
    """Barcodes are rows of x; the last two features aren't genes."""
    g = sparse(h5, x.astype(np.int32))
    n, m = x.shape
    features = {
        "id": texts(h5, [f"id{i}" for i in range(m)]), "name": texts(h5, [f"name{i}" for i in range(m)]), "feature_type": texts(h5, ["Gene Expression"] * (m - 2) + ["Antibody Capture"] * 2),
        "genome": texts(h5, ["x"] * m), "target": h5.Dataset(np.arange(m) % 2 == 0), "_all_tag_keys": texts(h5, ["genome"]),
    }
    features.update(more.pop("features", {}))
    return h5.Group({"matrix": h5.Group({**g.children, "shape": h5.Dataset([m, n]), "barcodes": texts(h5, [f"b{i}" for i in range(n)]), "features": h5.Group(features), **more})})


def test_tenx(spark, tmp_path, h5):
    x, _ = small(spark)
    path = str(tmp_path / "t.h5")
    h5.save(path, tenx(h5, x, filtered_barcodes=h5.Dataset(np.arange(12) < 5)))
    assert ml.detect_format(spark, path) == "tenx"
    ml.convert(spark, path, output=str(tmp_path / "s"))
    s = Store.open(spark, str(tmp_path / "s"))
    var, obs = table(s.frame("var")), table(s.frame("obs"))
    assert (dense(s.matrix()) == x[:, :4]).all() and s.matrix().dtype == "float"
    assert var.name.tolist() == ["name0", "name1", "name2", "name3"] and var.gene_ids.tolist() == ["id0", "id1", "id2", "id3"]
    assert var.target.tolist() == [True, False, True, False] and s.frame("var").column("target").encoding == "boolean"
    assert obs.name[0] == "b0" and obs.filtered_barcodes.tolist() == [True] * 5 + [False] * 7


def test_tenx_probes_and_old_files(spark, tmp_path, h5):
    x, _ = small(spark)
    h5.save(tmp_path / "p.h5", tenx(h5, x, features={"gene_id": texts(h5, [f"gene{i}" for i in range(6)])}))
    var = table(ml.open_source(spark, str(tmp_path / "p.h5")).var)
    assert var.gene_ids.tolist()[:2] == ["gene0", "gene1"] and var.probe_ids.tolist()[:2] == ["id0", "id1"]
    genome = h5.Group({**sparse(h5, x.astype(np.int32)).children, "barcodes": texts(h5, [f"b{i}" for i in range(12)]), "genes": texts(h5, [f"id{i}" for i in range(6)]), "gene_names": texts(h5, [f"n{i}" for i in range(6)])})
    h5.save(tmp_path / "old.h5", h5.Group({"hg": genome}))
    assert ml.detect_format(spark, str(tmp_path / "old.h5")) == "tenx"
    old = ml.open_source(spark, str(tmp_path / "old.h5"))
    assert (dense(old.X) == x).all() and table(old.var).name.tolist()[0] == "n0"
    h5.save(tmp_path / "two.h5", h5.Group({"hg": genome, "mm": genome}))
    broken = tenx(h5, x)
    del broken["matrix"].children["features"].children["name"]
    h5.save(tmp_path / "broken.h5", broken)
    for name in ("two", "broken"):
        with pytest.raises(ConversionError):
            ml.open_source(spark, str(tmp_path / f"{name}.h5"), fmt="tenx")

import json
import os
import struct
import sys

import numpy as np
import pandas as pd
import pytest
import zstandard
from helpers import dense, small, table

import matrixloom as ml
from matrixloom import cli
from matrixloom.errors import ConversionError, StorageError, ValidationError
from matrixloom.functions import runtime
from matrixloom.plans import files
from matrixloom.plans.store import Store
from matrixloom.sources import annotated, blosc, hdf5, registry, zarr
from matrixloom.streaming.ingest import LAST, appender

pytestmark = pytest.mark.filterwarnings("ignore")


def zarr_store(root, x, layout="csr"):
    """An annotated-matrix group, written with this engine's own array writer."""
    zarr.write_group(str(root), {"encoding-type": "anndata", "encoding-version": "0.1.0"})
    n, m = x.shape
    if layout == "dense":
        zarr.write_array(f"{root}/X", x, (3, 2), {"encoding-type": "array"})
    else:
        y = x if layout == "csr" else x.T
        zarr.write_group(f"{root}/X", {"encoding-type": f"{layout}_matrix", "shape": [n, m]})
        rows, cols = np.nonzero(y)
        zarr.write_array(f"{root}/X/data", y[rows, cols], (5,))
        zarr.write_array(f"{root}/X/indices", cols.astype(np.int32), (5,))
        zarr.write_array(f"{root}/X/indptr", np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(y))))).astype(np.int32), (4,))
    zarr.write_group(f"{root}/obs", {"encoding-type": "dataframe", "_index": "_index", "column-order": ["kind", "age"]})
    zarr.write_array(f"{root}/obs/_index", np.array([f"c{i}" for i in range(n)], object), (4,), {"encoding-type": "string-array"})
    zarr.write_group(f"{root}/obs/kind", {"encoding-type": "categorical", "ordered": False})
    zarr.write_array(f"{root}/obs/kind/codes", (np.arange(n) % 3 - 1).astype(np.int8), (4,))
    zarr.write_array(f"{root}/obs/kind/categories", np.array(["z", "y"], object))
    zarr.write_group(f"{root}/obs/age", {"encoding-type": "nullable-integer"})
    zarr.write_array(f"{root}/obs/age/values", np.arange(n), (4,))
    zarr.write_array(f"{root}/obs/age/mask", np.arange(n) == 2, (4,))
    zarr.write_group(f"{root}/var", {"encoding-type": "dataframe", "_index": "_index", "column-order": []})
    zarr.write_array(f"{root}/var/_index", np.array([f"g{i}" for i in range(m)], object), None, {"encoding-type": "string-array"})


@pytest.mark.parametrize("layout", ["csr", "csc", "dense"])
def test_zarr_source(spark, tmp_path, layout):
    x, _ = small(spark)
    zarr_store(tmp_path / "z", x, layout)
    assert ml.detect_format(spark, str(tmp_path / "z")) == "zarr"
    ml.convert(spark, str(tmp_path / "z"), output=str(tmp_path / "s"))
    s = Store.open(spark, str(tmp_path / "s"))
    obs = table(s.frame("obs"))
    assert (dense(s.matrix()) == x).all() and s.frame("obs").column("kind").categories == ("z", "y")
    assert obs.kind.tolist()[:3] == [None, "z", "y"] and obs.age.isna().tolist()[:4] == [False, False, True, False]
    assert (dense(zarr.read_matrix(spark, str(tmp_path / "z/X"), 5)) == x).all()


def blosc_buffer(raw, item, block, flags):
    """A buffer of the format, by its description: zstd (number 4), filters by flags, streams of a block's bytes where it may be split."""
    out, places = b"", []
    count = -(-len(raw) // block)
    for k in range(count):
        part = np.frombuffer(raw[k * block : (k + 1) * block], np.uint8)
        whole = len(part) // item * item
        if flags & 1:
            part = np.concatenate([part[:whole].reshape(-1, item).T.ravel(), part[whole:]])
        elif flags & 4:
            whole = len(part) // (8 * item) * 8 * item
            bits = np.unpackbits(part[:whole].reshape(-1, item), axis=1, bitorder="little")
            part = np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), part[whole:]])
        places.append(16 + 4 * count + len(out))
        split = not flags & 16 and item <= 16 and len(part) == block and block // item >= 128
        for s in np.split(part, item) if split else [part]:
            c = zstandard.compress(s.tobytes())
            c = c if len(c) < len(s) else s.tobytes()
            out += struct.pack("<i", len(c)) + c
    body = struct.pack(f"<{count}I", *places) + out
    return struct.pack("<BBBBIII", 2, 1, flags | 4 << 5, item, len(raw), block, 16 + len(body)) + body


@pytest.mark.parametrize("flags", [0, 1, 4, 16, 17, 20])
def test_blosc_buffers(flags):
    rng = np.random.default_rng(flags)
    for dtype, n, block in ((np.float32, 5000, 4096), (np.int64, 777, 2048), (np.int8, 300, 256), (np.float64, 3, 64), (np.uint16, 0, 64)):
        x = np.where(rng.random(n) < 0.7, 0, rng.integers(0, 100, n)).astype(dtype)
        assert np.array_equal(np.frombuffer(blosc.decode(blosc_buffer(x.tobytes(), x.itemsize, block, flags)), dtype), x)
    plain = b"stored as it is"
    assert blosc.decode(struct.pack("<BBBBIII", 2, 1, 2 | 4 << 5, 1, len(plain), 64, 16 + len(plain)) + plain) == plain
    with pytest.raises(ConversionError, match="damaged"):
        blosc.decode(blosc_buffer(b"x" * 5000, 1, 1024, flags)[:-9])
    with pytest.raises(ConversionError, match="compressor"):
        blosc.decode(struct.pack("<BBBBIII", 2, 1, 0, 1, 5, 5, 25) + b"\0" * 9)


def test_zarr_elements_all_arrive(spark, tmp_path):
    """A store compressed by blosc, with everything that goes with a matrix."""
    root, x = tmp_path / "z", np.round(np.random.default_rng(2).random((7, 5)) * 4).astype(np.float32)
    zarr_store(root, x)
    pca, graph = np.arange(21, dtype=np.float32).reshape(7, 3) * (np.arange(7) != 4)[:, None], np.eye(7, k=1)
    for group in ("obsm", "varm", "obsp", "uns", "raw", "layers"):
        zarr.write_group(f"{root}/{group}", {"encoding-type": "dict"})
    zarr.write_array(f"{root}/obsm/pca", pca, (4, 3), {"encoding-type": "array"})
    zarr.write_array(f"{root}/varm/load", np.ones((5, 2)), None, {"encoding-type": "array"})
    zarr.write_array(f"{root}/obsp/near", graph, (3, 3), {"encoding-type": "array"})
    zarr.write_array(f"{root}/raw/X", x * 2, (3, 2), {"encoding-type": "array"})
    zarr.write_group(f"{root}/raw/var", {"encoding-type": "dataframe", "_index": "_index", "column-order": []})
    zarr.write_array(f"{root}/raw/var/_index", np.array([f"g{i}" for i in range(5)], object), None, {"encoding-type": "string-array"})
    zarr.write_array(f"{root}/uns/colours", np.array(["red", "blue"], object), None, {"encoding-type": "string-array"})
    zarr.write_group(f"{root}/uns/odd", {"encoding-type": "rec-array"})
    zarr.write_group(f"{root}/obsm/table", {"encoding-type": "dataframe"})
    for name in ("X/data", "X/indices", "X/indptr", "obsm/pca"):
        folder = root / name
        meta = json.loads((folder / "zarr.json").read_text())
        meta["codecs"][1] = {"name": "blosc", "configuration": {"cname": "zstd", "clevel": 3, "shuffle": "shuffle", "typesize": 4, "blocksize": 0}}
        (folder / "zarr.json").write_text(json.dumps(meta))
        for chunk in (p for p in (folder / "c").rglob("*") if p.is_file()):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(chunk.read_bytes())
            chunk.write_bytes(blosc_buffer(raw, np.dtype(meta["data_type"]).itemsize, 64, 1))
    with pytest.warns(UserWarning) as said:
        ml.convert(spark, str(root), output=str(tmp_path / "s"))
    assert sorted(str(w.message).split(" is")[0] for w in said if "left out" in str(w.message)) == ["obsm/table", "uns/odd"]
    s = Store.open(spark, str(tmp_path / "s"))
    assert (dense(s.matrix()) == x).all() and (dense(s.matrix("raw/X")) == x * 2).all() and s.frame("raw/var").n == 5
    assert [list(r.vec) for r in s.table("obsm/pca").orderBy("row_id").collect()] == pca.tolist()
    assert [list(r.vec) for r in s.table("varm/load").orderBy("col_id").collect()] == [[1.0, 1.0]] * 5
    assert sorted((r.row_id, r.col_id, r.value) for r in s.table("obsp/near").collect()) == [(i, i + 1, 1.0) for i in range(6)]
    assert s.uns == {"colours": ["red", "blue"]}


def test_zarr_arrays_read_ranges_shards_and_fill(tmp_path):
    x = np.arange(35.0).reshape(7, 5)
    zarr.write_array(str(tmp_path / "a"), x, (3, 2))
    a = zarr.Array(str(tmp_path / "a"))
    assert (a.read((1, 6), (1, 4)) == x[1:6, 1:4]).all() and (a.read() == x).all() and a.read((2, 2)).shape == (0, 5)
    (tmp_path / "a/c/0/0").unlink()
    assert (a.read()[:3, :2] == 0).all()
    meta = json.loads((tmp_path / "a/zarr.json").read_text())
    inner = [c.tobytes() for c in (x[:2, :2], x[:2, 2:4])]
    index = np.array([[0, 32], [32, 32], [2**64 - 1, 2**64 - 1], [2**64 - 1, 2**64 - 1]], np.uint64)
    meta |= {"shape": [4, 4], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4]}}}
    meta["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}}]
    (tmp_path / "b/c/0").mkdir(parents=True)
    (tmp_path / "b/zarr.json").write_text(json.dumps(meta))
    (tmp_path / "b/c/0/0").write_bytes(b"".join(inner) + index.tobytes() + b"\0\0\0\0")
    got = zarr.Array(str(tmp_path / "b")).read()
    assert (got[:2, :2] == x[:2, :2]).all() and (got[:2, 2:] == x[:2, 2:4]).all() and not got[2:].any()
    meta["codecs"] = [{"name": "bytes"}, {"name": "unheard-of"}]
    (tmp_path / "b/zarr.json").write_text(json.dumps(meta))
    with pytest.raises(ConversionError, match="unheard-of"):
        zarr.Array(str(tmp_path / "b")).read()
    with pytest.raises(ConversionError):
        zarr.Array(str(tmp_path / "absent"))


def test_zarr_export_round_trip(spark, tmp_path):
    x, a = small(spark)
    for chunk in (1, 7, 1000):
        path = str(tmp_path / f"m{chunk}")
        zarr.export_matrix(a.X, path, chunk)
        assert (dense(zarr.read_matrix(spark, path)) == x).all()
        assert zarr.Array(f"{path}/indptr").read().tolist() == [0, *np.cumsum((x != 0).sum(1)).tolist()] and not list(tmp_path.rglob("*.part"))
    none = ml.operators.matrix.Matrix.of_entries(a.X.entries().where("false"), 3, 2)
    zarr.export_matrix(none, str(tmp_path / "none"), 5)
    assert not dense(zarr.read_matrix(spark, str(tmp_path / "none"))).any()


def test_uneven_rows_are_read_in_bands(tmp_path, monkeypatch):
    x, path = np.triu(np.arange(1, 50).reshape(7, 7)), str(tmp_path / "z")
    zarr_store(tmp_path / "z", x)
    monkeypatch.setattr(zarr, "BAND_NNZ", 4)
    found = list(zarr._RowsReader({"path": f"{path}/X", "kind": "csr", "major": 7, "rows_per_partition": 5}).read(zarr._Range(1, 6)))
    assert found == [(i, list(range(i, 7)), x[i, i:].tolist()) for i in range(1, 6)]


def test_tables_source(spark, tmp_path):
    x, a = small(spark)
    for name, df in (("entries", a.X.entries()), ("obs", a.obs.df), ("var", a.var.df)):
        df.write.parquet(str(tmp_path / f"t/{name}.parquet"))
    assert ml.detect_format(spark, str(tmp_path / "t")) == "tables"
    assert (dense(ml.open_source(spark, str(tmp_path / "t")).X) == x).all()


def test_registered_sources(spark, tmp_path):
    x, a = small(spark)
    (tmp_path / "x.bin").write_text("magic")
    ml.register_source("bin", lambda spark, path, cfg: a, sniffer=lambda p: "bin" if p.endswith(".bin") else None)
    try:
        assert ml.detect_format(spark, str(tmp_path / "x.bin")) == "bin"
        ml.convert(spark, str(tmp_path / "x.bin"), output=str(tmp_path / "s"))
        with pytest.raises(ConversionError, match="bin"):
            ml.open_source(spark, str(tmp_path / "x.bin"), fmt="unknown")
    finally:
        registry._loaders.pop("bin")
        registry._sniffers.clear()
    with pytest.raises(ConversionError):
        ml.detect_format(spark, str(tmp_path / "x.bin"))


def test_feature_filter(spark):
    x, a = small(spark)
    kept = spark.createDataFrame([(0,), (3,)], "col_id bigint")
    assert (dense(hdf5.gene_expression(a.X, kept)) == x[:, [0, 3]]).all()


def test_hdf5_needs_its_package(tmp_path, monkeypatch):
    (tmp_path / "x.h5ad").write_bytes(hdf5.MAGIC + b"\0" * 16)
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ConversionError, match="h5py"):
        hdf5.sniff(str(tmp_path / "x.h5ad"))
    (tmp_path / "y").write_text("text")
    assert hdf5.sniff(str(tmp_path / "y")) is None


def test_frames_in_memory(spark):
    f = ml.from_arrays(spark, np.ones((3, 1)), pd.DataFrame({"u": ["a", "b", "c"], "r": ["a", "a", None], "i": pd.array([1, None, 2], dtype="Int32"), "f": [1.0, float("nan"), 2.0]}, index=list("xyz")), pd.DataFrame(index=["g"])).obs
    assert [c.encoding for c in f.columns] == ["string", "categorical", "nullable-array", "array"]
    assert f.column("r").categories == ("a",) and f.column("i").type == "int"
    with pytest.raises(ValidationError):
        f.column("absent")


class Sparse:
    """Sparse arrays as array libraries hold them."""

    def __init__(self, x, kind):
        y = x if kind == "csr" else x.T
        major, minor = np.nonzero(y)
        self.format, self.shape, self.data, self.indices = kind, x.shape, y[major, minor], minor
        self.indptr = np.concatenate(([0], np.cumsum(np.bincount(major, minlength=len(y)))))


class Object:
    def __init__(self, **attributes):
        self.__dict__.update(attributes)


def test_objects_in_memory(spark, tmp_path):
    x, _ = small(spark)
    obs, var = pd.DataFrame({"k": list("ab") * 6}, index=[f"r{i}" for i in range(12)]), pd.DataFrame(index=[f"c{i}" for i in range(6)])
    assert all((dense(annotated.matrix_from(spark, Sparse(x, kind))) == x).all() for kind in ("csr", "csc"))
    with pytest.raises(ConversionError, match="coo"):
        annotated.matrix_from(spark, Object(format="coo"))
    thing = Object(
        X=Sparse(x, "csc"), obs=obs, var=var, layers={"two": x * 2}, raw=Object(X=x, var=var, varm={"w": np.ones((6, 1))}), obsm={"pca": np.arange(24.0).reshape(12, 2), "thin": Sparse(x, "csr"), "table": obs},
        varm={}, obsp={"near": np.eye(12, k=1)}, varp={}, uns={"a": np.int64(1), "b": {"c": np.array(["x"])}, "odd": object()},
    )
    with pytest.warns(UserWarning) as said:
        ml.convert(spark, thing, output=str(tmp_path / "s"))
    assert sorted(str(w.message).split(" is")[0] for w in said if "left out" in str(w.message)) == ["obsm/table", "uns/odd"]
    s = Store.open(spark, str(tmp_path / "s"))
    assert (dense(s.matrix()) == x).all() and (dense(s.matrix("layers/two")) == x * 2).all() and s.uns == {"a": 1, "b": {"c": ["x"]}}
    assert [list(r.vec) for r in s.table("obsm/thin").orderBy("row_id").collect()] == x.tolist() and s.keys("raw/varm") == ["w"]


def test_usable_cpus(tmp_path, monkeypatch):
    monkeypatch.setattr(os, "process_cpu_count", lambda: 8)
    assert runtime.usable_cpus(str(tmp_path)) == 8
    (tmp_path / "proc/self").mkdir(parents=True)
    (tmp_path / "proc/self/cgroup").write_text("0::/a/b\n")
    for path, limit in (("", "max 100000"), ("a", "250000 100000"), ("a/b", "700000 100000")):
        (tmp_path / "sys/fs/cgroup" / path).mkdir(parents=True, exist_ok=True)
        (tmp_path / "sys/fs/cgroup" / path / "cpu.max").write_text(limit)
    assert runtime.usable_cpus(str(tmp_path)) == 3
    old = tmp_path / "old/sys/fs/cgroup/cpu"
    old.mkdir(parents=True)
    (old / "cpu.cfs_quota_us").write_text("-1")
    (old / "cpu.cfs_period_us").write_text("100000")
    assert runtime.usable_cpus(str(tmp_path / "old")) == 8
    (old / "cpu.cfs_quota_us").write_text("50000")
    assert runtime.usable_cpus(str(tmp_path / "old")) == 1


def test_lost_workers_and_stages(caplog):
    with pytest.raises(ConversionError, match="--cpus"), runtime.stage("sort"):
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")
    with pytest.raises(RuntimeError, match="else"), runtime.stage("sort"):
        raise RuntimeError("something else")
    with caplog.at_level("INFO", logger="matrixloom"), runtime.stage("sort"):
        pass
    assert [r.message.split(":")[0] for r in caplog.records] == ["sort", "sort"]


def test_storage_that_cannot_be_reached(spark):
    with pytest.raises(StorageError, match="aws sso login"):
        files.Files(spark, "s3a://nowhere/x")
    with pytest.raises(StorageError, match="gcloud"):
        ml.Repo.exists(spark, "gs://nowhere/x", anonymous=True)


def test_paths():
    assert files.scheme("s3://b/x") == "s3" and files.is_remote("hdfs://h/x") and not files.is_remote("/x") and not files.is_remote("file:///x")
    assert files.canonical("file:///a/b/") == "/a/b" and files.name_of("s3://b/x/") == "x" and files.is_read_only("https://h/x")


def test_command_line(spark, tmp_path, capsys):
    x, a = small(spark)
    for name, df in (("entries", a.X.entries()), ("obs", a.obs.df), ("var", a.var.df)):
        df.write.parquet(str(tmp_path / f"t/{name}.parquet"))
    t, s, u = (str(tmp_path / n) for n in "tsu")
    assert cli.main(["convert", t, "-o", s, "--layout", "csc", "-q"]) == 0
    assert "12 x 6" in capsys.readouterr().out
    assert cli.main(["convert", t, "-o", s]) == 1 and "error:" in capsys.readouterr().err
    assert cli.main(["convert", t, "-o", s, "--overwrite"]) == 0
    assert cli.main(["sort", s, "-o", u, "--by", "kind"]) == 0 and cli.main(["rechunk", s, "-o", str(tmp_path / "v"), "--row-chunk", "3"]) == 0
    assert cli.main(["add-layer", s, "--layer", "l"]) == 0 and cli.main(["append", s, s]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["convert", t, "-o", str(tmp_path / "w"), "--layout", "csr", "--col-chunk", "2"])
    assert e.value.code == 2


def test_stream_appends_each_batch_once(spark, tmp_path):
    _, a = small(spark)
    path = str(tmp_path / "s")
    ml.convert(spark, a, output=path)
    with pytest.raises(ValidationError, match="1 entries in columns"):
        appender(path, "r", "c", "v")(spark.createDataFrame([("n", "absent", 1.0)], "r string, c string, v double"), 0)
    with pytest.raises(ValidationError, match="unknown"):
        appender(path, "r", "c", "v", unknown="drop")
    run = appender(path, "r", "c", "v", unknown="skip")
    batch = spark.createDataFrame([("n1", "col-0", 2.0), ("n1", "col-0", 3.0), ("n2", "col-5", 1.0), ("n2", "absent", 1.0)], "r string, c string, v double")
    run(batch, 0)
    run(batch, 0)
    s = Store.open(spark, path)
    x = dense(s.matrix())
    assert s.n_obs == 14 and x[12, 0] == 5 and x[13, 5] == 1 and s.uns[LAST] == 0
    source, target = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame([("n3", "col-1", 4.0)], "r string, c string, v double").write.parquet(source)
    stream = spark.readStream.schema("r string, c string, v double").parquet(source).writeStream.foreachBatch(lambda df, i: run(df, i + 1)).option("checkpointLocation", target).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert Store.open(spark, path).n_obs == 15

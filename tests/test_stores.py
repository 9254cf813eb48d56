import os

import numpy as np
import pandas as pd
import pytest
from helpers import dense, small, table

import matrixloom as ml
from matrixloom.config import AppConfig, ChunkConfig, ConcatConfig, GroupingConfig, IOConfig, apply_overrides
from matrixloom.errors import ConversionError, RepoError, StorageError, ValidationError
from matrixloom.plans import ops
from matrixloom.plans.store import Store, verified

pytestmark = pytest.mark.filterwarnings("ignore")


def full(spark, n=12, seed=0, **obs):
    rng = np.random.default_rng(seed + 9)
    graph = np.arange(n * n, dtype=float).reshape(n, n)
    x, a = small(spark, n, seed=seed, obs=obs, obsm={"X_pca": rng.random((n, 2))}, obsp={"distances": graph}, uns={"note": {"made": "here"}})
    a.layers["counts"] = a.X.cast("int")
    a.raw = (a.X, a.var)
    return x, a


@pytest.mark.parametrize("layout", ["csr", "csc", "dense"])
def test_convert_keeps_everything(spark, tmp_path, layout):
    x, a = full(spark)
    path = str(tmp_path / "s")
    done = ml.convert(spark, a, output=path, cfg=AppConfig(io=IOConfig(layout=layout), chunks=ChunkConfig(row_chunk=5 if layout != "csc" else None)))
    assert (done.n_obs, done.n_vars, done.snapshot_id) == (12, 6, None)
    s = Store.open(spark, path)
    assert s.matrix().layout == layout and (dense(s.matrix()) == x).all() and (dense(s.matrix("layers/counts")) == x).all()
    assert s.matrix_keys() == ["X", "layers/counts", "raw/X"] and s.uns == {"note": {"made": "here"}}
    assert s.frame("obs").column("kind").categories == ("tall", "short", "mid")
    assert s.table("obsp/distances").count() == 12 * 12 - 1
    assert verified(s)["X"] == (x != 0).sum()


def test_convert_refuses(spark, tmp_path):
    x, a = small(spark)
    path = str(tmp_path / "s")
    ml.convert(spark, a, output=path)
    with pytest.raises(StorageError):
        ml.convert(spark, "no such input", output=path)  # the target is looked at first
    with pytest.raises(ValidationError):
        ml.convert(spark, path, output=str(tmp_path / "t"))
    with pytest.raises(ValidationError):
        ml.convert(spark, [], output=str(tmp_path / "t"))
    with pytest.raises(ConversionError):
        ml.convert(spark, str(tmp_path / "absent"), output=str(tmp_path / "t"))
    with pytest.raises(ValidationError):
        ml.convert(spark, a, output=str(tmp_path / "t"), branch="dev")
    y, b = small(spark, 7, seed=5)
    ml.convert(spark, b, output=path, cfg=AppConfig(io=IOConfig(overwrite=True)))
    assert (dense(Store.open(spark, path).matrix()) == y).all()


def test_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    _, a = small(spark)
    path = str(tmp_path / "s")
    monkeypatch.setattr(Store, "commit", lambda self: (_ for _ in ()).throw(StorageError("no")))
    with pytest.raises(StorageError):
        ml.convert(spark, a, output=path)
    assert not os.path.exists(path)


def test_failed_overwrite_keeps_the_old_store(spark, tmp_path, monkeypatch):
    x, a = small(spark)
    path = str(tmp_path / "s")
    ml.convert(spark, a, output=path)
    with monkeypatch.context() as m:
        m.setattr(Store, "check", lambda self: (_ for _ in ()).throw(StorageError("no")))
        with pytest.raises(StorageError):
            ml.convert(spark, small(spark, 5, seed=2)[1], output=path, cfg=AppConfig(io=IOConfig(overwrite=True)))
    assert (dense(Store.open(spark, path).matrix()) == x).all()


def test_concat(spark, tmp_path):
    (x, a), (y, b) = small(spark, 5), small(spark, 4, seed=1)
    path = str(tmp_path / "s")
    ml.convert(spark, [a, b], output=path)
    s = Store.open(spark, path)
    assert (dense(s.matrix()) == np.vstack([x, y])).all()
    assert table(s.frame("obs")).name.tolist() == [f"row-0-{i}" for i in range(5)] + [f"row-1-{i}" for i in range(4)]
    c = small(spark, 4, seed=2, obs={"extra": [1, 2, 3, 4]})[1]
    with pytest.raises(ValidationError):
        ml.convert(spark, [a, c], output=str(tmp_path / "t"))
    ml.convert(spark, [a, c], output=str(tmp_path / "t"), cfg=AppConfig(concat=ConcatConfig(obs_columns=("kind",))))
    with pytest.raises(ValidationError):
        ml.convert(spark, [a, c], output=str(tmp_path / "u"), cfg=AppConfig(concat=ConcatConfig(obs_columns=("absent",))))
    with pytest.raises(ValidationError):
        ml.convert(spark, [a, small(spark, 4, 5)[1]], output=str(tmp_path / "u"))


def test_sort_moves_everything_together(spark, tmp_path):
    x, a = full(spark, tag=[1, 0] * 6)
    path, out = str(tmp_path / "s"), str(tmp_path / "t")
    ml.convert(spark, a, output=path)
    ml.sort(spark, path, output=out, by=["kind", "tag"])
    old, new = Store.open(spark, path), Store.open(spark, out)
    obs = table(old.frame("obs"))
    order = pd.DataFrame({"k": [("tall", "short", "mid").index(v) for v in obs.kind], "t": obs.tag}).sort_values(["k", "t"], kind="stable").index.to_numpy()
    assert table(new.frame("obs")).name.tolist() == obs.name[order].tolist()
    for key in ("X", "layers/counts", "raw/X"):
        assert (dense(new.matrix(key)) == dense(old.matrix(key))[order]).all()
    vec = {r.row_id: r.vec for r in new.table("obsm/X_pca").collect()}
    before = {r.row_id: r.vec for r in old.table("obsm/X_pca").collect()}
    assert all(vec[i] == before[o] for i, o in enumerate(order.tolist()))
    graph = {(r.row_id, r.col_id): r.value for r in new.table("obsp/distances").collect()}
    assert all(graph.get((i, j), 0) == order[i] * 12 + order[j] for i in range(12) for j in range(12))
    by_sort = str(tmp_path / "u")
    ml.convert(spark, a, output=by_sort, cfg=AppConfig(grouping=GroupingConfig(enabled=True, sort_by=("kind", "tag"))))
    assert (dense(Store.open(spark, by_sort).matrix()) == x[order]).all()
    with pytest.raises(ValidationError):
        ml.sort(spark, path, output=str(tmp_path / "v"), by=[])
    with pytest.raises(ValidationError):
        ml.sort(spark, path, output=str(tmp_path / "v"), by=["absent"])


def test_sort_refuses_nan(spark, tmp_path):
    _, a = small(spark, obs={"score": [float("nan")] + [1.0] * 11})
    ml.convert(spark, a, output=str(tmp_path / "s"))
    with pytest.raises(ValidationError):
        ml.sort(spark, str(tmp_path / "s"), output=str(tmp_path / "t"), by=["score"])


def test_rechunk_changes_one_grid(spark, tmp_path):
    x, a = full(spark)
    path, out = str(tmp_path / "s"), str(tmp_path / "t")
    ml.convert(spark, a, output=path, cfg=AppConfig(io=IOConfig(layout="dense"), chunks=ChunkConfig(clevel=5)))
    ml.rechunk(spark, path, output=out, cfg=AppConfig(chunks=ChunkConfig(row_chunk=4, col_chunk=2)))
    s = Store.open(spark, out)
    assert s._element("X")["chunks"] == [4, 2] and s.config_of("X").clevel == 5 and s.config_of("layers/counts").row_chunk is None
    assert (dense(s.matrix()) == x).all() and (dense(s.matrix("layers/counts")) == x).all()
    with pytest.raises(ValidationError):
        ml.rechunk(spark, path, output=str(tmp_path / "u"), matrix="layers/absent")


def test_add_layer(spark, tmp_path):
    x, a = full(spark)
    path = str(tmp_path / "s")
    ml.convert(spark, a, output=path)
    ml.add_layer(spark, path, layer="by_gene")
    s = Store.open(spark, path)
    assert s.matrix("layers/by_gene").layout == "csc" and (dense(s.matrix("layers/by_gene")) == x).all() and s._element("layers/by_gene")["source"] == "X"
    for bad in ({"layer": "by_gene"}, {"layer": "x", "matrix": "layers/absent"}):
        with pytest.raises(ValidationError):
            ml.add_layer(spark, path, **bad)
    ml.add_layer(spark, path, layer="by_gene", layout="dense", overwrite=True, matrix="raw/X")
    with pytest.raises(ValidationError):
        ml.add_layer(spark, path, layer="y", commit=False)


def pair(spark, tmp_path, store=None, cells=None, raw=False):
    (x, a), (y, b) = full(spark, 8, tag=[1] * 8, **(store or {})), full(spark, 5, seed=4, tag=[2] * 5, **(cells or {}))
    if not raw:
        a.raw = b.raw = None
    paths = str(tmp_path / "s"), str(tmp_path / "c")
    for path, z in zip(paths, (a, b), strict=True):
        ml.convert(spark, z, output=path)
    return x, y, *paths


def test_append(spark, tmp_path):
    x, y, path, cells = pair(spark, tmp_path)
    ml.add_layer(spark, cells, layer="only_cells")
    plan = ml.plan_append(spark, path, cells=cells)
    assert plan.drops() == ["obsm/X_pca", "obsp/distances"] and plan.append_layers == ("counts",) and plan.n_new == 5
    with pytest.raises(ValidationError):
        ml.append(spark, path, cells=cells)
    before = Store.open(spark, path).used()
    done = ml.append(spark, path, cells=cells, drop_derived=True)
    s = Store.open(spark, path)
    assert done.n_obs == s.n_obs == 13 and (dense(s.matrix()) == np.vstack([x, y])).all() and (dense(s.matrix("layers/counts")) == np.vstack([x, y])).all()
    assert {p for p in before if p.startswith("data/X/")} < s.used(), "the files of X stay"
    assert table(s.frame("obs")).tag.tolist() == [1] * 8 + [2] * 5 and not s.keys("obsm")
    with pytest.raises(ValidationError, match="appended before"):
        ml.append(spark, path, cells=cells)


def test_append_refuses_raw_and_other_types(spark, tmp_path):
    _, _, path, cells = pair(spark, tmp_path, raw=True)
    with pytest.raises(ValidationError, match="raw"):
        ml.plan_append(spark, path, cells=cells)
    _, a = small(spark, 5, seed=8)
    a.X = a.X.cast("double")
    ml.convert(spark, a, output=str(tmp_path / "d"))
    ml.convert(spark, small(spark)[1], output=str(tmp_path / "e"))
    with pytest.raises(ValidationError, match="double"):
        ml.plan_append(spark, str(tmp_path / "e"), cells=str(tmp_path / "d"))
    ml.convert(spark, small(spark, 5, seed=8)[1], output=str(tmp_path / "f"), cfg=AppConfig(io=IOConfig(layout="csc")))
    with pytest.raises(ValidationError, match="csr"):
        ml.plan_append(spark, str(tmp_path / "e"), cells=str(tmp_path / "f"))


def test_append_columns(spark, tmp_path):
    wide = pd.Categorical([f"k{i}" for i in range(5)])
    x, y, path, cells = pair(spark, tmp_path, {"score": [0.5] * 8, "flag": [True] * 8, "label": pd.Categorical(["k0"] * 8)}, {"label": wide, "batch": ["p", "p", "q", "q", "q"]})
    plan = ml.plan_append(spark, path, cells=cells)
    assert plan.columns.promoted == ("flag",) and plan.columns.filled == ("score", "flag") and plan.columns.extra == ("batch",)
    assert next(c for c in plan.columns.columns if c.name == "label").categories == ("k0", "k1", "k2", "k3", "k4")
    ml.append(spark, path, cells=cells, drop_derived=True, include_new_obs=True)
    obs = table(Store.open(spark, path).frame("obs"))
    assert obs.flag.isna().sum() == 5 and np.isnan(obs.score[8:]).all() and obs.batch.tolist() == [None] * 8 + ["p", "p", "q", "q", "q"]
    assert Store.open(spark, path).frame("obs").names == ["kind", "tag", "score", "flag", "label", "batch"]


@pytest.mark.parametrize(
    ("mine", "theirs"),
    [([1] * 8, [1.5] * 5), (pd.Categorical(["a"] * 8, ordered=True), pd.Categorical(["b"] * 5, ordered=True)), ([f"id{i}" for i in range(8)], None)],
)
def test_append_refuses_columns(spark, tmp_path, mine, theirs):
    _, _, path, cells = pair(spark, tmp_path, {"c": mine}, {"c": theirs} if theirs is not None else {})
    with pytest.raises(ValidationError):
        ml.plan_append(spark, path, cells=cells)


def test_append_layers_by_type(spark, tmp_path):
    for name, mine, theirs, good in (("up", "double", "float", True), ("down", "float", "double", False), ("whole", "double", "bigint", False)):
        (x, a), (y, b) = small(spark, 6), small(spark, 3, seed=1)
        a.layers["l"], b.layers["l"] = a.X.cast(mine), b.X.cast(theirs)
        paths = str(tmp_path / f"{name}s"), str(tmp_path / f"{name}c")
        for path, z in zip(paths, (a, b), strict=True):
            ml.convert(spark, z, output=path)
        if good:
            ml.append(spark, paths[0], cells=paths[1])
            assert (dense(Store.open(spark, paths[0]).matrix("layers/l")) == np.vstack([x, y])).all()
        else:
            with pytest.raises(ValidationError, match="loses"):
                ml.plan_append(spark, paths[0], cells=paths[1])


def test_append_grows_csc_and_dense_layers(spark, tmp_path):
    (x, a), (y, b) = small(spark, 6), small(spark, 3, seed=1)
    paths = str(tmp_path / "s"), str(tmp_path / "c")
    for path, z in zip(paths, (a, b), strict=True):
        ml.convert(spark, z, output=path)
        ml.add_layer(spark, path, layer="columns", layout="csc")
        ml.add_layer(spark, path, layer="tiles", layout="dense", cfg=AppConfig(chunks=ChunkConfig(col_chunk=4)))
    ml.append(spark, paths[0], cells=paths[1])
    s = Store.open(spark, paths[0])
    for key, kind in (("layers/columns", "csc"), ("layers/tiles", "dense")):
        assert s.matrix(key).layout == kind and (dense(s.matrix(key)) == np.vstack([x, y])).all()


def test_append_reads_and_writes_only_what_is_new(spark, tmp_path):
    x, y, path, cells = pair(spark, tmp_path)
    old = Store.open(spark, path)
    ml.append(spark, path, cells=cells, drop_derived=True)
    s = Store.open(spark, path)
    before = old.manifest["elements"]
    for key in ("X", "obs"):
        assert s._element(key)["paths"][:1] == before[key]["paths"] and len(s._element(key)["paths"]) == 2
    assert verified(s)["X"] == verified(s, before)["X"] == np.count_nonzero(x) + np.count_nonzero(y)
    s._element("X")["nnz"] += 1
    with pytest.raises(StorageError, match="entries"):
        verified(s, before)
    s._element("X")["nnz"] -= 1
    s._element("obs")["paths"].append(before["obs"]["paths"][0])
    with pytest.raises(StorageError, match="obs"):
        verified(s, before)


@pytest.mark.parametrize("layout", ["csr", "dense"])
def test_files_of_many_chunks(spark, tmp_path, layout):
    x, a = small(spark)
    counts = []
    for auto in (False, True):
        path = str(tmp_path / f"s{auto}")
        ml.convert(spark, a, output=path, cfg=AppConfig(io=IOConfig(layout=layout), chunks=ChunkConfig(row_chunk=1, auto_shard=auto)))
        s = Store.open(spark, path)
        counts.append(len([f for f in os.listdir(s.files.uri(s._element("X")["paths"][0])) if f.endswith(".parquet")]))
        assert (dense(s.matrix()) == x).all()
    assert counts[0] > counts[1]


def test_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    x, _, path, cells = pair(spark, tmp_path)
    monkeypatch.setattr(ops, "verified", lambda *a: (_ for _ in ()).throw(StorageError("no")))
    with pytest.raises(StorageError):
        ml.append(spark, path, cells=cells, drop_derived=True)
    s = Store.open(spark, path)
    assert s.n_obs == 8 and (dense(s.matrix()) == x).all() and s.keys("obsm") == ["X_pca"]


# -- versions


def test_repo_history(spark, tmp_path):
    x, y, path, cells = pair(spark, tmp_path)
    repo = ml.Repo.init(spark, str(tmp_path / "r"), path)
    assert [s.message for s in repo.log()] == ["Initial import", "Repository initialized"] and not repo.dirty
    repo.checkout("dev", create=True)
    done = ml.append(spark, repo, cells=cells, drop_derived=True, message="more")
    assert done.snapshot_id == repo.tip and repo.log()[0].message == "more" and repo.log()[0].metadata["op"] == "append"
    assert repo.store().n_obs == 13 and repo.store(repo.log()[1].id).n_obs == 8
    repo.checkout("main")
    assert repo.store().n_obs == 8 and repo.branches == ["dev", "main"] and "*main" in repr(repo) and "On branch main" in repo.tree()
    assert repr(repo.branches) == "  dev\n* main" and repr(repo.log()).endswith("Repository initialized") and repr(repo.tree()) == str(repo.tree()) and not repo.resolved
    assert "X: matrix csr" in repr(repo.store())
    assert (dense(repo.store().matrix()) == x).all()
    again = repo.copy(str(tmp_path / "clone"))
    assert [s.id for s in again.log("dev")] == [s.id for s in repo.log("dev")]
    repo.checkout("dev").cherrypick(repo.log("main")[0].id)
    assert repo.store().n_obs == 8
    for bad in (lambda: repo.checkout("absent"), lambda: repo.checkout("main", create=True), lambda: repo.cherrypick("absent"), lambda: repo.commit("x"), lambda: ml.Repo(spark, path), lambda: ml.Repo.create(spark, path)):
        with pytest.raises(RepoError):
            bad()


def test_deferred_commits(spark, tmp_path):
    x, y, path, cells = pair(spark, tmp_path)
    repo = ml.Repo.init(spark, str(tmp_path / "r"), path)
    tip = repo.tip
    ml.append(spark, repo, cells=cells, drop_derived=True, commit=False)
    ml.add_layer(spark, repo, layer="by_gene", commit=False)
    assert repo.dirty and repo.tip == tip and repo.store().n_obs == 13
    with pytest.raises(RepoError):
        repo.checkout("dev", create=True)
    with pytest.raises(RepoError):
        ml.convert(spark, small(spark)[1], output=repo)
    repo.commit("both")
    assert not repo.dirty and repo.store().keys("layers") == ["by_gene", "counts"] and len(repo.log()) == 3
    ml.add_layer(spark, repo, layer="gone", commit=False)
    repo.discard()
    assert not repo.dirty and "gone" not in repo.store().keys("layers")
    repo.stage()
    with pytest.raises(RepoError):
        repo.commit("nothing")
    repo.commit("nothing", allow_empty=True)
    with pytest.raises(ValidationError, match="Repo"):
        ml.add_layer(spark, str(tmp_path / "r"), layer="z", commit=False)


def test_two_writers_conflict(spark, tmp_path):
    ml.convert(spark, small(spark)[1], output=str(tmp_path / "s"))
    one = ml.Repo.init(spark, str(tmp_path / "r"), str(tmp_path / "s"))
    two = ml.Repo(spark, str(tmp_path / "r"))
    ml.add_layer(spark, one, layer="a", commit=False)
    ml.add_layer(spark, two, layer="b")
    with pytest.raises(RepoError, match="moved"):
        one.commit("late")


def test_origin_takes_writes(spark, tmp_path):
    ml.convert(spark, small(spark)[1], output=str(tmp_path / "s"))
    origin = ml.Repo.init(spark, str(tmp_path / "o"), str(tmp_path / "s"))
    origin.copy(str(tmp_path / "mirror"))
    repo = ml.Repo(spark, str(tmp_path / "mirror"), origin=str(tmp_path / "o"))
    assert repo.resolved
    ml.add_layer(spark, repo, layer="a")
    assert repo.store().keys("layers") == ["a"] and origin.store().keys("layers") == ["a"]
    assert ml.Repo(spark, str(tmp_path / "mirror")).store().keys("layers") == []


def test_ops_work_on_repositories(spark, tmp_path):
    x, a = small(spark)
    cfg = AppConfig(io=IOConfig(backend="repo"))
    ml.convert(spark, a, output=str(tmp_path / "r"), cfg=cfg, message="first")
    done = ml.sort(spark, str(tmp_path / "r"), output=str(tmp_path / "r"), by=["kind"], cfg=cfg, branch="sorted")
    repo = ml.Repo(spark, str(tmp_path / "r"))
    assert repo.branches == ["main", "sorted"] and (dense(repo.store().matrix()) == x).all() and done.n_obs == 12


# -- configuration


def test_configuration():
    cfg = apply_overrides(AppConfig(), layout="csc", col_chunk=4, sort_by=["a"], clevel=0)
    assert (cfg.io.layout, cfg.chunks.col_chunk, cfg.grouping.sort_by, cfg.grouping.enabled, cfg.chunks.clevel) == ("csc", 4, ("a",), True, 0)
    for bad in ({"layout": "coo"}, {"row_chunk": 0}, {"clevel": 10}, {"backend": "x"}, {"unknown": 1}):
        with pytest.raises(ValidationError):
            apply_overrides(AppConfig(), **bad)
    with pytest.raises(ValueError, match="sort_by"):
        apply_overrides(AppConfig(grouping=GroupingConfig(enabled=True)))

"""The embedding join against brute force, the registered queries against SQL, and the pipeline against its stages."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from matrixloom.llm import bpe, embdedup, neardup, queries

SF = "/root/testdata/sf0.001"


def brute(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {i: 0 for i, _ in good}
    root = {i: i for i, _ in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(good):
        for k, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[k] += 1
                p, q = find(i), find(k)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i, _ in good}


@pytest.mark.parametrize("cell", [4000, 20])
def test_embedding_links_equal_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(scale=0.12 * (i % 4), size=8)).tolist()) for i in range(150)]
    rows += [(200, [0.0] * 8), (201, None), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, []), (206, rows[3][1]), (207, rows[3][1]), (208, [2 * x for x in rows[3][1]]), (209, rows[0][1][:4]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rep int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, cell=cell).collect()}
    want = brute(rows, 0.95)
    assert len(got) == len(rows)
    for i, _ in rows:
        n, c = want.get(i, (0, i))
        assert got[i] == (n, c, i is not None and c == i), i


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embdedup.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embdedup.near_duplicates(one).collect()] == [(1, 0, 1, True)]


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())


@needs_tables
def test_pipeline_runs_its_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    before, docs = documents, documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if name != "encoding":
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
        before = docs
    assert len(ids) > 0.6 * documents.count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "n_tokens", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens", "ids_sha256").collect()))


def test_pipeline_on_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids int"
    rows = [(1, None, "en", "s", None, 3), (2, "", None, None, 0, None), (2, "", None, None, 0, None)]
    for name, data, kind in (("documents", rows, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3


def test_last_stage_decodes(spark, tmp_path):
    texts = ["Plain words, and 12 numbers.", "", None, "é 日本  語"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    want = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, keep=("doc_id",))).collect()}
    for i in range(len(texts)):
        assert got[i].decoded_sha256 == hashlib.sha256(want[i].decoded.encode()).hexdigest() and bytes(got[i].ids) == bytes(want[i].ids)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    assert corpus_pipeline.ORACLE_SQL is None and __spark_entry__.queries().keys() >= {"pipeline", *queries.QUERIES} and sum(q.startswith("op") for q in queries.QUERIES) == 10

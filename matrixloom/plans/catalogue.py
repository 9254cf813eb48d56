"""The query catalogue: every operator of the engine on the star-schema tables, and the DuckDB SQL it must equal.

The matrix of most queries has orders as rows, suppliers as columns, and sums of l_quantity as values (whole numbers, so sums
don't depend on their order). Rows and columns are numbered by their keys.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig, ChunkConfig, ConcatConfig, GroupingConfig, IOConfig
from ..functions.lineage import shared_dir
from ..functions.scalar import code_width, joined, lossless
from ..operators import frames, layout
from ..operators.frames import Frame
from ..operators.matrix import Matrix, group_ranges, offsets, runs, sort_permutation
from ..operators.ordinals import with_ordinal
from ..sources.annotated import Annotated
from . import ops
from .repo import Repo
from .store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared SQL: the matrix, and the permutation that sorts its rows by priority and status.
M = """o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id FROM orders),
s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS col_id FROM supplier),
e AS (SELECT o.row_id, s.col_id, SUM(l.l_quantity) AS value FROM lineitem l JOIN o ON l.l_orderkey = o.o_orderkey JOIN s ON l.l_suppkey = s.s_suppkey GROUP BY o.row_id, s.col_id)"""
PERM = ", p AS (SELECT row_id, o_orderpriority, o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, row_id) - 1 AS BIGINT) AS new_row_id FROM o)"
WITH, WITH_PERM = f"WITH {M} ", f"WITH {M}{PERM} "


def query(oracle: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return with_ordinal(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").where(where), ["o_orderkey"], "row_id")


def _cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinal(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_suppkey"], "col_id")


def _matrix(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, cols: DataFrame | None = None, whole_rows: bool = False) -> Matrix:
    rows = with_ordinal(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "row_id") if rows is None else rows
    cols = with_ordinal(_table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "col_id") if cols is None else cols
    facts = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return Matrix.of_facts(facts, rows.select("o_orderkey", "row_id"), cols.select("s_suppkey", "col_id"), F.col("l_quantity"), rows.count(), cols.count(), on_row=F.expr("l_orderkey = o_orderkey"), on_col=F.expr("l_suppkey = s_suppkey"), whole_rows=whole_rows)


def _annotated(spark: SparkSession, sf_dir: str, where: str | None = None, numbers: bool = True) -> Annotated:
    """The matrix with its frames; where picks rows, which are numbered anew."""
    rows, cols = _rows(spark, sf_dir, where or "true"), _cols(spark, sf_dir)
    m = _matrix(spark, sf_dir, rows, cols)
    obs = rows.select("row_id", F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), *([F.col("o_orderkey").alias("key")] if numbers else []))
    var = cols.select("col_id", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return Annotated(frames.normalise(obs, "row_id", m.n_rows), frames.normalise(var, "col_id", m.n_cols), m)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _quietly(f, *args, **kwargs):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(*args, **kwargs)


# -- the relation and its packings


@query(WITH + "SELECT row_id, col_id, value FROM e")
def entries(spark, sf_dir):
    return _matrix(spark, sf_dir).entries()


_PACK = "string_agg(CAST({c} AS VARCHAR), ',' ORDER BY {c}) AS indices, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY {c}) AS data"


@query(WITH + f"SELECT row_id, CAST(COUNT(*) AS BIGINT) AS nnz, {_PACK.format(c='col_id')} FROM e GROUP BY row_id")
def csr_pack(spark, sf_dir):
    packed = _matrix(spark, sf_dir).to("csr").df
    return packed.select("row_id", F.size("indices").cast("bigint").alias("nnz"), joined(F.col("indices")).alias("indices"), joined(F.col("data")).alias("data"))


@query(WITH + f"SELECT col_id, CAST(COUNT(*) AS BIGINT) AS nnz, {_PACK.format(c='row_id')} FROM e GROUP BY col_id")
def csc_pack(spark, sf_dir):
    packed = _matrix(spark, sf_dir).to("csc").df
    return packed.groupBy("col_id").agg(F.array_sort(F.collect_list(F.struct("part", "indices", "data"))).alias("p")).select(
        "col_id", F.size(F.flatten("p.indices")).cast("bigint").alias("nnz"), joined(F.flatten("p.indices")).alias("indices"), joined(F.flatten("p.data")).alias("data")
    )


@query(WITH + "SELECT o.row_id, string_agg(CAST(CAST(COALESCE(e.value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY s.col_id) AS row_values FROM o CROSS JOIN s LEFT JOIN e ON e.row_id = o.row_id AND e.col_id = s.col_id WHERE o.row_id IN (SELECT row_id FROM e) GROUP BY o.row_id")
def dense_pack(spark, sf_dir):
    packed = _matrix(spark, sf_dir, whole_rows=True).to("dense", col_chunk=32)
    # Stretches without entries are absent; only in the text of a whole row their zeros are written, never as rows.
    n, width = packed.n_cols, packed.col_chunk
    stretches = packed.df.select("row_id", F.struct("col_block", joined(F.col("values")).alias("text")).alias("_s"))
    grouped = stretches.groupBy("row_id").agg(F.array_sort(F.collect_list("_s")).alias("p"))

    def with_gap(x, i):
        before = F.when(i == 0, F.lit(-1)).otherwise(F.col("p")[F.greatest(i - 1, F.lit(0))]["col_block"])
        return F.array(F.when(i == 0, F.lit("")).otherwise(F.lit(",")), F.repeat(F.lit("0,"), (x["col_block"] - before - 1) * width), x["text"])

    after = F.lit(n) - (F.element_at("p", -1)["col_block"] + 1).cast("bigint") * width
    return grouped.select("row_id", F.concat_ws("", F.flatten(F.transform("p", with_gap)), F.repeat(F.lit(",0"), F.greatest(after, F.lit(0)).cast("int"))).alias("row_values"))


@query("SELECT CAST(v.vec_id AS BIGINT) AS row_id, CAST(i - 1 AS BIGINT) AS col_id, CAST(v.embedding[i] AS DOUBLE) AS value FROM embeddings v, unnest(range(1, len(embedding) + 1)) AS r(i) WHERE CAST(v.embedding[i] AS DOUBLE) > 0.125")
def dense_to_sparse(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return Matrix.of_vectors(vectors, "vec_id", "embedding", vectors.count(), 64, zero=F.col("value") <= 0.125).entries()


@query(WITH + "SELECT row_id, col_id, value FROM e")
def layout_round_trip(spark, sf_dir):
    return _matrix(spark, sf_dir).to("csr").to("csc").to("dense", col_chunk=16).to("csr").entries()


@query(WITH + "SELECT col_id AS row_id, row_id AS col_id, value FROM e")
def transpose(spark, sf_dir):
    return _matrix(spark, sf_dir).to("csc").transposed().entries()


@query(WITH + "SELECT row_id, col_id, CAST(value AS FLOAT) AS value FROM e")
def cast_values(spark, sf_dir):
    return _matrix(spark, sf_dir).to("csr").cast("float").entries()


# -- counts, offsets, positions

_N = "n AS (SELECT o.row_id, CAST(COUNT(e.col_id) AS BIGINT) AS nnz FROM o LEFT JOIN e ON o.row_id = e.row_id GROUP BY o.row_id) "


@query(WITH.strip() + ", " + _N + "SELECT row_id, nnz FROM n")
def row_nnz(spark, sf_dir):
    return _matrix(spark, sf_dir).row_nnz()


@query(WITH.strip() + ", " + _N + "SELECT row_id, nnz, CAST(SUM(nnz) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nnz AS BIGINT) AS indptr FROM n")
def indptr(spark, sf_dir):
    return _matrix(spark, sf_dir).indptr()


@query(WITH + "SELECT s.col_id, CAST(COUNT(e.row_id) AS BIGINT) AS nnz FROM s LEFT JOIN e ON s.col_id = e.col_id GROUP BY s.col_id")
def col_nnz(spark, sf_dir):
    return _matrix(spark, sf_dir).col_nnz()


@query(WITH + "SELECT CAST(FLOOR(col_id * 16.0 / (SELECT COUNT(*) FROM s)) AS BIGINT) AS cell, CAST(COUNT(*) AS BIGINT) AS nnz FROM e GROUP BY 1")
def grid_hist(spark, sf_dir):
    return _matrix(spark, sf_dir).grid_histogram(16)


@query(WITH + "SELECT row_id, col_id, value, CAST(row_number() OVER (ORDER BY row_id, col_id) - 1 AS BIGINT) AS position FROM e")
def nnz_ordinal(spark, sf_dir):
    return _matrix(spark, sf_dir).numbered()


@query(WITH + "SELECT row_id, col_id, value, position FROM (SELECT row_id, col_id, value, CAST(row_number() OVER (ORDER BY row_id, col_id) - 1 AS BIGINT) AS position FROM e) x WHERE position >= 1000 AND position < 3000")
def flat_range(spark, sf_dir):
    return _matrix(spark, sf_dir).flat(1000, 3000)


@query(WITH.strip() + ", " + _N.strip() + ", x AS (SELECT row_id, nnz, SUM(nnz) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nnz AS pos FROM n) SELECT row_id, nnz, CAST(FLOOR(pos / 5000.0) AS BIGINT) AS band FROM x")
def weighted_bands(spark, sf_dir):
    return layout.weighted_bands(_matrix(spark, sf_dir).row_nnz(), "row_id", "nnz", 5000)


_BAND = "b AS (SELECT CAST(FLOOR(row_id / 1000.0) AS BIGINT) AS band, CAST(FLOOR(col_id / 25.0) AS BIGINT) AS out, CAST(COUNT(*) AS BIGINT) AS n FROM e GROUP BY 1, 2) "


@query(WITH.strip() + ", " + _BAND + "SELECT out, band, n, CAST(SUM(n) OVER (PARTITION BY out ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS start FROM b")
def scatter_offsets(spark, sf_dir):
    counts = _matrix(spark, sf_dir).entries().groupBy(F.floor(F.col("row_id") / 1000).cast("bigint").alias("band"), F.floor(F.col("col_id") / 25).cast("bigint").alias("out")).agg(F.count("*").alias("n"))
    return offsets(counts, "out", "band", "n")


@query(WITH + "SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM o) AS n_obs, (SELECT CAST(COUNT(*) AS BIGINT) FROM s) AS n_vars, CAST(COUNT(*) AS BIGINT) AS nnz, MAX(row_id) AS max_row, MAX(col_id) AS max_col, SUM(value) AS total FROM e")
def verify(spark, sf_dir):
    m = _matrix(spark, sf_dir).to("csr")
    found = m.verify()
    total = m.entries().agg(F.sum("value")).first()[0]
    return spark.createDataFrame([(m.n_rows, m.n_cols, found["nnz"], found["r1"], found["c1"], total)], "n_obs bigint, n_vars bigint, nnz bigint, max_row bigint, max_col bigint, total double")


# -- selections


@query(WITH + "SELECT row_id, col_id, value FROM e WHERE row_id >= 200 AND row_id < 900")
def row_range(spark, sf_dir):
    return _matrix(spark, sf_dir).to("csr").rows(200, 900).entries()


@query(WITH + "SELECT row_id, col_id, value FROM e WHERE col_id >= 3 AND col_id < 9")
def col_range(spark, sf_dir):
    return _matrix(spark, sf_dir).to("dense", col_chunk=8).cols(3, 9).entries()


@query(WITH + "SELECT o.row_id, s.col_id, COALESCE(e.value, 0.0) AS value FROM o CROSS JOIN s LEFT JOIN e ON e.row_id = o.row_id AND e.col_id = s.col_id WHERE o.row_id >= 100 AND o.row_id < 164 AND s.col_id >= 2 AND s.col_id < 10")
def dense_block(spark, sf_dir):
    return _matrix(spark, sf_dir).to("csr").block(100, 164, 2, 10)


_PARTS = "pt AS (SELECT p_partkey, p_size, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS col_id FROM part)"


def _part_matrix(spark, sf_dir) -> tuple[Matrix, DataFrame]:
    rows, cols = _rows(spark, sf_dir), with_ordinal(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], "col_id")
    facts = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return Matrix.of_facts(facts, rows.select("o_orderkey", "row_id"), cols.select("p_partkey", "col_id"), F.col("l_quantity"), rows.count(), cols.count(), on_row=F.expr("l_orderkey = o_orderkey"), on_col=F.expr("l_partkey = p_partkey")), cols


@query(f"WITH {M}, k AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS col_id FROM part WHERE p_size <= 10) SELECT o.row_id, k.col_id, SUM(l.l_quantity) AS value FROM lineitem l JOIN k ON l.l_partkey = k.p_partkey JOIN o ON l.l_orderkey = o.o_orderkey GROUP BY o.row_id, k.col_id")
def feature_mask(spark, sf_dir):
    m, cols = _part_matrix(spark, sf_dir)
    return m.keep_cols(cols.where("p_size <= 10")).entries()


@query(f"WITH {M}, {_PARTS}, c AS (SELECT o.row_id, CAST(COUNT(DISTINCT pt.col_id) AS BIGINT) AS n FROM lineitem l JOIN pt ON l.l_partkey = pt.p_partkey JOIN o ON l.l_orderkey = o.o_orderkey WHERE pt.p_size <= 10 GROUP BY o.row_id) SELECT o.row_id, COALESCE(c.n, 0) AS nnz FROM o LEFT JOIN c ON o.row_id = c.row_id")
def kept_feature_count(spark, sf_dir):
    m, cols = _part_matrix(spark, sf_dir)
    return m.keep_cols(cols.where("p_size <= 10")).row_nnz()


# -- sorting


def _sorted(spark, sf_dir) -> DataFrame:
    return sort_permutation(_rows(spark, sf_dir), ["o_orderpriority", "o_orderstatus"])


@query(WITH_PERM + "SELECT row_id, new_row_id FROM p")
def sort_perm(spark, sf_dir):
    return _sorted(spark, sf_dir).select("row_id", "new_row_id")


@query(WITH_PERM + "SELECT o_orderpriority, o_orderstatus, MIN(new_row_id) AS start_row, MAX(new_row_id) + 1 AS end_row, CAST(COUNT(*) AS BIGINT) AS n FROM p GROUP BY o_orderpriority, o_orderstatus")
def sort_ranges(spark, sf_dir):
    return group_ranges(_sorted(spark, sf_dir), ["o_orderpriority", "o_orderstatus"])


@query(WITH_PERM + "SELECT p.new_row_id AS row_id, e.col_id, e.value FROM e JOIN p ON e.row_id = p.row_id")
def sort_entries(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    perm = sort_permutation(rows, ["o_orderpriority", "o_orderstatus"])
    return _matrix(spark, sf_dir, rows).permuted(perm).entries()


@query(WITH_PERM.strip() + ", x AS (SELECT new_row_id, o_orderpriority, LAG(o_orderpriority) OVER (ORDER BY new_row_id) AS prev FROM p) SELECT new_row_id AS run_start, o_orderpriority FROM x WHERE prev IS NULL OR prev <> o_orderpriority")
def sort_runs(spark, sf_dir):
    return runs(_sorted(spark, sf_dir).select("new_row_id", "o_orderpriority"), "new_row_id", "o_orderpriority")


_GRAPH = "g AS (SELECT a.col_id AS src, b.col_id AS dst, CAST(COUNT(*) AS BIGINT) AS w FROM e a JOIN e b ON a.row_id = b.row_id AND a.col_id <> b.col_id GROUP BY a.col_id, b.col_id), sp AS (SELECT col_id, CAST(row_number() OVER (ORDER BY s_nationkey, col_id) - 1 AS BIGINT) AS new_id FROM s) "


@query(WITH.strip() + ", " + _GRAPH + "SELECT x.new_id AS src, y.new_id AS dst, g.w FROM g JOIN sp x ON g.src = x.col_id JOIN sp y ON g.dst = y.col_id")
def obsp_remap(spark, sf_dir):
    cols = _cols(spark, sf_dir)
    e = _matrix(spark, sf_dir, cols=cols).entries()
    # Suppliers of one order: an order has at most a few, so pairs stay in proportion to the entries.
    pairs = e.select("row_id", F.col("col_id").alias("src")).join(e.select("row_id", F.col("col_id").alias("dst")), "row_id").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    n = cols.count()
    graph = Matrix.of_entries(pairs.select(F.col("src").alias("row_id"), F.col("dst").alias("col_id"), F.col("w").alias("value")), n, n)
    perm = sort_permutation(cols.select(F.col("col_id").alias("row_id"), "s_nationkey"), ["s_nationkey"])
    return graph.permuted(perm, cols=True).entries().select(F.col("row_id").alias("src"), F.col("col_id").alias("dst"), F.col("value").alias("w"))


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY label, vec_id) - 1 AS BIGINT) AS new_row_id, CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings")
def obsm_permute(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").withColumn("row_id", F.col("vec_id"))
    return sort_permutation(vectors, ["label"]).select("vec_id", "new_row_id", F.col("embedding")[0].cast("double").alias("first_value"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders")
def factorize(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return frames.recode(rows, "o_orderpriority", frames.dictionary(rows, "o_orderpriority")).select("o_orderkey", "code")


# -- concat and append

_STACKED = """f AS (SELECT row_id AS rid, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r FROM o WHERE o_orderstatus = 'F'),
t AS (SELECT row_id AS rid, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r FROM o WHERE o_orderstatus = 'O'),
n AS (SELECT CAST(COUNT(*) AS BIGINT) AS c FROM f) SELECT f.r AS row_id, e.col_id, e.value FROM e JOIN f ON e.row_id = f.rid UNION ALL SELECT t.r + n.c AS row_id, e.col_id, e.value FROM e JOIN t ON e.row_id = t.rid CROSS JOIN n"""


@query(WITH.strip() + ", " + _STACKED)
def concat(spark, sf_dir):
    a, b = (_annotated(spark, sf_dir, f"o_orderstatus = '{x}'") for x in "FO")
    return a.X.to("csr").stacked(b.X.to("csr")).entries()


@query(WITH.strip() + ", " + _STACKED)
def concat_store(spark, sf_dir):
    parts = [_annotated(spark, sf_dir, f"o_orderstatus = '{x}'") for x in "FO"]
    cfg = AppConfig(concat=ConcatConfig(obs_columns=("priority", "key")))
    path = _place(spark, "concat")
    _quietly(ops.convert, spark, parts, output=path, cfg=cfg)
    return Store.open(spark, path).matrix().entries()


@query("WITH store AS (SELECT DISTINCT user_id AS name FROM events WHERE event_type = 'click'), inc AS (SELECT event_id, user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view') SELECT CAST(COUNT(*) AS BIGINT) AS n_new, CAST(COALESCE(SUM(CASE WHEN rn > 1 OR name IN (SELECT name FROM store) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dup FROM inc")
def dup_names(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    incoming = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("name"))
    marked = frames.duplicate_names(incoming, "name", "event_id", events.where("event_type = 'click'").select("user_id"))
    return marked.agg(F.count("*").alias("n_new"), F.coalesce(F.sum(F.col("duplicate").cast("bigint")), F.lit(0)).cast("bigint").alias("n_dup"))


_DICT = "d AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_brand AS label FROM part WHERE p_brand < 'Brand#3') x)"


def _brands(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return part, frames.dictionary(part.where("p_brand < 'Brand#3'"), "p_brand")


@query("WITH d AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_brand < 'Brand#3'), i AS (SELECT p_brand AS label, MIN(p_partkey) AS first_seen FROM part GROUP BY p_brand) SELECT i.label, CAST((SELECT COUNT(*) FROM d) + row_number() OVER (ORDER BY i.first_seen) - 1 AS BIGINT) AS code FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.label = i.label)")
def new_labels(spark, sf_dir):
    part, codes = _brands(spark, sf_dir)
    return frames.new_labels(part, "p_brand", "p_partkey", codes)


@query(f"WITH {_DICT} SELECT p.p_partkey, COALESCE(d.code, -1) AS code FROM part p LEFT JOIN d ON p.p_brand = d.label")
def recode(spark, sf_dir):
    part, codes = _brands(spark, sf_dir)
    return frames.recode(part, "p_brand", codes).select("p_partkey", "code")


@query(f"WITH {_DICT} SELECT p.p_partkey, d.label FROM part p LEFT JOIN d ON p.p_brand = d.label")
def code_to_label(spark, sf_dir):
    part, codes = _brands(spark, sf_dir)
    coded = frames.recode(part, "p_brand", codes).select("p_partkey", "code")
    return frames.labels_of(coded, "code", codes, "label").select("p_partkey", "label")


@query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_name AS label FROM part) x")
def distinct_labels(spark, sf_dir):
    return frames.dictionary(_table(spark, sf_dir, "part"), "p_name")


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n, COUNT(DISTINCT p_brand) < COUNT(*) AS brand_is_categorical, COUNT(DISTINCT p_name) < COUNT(*) AS name_is_categorical FROM part")
def cat_rule(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    df = part.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").cast("string").alias("name"), "p_brand", "p_name")
    n = part.count()
    f = frames.normalise(df, "row_id", n)
    return spark.createDataFrame([(n, f.column("p_brand").encoding == "categorical", f.column("p_name").encoding == "categorical")], "n bigint, brand_is_categorical boolean, name_is_categorical boolean")


def _people(spark, sf_dir) -> tuple[Frame, Frame]:
    c = with_ordinal(_table(spark, sf_dir, "customer"), ["c_custkey"], "row_id").select("row_id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = with_ordinal(_table(spark, sf_dir, "supplier"), ["s_suppkey"], "row_id").select("row_id", F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return frames.normalise(c, "row_id", c.count()), frames.normalise(s, "row_id", s.count())


@query("SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def fill_missing(spark, sf_dir):
    store, cells = _people(spark, sf_dir)
    return frames.extend(store, cells, frames.plan_columns(store, cells)).df.select("name", "acctbal", "segment")


@query("SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def promote_nullable(spark, sf_dir):
    store, cells = _people(spark, sf_dir)
    plan = frames.plan_columns(store, cells)
    assert "nation" in plan.promoted
    return frames.extend(store, cells, plan).df.select("name", F.col("nation").cast("string").alias("nation"))


@query("SELECT CAST(COUNT(*) = SUM(CASE WHEN a.n_name IS NOT DISTINCT FROM b.n_name THEN 1 ELSE 0 END) AS BOOLEAN) AS same, FALSE AS shifted FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey")
def var_equality(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("col_id"), F.col("n_name").alias("name"))
    shifted = n.withColumn("col_id", F.col("col_id") + 1)
    return spark.createDataFrame([(frames.same_names(n, n, "col_id"), frames.same_names(n, shifted, "col_id"))], "same boolean, shifted boolean")


@query("SELECT * FROM (VALUES ('counts', 'append'), ('scaled', 'drop'), ('other', 'leave out')) AS t(layer, decision)")
def layer_set_ops(spark, sf_dir):
    return spark.createDataFrame(ops.layer_decisions(["scaled", "counts"], ["counts", "other"]), "layer string, decision string")


_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


@query(
    "WITH t(name, kind, bits) AS (VALUES ('tinyint', 'i', 8), ('smallint', 'i', 16), ('int', 'i', 32), ('bigint', 'i', 64), ('float', 'f', 24), ('double', 'f', 53)) "
    "SELECT a.name AS source, b.name AS target, (a.name = b.name OR (a.kind = b.kind AND a.bits <= b.bits) OR (a.kind = 'i' AND b.kind = 'f' AND a.bits <= b.bits)) AS lossless FROM t a CROSS JOIN t b"
)
def lossless_cast(spark, sf_dir):
    return spark.createDataFrame([(a, b, lossless(a, b)) for a in _TYPES for b in _TYPES], "source string, target string, lossless boolean")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'tinyint'), (128, 'tinyint'), (129, 'smallint'), (32768, 'smallint'), (32769, 'int')) AS t(n, width)")
def code_widths(spark, sf_dir):
    return spark.createDataFrame([(n, code_width(n)) for n in (1, 128, 129, 32768, 32769)], "n bigint, width string")


@query(WITH + "SELECT CAST(FLOOR(e.col_id / 16.0) AS BIGINT) AS band, o.o_orderpriority AS \"group\", CAST(COUNT(*) AS BIGINT) AS nnz FROM e JOIN o ON e.row_id = o.row_id GROUP BY 1, 2")
def band_group_counts(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _matrix(spark, sf_dir, rows).band_group_nnz(rows.select("row_id", F.col("o_orderpriority").alias("group")), 16)


# -- stores


def _store(spark, sf_dir, name: str, cfg: AppConfig | None = None, where: str | None = None) -> str:
    path = _place(spark, name)
    _quietly(ops.convert, spark, _annotated(spark, sf_dir, where), output=path, cfg=cfg)
    return path


@query(WITH + "SELECT row_id, col_id, value FROM e")
def convert_store(spark, sf_dir):
    return Store.open(spark, _store(spark, sf_dir, "convert", AppConfig(io=IOConfig(layout="csc")))).matrix().entries()


@query(WITH_PERM + "SELECT p.new_row_id AS row_id, e.col_id, e.value FROM e JOIN p ON e.row_id = p.row_id")
def convert_sorted(spark, sf_dir):
    cfg = AppConfig(grouping=GroupingConfig(enabled=True, sort_by=("priority", "status")))
    return Store.open(spark, _store(spark, sf_dir, "convert", cfg)).matrix().entries()


@query(WITH_PERM + "SELECT p.new_row_id AS row_id, CAST(o.o_orderkey AS VARCHAR) AS name, o.o_orderpriority AS priority, o.o_orderstatus AS status FROM p JOIN o ON p.row_id = o.row_id")
def sort_store(spark, sf_dir):
    path, out = _store(spark, sf_dir, "convert"), _place(spark, "sort")
    ops.sort(spark, path, output=out, by=["priority", "status"])
    return Store.open(spark, out).frame("obs").df.select("row_id", "name", "priority", "status")


@query(WITH + "SELECT CAST(FLOOR(row_id / 2000.0) AS BIGINT) AS chunk_id, MIN(row_id) AS r0, MAX(row_id) AS r1, CAST(COUNT(*) AS BIGINT) AS nnz FROM e GROUP BY 1")
def rechunk(spark, sf_dir):
    path, out = _store(spark, sf_dir, "convert"), _place(spark, "rechunk")
    ops.rechunk(spark, path, output=out, cfg=AppConfig(chunks=ChunkConfig(row_chunk=2000)))
    store = Store.open(spark, out)
    chunk = F.floor(F.col("row_id") / store.config_of("X").row_chunk).cast("bigint")
    return store.matrix().entries().groupBy(chunk.alias("chunk_id")).agg(F.min("row_id").alias("r0"), F.max("row_id").alias("r1"), F.count("*").alias("nnz"))


@query(WITH.strip() + ", " + _STACKED)
def append_rows(spark, sf_dir):
    path, cells = _store(spark, sf_dir, "store", where="o_orderstatus = 'F'"), _store(spark, sf_dir, "cells", where="o_orderstatus = 'O'")
    _quietly(ops.append, spark, path, cells=cells)
    return Store.open(spark, path).matrix().entries()


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n_new, CAST(0 AS BIGINT) AS n_duplicate_names, CAST(COUNT(DISTINCT o_orderpriority) AS BIGINT) AS priorities FROM orders WHERE o_orderstatus = 'O'")
def append_plan(spark, sf_dir):
    path, cells = _store(spark, sf_dir, "store", where="o_orderstatus = 'F'"), _store(spark, sf_dir, "cells", where="o_orderstatus = 'O'")
    plan = ops.plan_append(spark, path, cells=cells)
    return spark.createDataFrame([(plan.n_new, plan.n_duplicate_names, len(next(c for c in plan.columns.columns if c.name == "priority").categories))], "n_new bigint, n_duplicate_names bigint, priorities bigint")


@query(WITH + "SELECT row_id, col_id, value FROM e")
def add_layer(spark, sf_dir):
    path = _store(spark, sf_dir, "layers")
    ops.add_layer(spark, path, layer="by_supplier", layout="csc")
    return Store.open(spark, path).matrix("layers/by_supplier").entries()


@query(WITH + "SELECT row_id, col_id, value FROM e")
def add_layer_roundtrip(spark, sf_dir):
    path = _store(spark, sf_dir, "layers")
    ops.add_layer(spark, path, layer="copy", layout="dense", cfg=AppConfig(chunks=ChunkConfig(row_chunk=512, col_chunk=64)))
    return Store.open(spark, path).matrix("layers/copy").entries()


def _layers_appended(spark, sf_dir, layout: str) -> DataFrame:
    """The entries of a layer of that layout, after an append to it."""
    path, cells = _store(spark, sf_dir, "store", where="o_orderstatus = 'F'"), _store(spark, sf_dir, "cells", where="o_orderstatus = 'O'")
    for p in (path, cells):
        ops.add_layer(spark, p, layer="copy", layout=layout)
    _quietly(ops.append, spark, path, cells=cells)
    return Store.open(spark, path).matrix("layers/copy").entries()


@query(WITH.strip() + ", " + _STACKED)
def append_dense_layer(spark, sf_dir):
    return _layers_appended(spark, sf_dir, "dense")


@query(WITH.strip() + ", " + _STACKED)
def append_csc_layer(spark, sf_dir):
    return _layers_appended(spark, sf_dir, "csc")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS BIGINT) AS row_id, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS priority, o_orderstatus AS status, o_orderkey AS key FROM orders WHERE o_orderstatus IN ('F', 'O')")
def append_obs(spark, sf_dir):
    path, cells = _store(spark, sf_dir, "store", where="o_orderstatus = 'F'"), _store(spark, sf_dir, "cells", where="o_orderstatus = 'O'")
    _quietly(ops.append, spark, path, cells=cells)
    return Store.open(spark, path).frame("obs").df.select("row_id", "name", "priority", "status", "key")


@query(WITH + "SELECT row_id, col_id, value FROM e")
def zarr_round_trip(spark, sf_dir):
    from ..sources import zarr  # sources import plans

    path = _place(spark, "zarr").removeprefix("file://")
    zarr.export_matrix(_matrix(spark, sf_dir), path, 1 << 16)
    return zarr.read_matrix(spark, path).entries()


@query(WITH + "SELECT row_id, col_id, value FROM e")
def tables_source(spark, sf_dir):
    from ..sources.registry import open_source  # sources import plans

    path, a = _place(spark, "tables"), _annotated(spark, sf_dir)
    for name, df in (("entries", a.X.entries()), ("obs", a.obs.df), ("var", a.var.df)):
        df.write.parquet(f"{path}/{name}.parquet")
    return open_source(spark, path).X.entries()


@query(
    WITH.strip()
    + """, f AS (SELECT row_id AS rid, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r FROM o WHERE o_orderstatus = 'F'),
t AS (SELECT DISTINCT e.row_id AS rid, CAST(o.o_orderkey AS VARCHAR) AS name FROM e JOIN o ON e.row_id = o.row_id WHERE o.o_orderstatus = 'O'),
u AS (SELECT rid, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS r FROM t),
n AS (SELECT CAST(COUNT(*) AS BIGINT) AS c FROM f) SELECT f.r AS row_id, e.col_id, e.value FROM e JOIN f ON e.row_id = f.rid UNION ALL SELECT u.r + n.c AS row_id, e.col_id, e.value FROM e JOIN u ON e.row_id = u.rid CROSS JOIN n"""
)
def stream_append(spark, sf_dir):
    from ..streaming.ingest import appender  # streaming imports plans

    path, source = _store(spark, sf_dir, "store", where="o_orderstatus = 'F'"), _place(spark, "stream")
    lines, orders, suppliers = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    facts = lines.join(orders.where("o_orderstatus = 'O'"), F.expr("l_orderkey = o_orderkey")).join(suppliers, F.expr("l_suppkey = s_suppkey")).select("o_orderkey", "s_name", "l_quantity")
    facts.write.parquet(source)
    stream = spark.readStream.schema(facts.schema).parquet(source).writeStream.foreachBatch(lambda df, i: _quietly(appender(path, "o_orderkey", "s_name", "l_quantity"), df, i))
    stream.option("checkpointLocation", _place(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return Store.open(spark, path).matrix().entries()


# -- versions


def _repo(spark, sf_dir) -> Repo:
    """A repository: failed orders on main, then open ones appended on the branch dev."""
    repo = Repo.create(spark, _place(spark, "repo"))
    _quietly(ops.convert, spark, _annotated(spark, sf_dir, "o_orderstatus = 'F'"), output=repo)
    repo.checkout("dev", create=True)
    _quietly(ops.append, spark, repo, cells=_store(spark, sf_dir, "cells", where="o_orderstatus = 'O'"))
    return repo


_F_ONLY = "f AS (SELECT row_id AS rid, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS r FROM o WHERE o_orderstatus = 'F') SELECT f.r AS row_id, e.col_id, e.value FROM e JOIN f ON e.row_id = f.rid"


@query(WITH.strip() + ", " + _F_ONLY)
def time_travel(spark, sf_dir):
    repo = _repo(spark, sf_dir)
    return repo.store(repo.log()[1].id).matrix().entries()


@query(WITH.strip() + ", " + _F_ONLY)
def branch_isolation(spark, sf_dir):
    return _repo(spark, sf_dir).checkout("main").store().matrix().entries()


@query(WITH.strip() + ", " + _F_ONLY)
def cherrypick(spark, sf_dir):
    repo = _repo(spark, sf_dir)
    repo.cherrypick(repo.log("main")[0].id)
    return repo.store().matrix().entries()


@query(WITH.strip() + ", " + _STACKED)
def deferred_commit(spark, sf_dir):
    repo = Repo.create(spark, _place(spark, "repo"))
    _quietly(ops.convert, spark, _annotated(spark, sf_dir, "o_orderstatus = 'F'"), output=repo)
    _quietly(ops.append, spark, repo, cells=_store(spark, sf_dir, "cells", where="o_orderstatus = 'O'"), commit=False)
    repo.commit("both")
    return repo.store().matrix().entries()


@query("SELECT * FROM (VALUES (0, 'append'), (1, 'convert'), (2, 'Repository initialized')) AS t(age, message)")
def repo_log(spark, sf_dir):
    return _repo(spark, sf_dir).log_df().select("age", "message")


@query(WITH.strip() + ", " + _STACKED)
def repo_copy(spark, sf_dir):
    return _repo(spark, sf_dir).copy(_place(spark, "copy")).store().matrix().entries()


@query(WITH.strip() + ", " + _F_ONLY)
def repo_discard(spark, sf_dir):
    repo = Repo.create(spark, _place(spark, "repo"))
    _quietly(ops.convert, spark, _annotated(spark, sf_dir, "o_orderstatus = 'F'"), output=repo)
    _quietly(ops.append, spark, repo, cells=_store(spark, sf_dir, "cells", where="o_orderstatus = 'O'"), commit=False)
    repo.discard()
    return repo.store().matrix().entries()


@query(WITH + "SELECT row_id, col_id, value FROM e")
def origin_split(spark, sf_dir):
    origin = Repo.init(spark, _place(spark, "repo"), _store(spark, sf_dir, "convert"))
    repo = Repo(spark, origin.copy(_place(spark, "mirror")).path, origin=origin.path)
    ops.add_layer(spark, repo, layer="copy", layout="csr")
    return origin.store().matrix("layers/copy").entries()


@query(WITH + "SELECT CAST(row_id AS BIGINT) AS row_id, CAST(o_orderkey AS VARCHAR) AS name FROM o")
def repo_init(spark, sf_dir):
    return Repo.init(spark, _place(spark, "repo"), _store(spark, sf_dir, "convert")).store().frame("obs").df.select("row_id", "name")

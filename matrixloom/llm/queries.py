"""The registered queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embdedup, neardup, pii, quality, secrets, sharding, suffix, toxicity
from .shared import FEWER, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near-duplicates at a similarity of 0.75."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard out of 40, near equal in bytes, and its slot there."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that come twice."""
    done = suffix.deduplicate(_table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and their decoding."""
    done = bpe.encode(_table(spark, sf_dir, "documents"), keep=("doc_id",), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in passages of the benchmark."""
    return decontam.digest(decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


#: The rating of a labelled document: 0 junk, 1 good but toxic, 2 good.
GRADE = "quality * (2 - coalesce(toxic, 0))"


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and the chance that it isn't junk."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"), grade=F.expr(GRADE))
    tail = F.element_at("tail", 1)
    return quality.score(docs, model).select("doc_id", "expected_grade", tail.alias("p_good"), F.try_element_at("tail", F.lit(2)).alias("p_best"), (tail >= quality.KEEP).alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned without the fifth of the rows that is held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda key: F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), train=lambda key: ~held_out(key))
    scored = toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
    return materialize(scored, "toxicity", FEWER)


def _joined(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def _digests(found: DataFrame, kinds: tuple[str, ...], is_base: str) -> DataFrame:
    """doc_id, and of the spans that are base ones (by an expression on x) a count for each kind and the digest; all spans as a string."""
    base = F.expr(f"filter(spans, x -> {is_base})")
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}' and {is_base}))").cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return _digests(pii.spans(_table(spark, sf_dir, "documents")), pii.BASE, "x.base")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return _digests(secrets.spans(_table(spark, sf_dir, "documents")), ("assign", "access", "hex"), "x.kind in ('assign', 'access', 'hex')")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's links and component at a cosine of 0.95."""
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_sharding, op3_suffix_dedup, op4_bpe, op5_decontaminate, op6_quality, op7_pii, op8_toxicity, op9_secrets, op10_embedding_dedup)}

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS r(i)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""

_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN d ON v.vec_id = d.a
"""

ORACLES = {"op1_minhash_dedup": _OP1, "op10_embedding_dedup": _OP10, "op5_decontaminate": _OP5}

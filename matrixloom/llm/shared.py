"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_path

#: Cells of the pre-filter for joins of documents with a few ids: its broadcast has at most CELLS / 64 rows.
CELLS = 1 << 23
#: Rows that go to Python at a time while a table is written.
ROWS = 2000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that are decoded at a time: arrays of 4096 texts don't fit the heap's regions, so that it grows to its limit.
READ_ROWS = 256
READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Texts are long: smaller batches keep tasks' buffers small.
FEW = {BATCH: ROWS}
FEWER = {BATCH: ROWS, READ: READ_ROWS}


@contextlib.contextmanager
def capped(spark: SparkSession, most: dict[str, int]) -> Iterator[None]:
    """Lowers these settings of the session to at most the given numbers, until the end of the block."""
    before = {name: spark.conf.get(name) for name in most}
    try:
        for name, n in most.items():
            spark.conf.set(name, str(min(int(before[name]), n)))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str, most: dict[str, int] | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it from there, so that lost executors cost no recomputation.

    most: the settings that are lowered meanwhile, by default FEW.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with capped(spark, FEW if most is None else most):
        df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written inside tidied(), by path.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def tidied(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns, one table that it has written last; the other tables that it wrote are deleted."""
    outer, own = _written.get(), []
    token = _written.set(own)
    try:
        result = build()
    finally:
        _written.reset(token)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in own[:-1]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    if outer is not None:
        outer += own[-1:]
    return result


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a column that tells its rows apart and is the same in every read: struct<file, row>.

    Where docs is a Parquet table, or columns and rows chosen from one: the hash of the file's path and the row's place in the file, which
    don't depend on how files are split. Else rows are numbered and written once.
    """
    if _is_file_scan(docs):
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")))
    return materialize(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "numbered")


def _is_file_scan(docs: DataFrame) -> bool:
    """Whether the plan only chooses columns and rows of one Parquet table, each of whose files is read once."""
    if "_metadata" in docs.columns:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString().lower() != "parquet":
        return False
    paths = relation.location().rootPaths()
    return len({paths.apply(i).toString() for i in range(paths.size())}) == paths.size()


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, which it else does when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", others: bool = False) -> DataFrame:
    """The rows of docs whose key may be in ids (one column): all that are, and a few others. With others=True, all rows but these.

    A bitmap of CELLS bits, as rows of 64, is broadcast; its size doesn't depend on ids.
    It spares most rows a shuffle when ids are few; an equi-join must follow.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS))
    bit = lambda x: F.expr(f"shiftleft(1L, cast({x} % 64 as int))")
    bits = (
        ids.select(cell(F.col(ids.columns[0])).alias("_c"))
        .select(F.floor(F.col("_c") / 64).alias("_w"), bit("_c").alias("_b"))
        .groupBy("_w")
        .agg(F.bit_or("_b").alias("_bits"))
    )
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit("_c")) != 0, F.lit(False))
    marked = docs.withColumn("_c", cell(F.col(key))).withColumn("_w", F.floor(F.col("_c") / 64)).join(F.broadcast(bits), "_w", "left" if others else "inner")
    return marked.where(~hit if others else hit).drop("_c", "_w", "_bits")

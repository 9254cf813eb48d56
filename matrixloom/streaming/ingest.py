"""Streams into a store: each micro-batch of entries is packed and appended, with the manifest as its commit."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AppConfig, IOConfig
from ..errors import ValidationError
from ..operators.frames import normalise
from ..operators.matrix import Matrix
from ..operators.ordinals import with_ordinal
from ..plans import ops
from ..plans.repo import Repo
from ..plans.store import Store
from ..sources.annotated import Annotated

LAST = "stream/last_batch"


def appender(store: str | Repo, row: str, column: str, value: str, *, drop_derived: bool = False, unknown: str = "refuse") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: rows of a batch (row name, column name, value) are appended to a store whose var names the columns.

    Values at one coordinate of a batch add up. A batch that is delivered again is recognised by its number, kept in uns. Appending to a
    store with obsm, obsp or layers would drop these: a ValidationError unless drop_derived is set. unknown says what happens to
    columns that var doesn't have: "refuse" (a ValidationError) or "skip" (with a warning that counts their entries).
    """
    if unknown not in ("refuse", "skip"):
        raise ValidationError(f"unknown is 'refuse' or 'skip', not {unknown!r}")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = store.store() if isinstance(store, Repo) else Store.open(spark, store)
        if target.uns.get(LAST, -1) >= number:
            return
        var = target.frame("var")
        facts = batch.groupBy(F.col(row).cast("string").alias("name"), F.col(column).cast("string").alias("_c")).agg(F.sum(value).alias("value"))
        names = with_ordinal(facts.select("name").distinct(), ["name"], "row_id")
        n = names.count()
        if not n:
            return
        known = var.df.select("col_id", F.col("name").alias("_c"))
        if strangers := facts.join(known, "_c", "left_anti").count():
            text = f"batch {number} has {strangers} entries in columns that the store doesn't have"
            if unknown == "refuse":
                raise ValidationError(text)
            warnings.warn(text, stacklevel=2)
        entries = facts.join(names, "name").join(known, "_c").select("row_id", "col_id", F.col("value").cast(target.matrix().dtype).alias("value"))
        cells = Annotated(normalise(names.select("row_id", "name"), "row_id", n), var, Matrix.of_entries(entries, n, var.n))
        place = f"{target.files.root}/stream/{number}"
        try:
            ops.convert(spark, cells, output=place, cfg=AppConfig(io=IOConfig(overwrite=True)))  # a batch that failed may have left one
            ops.append(spark, store, cells=place, drop_derived=drop_derived, uns={LAST: number})
        finally:
            target.files.delete(f"stream/{number}")

    return run

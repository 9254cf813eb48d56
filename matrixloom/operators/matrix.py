"""A matrix as a DataFrame: the relation entries(row_id, col_id, value) and its packings.

csr: (row_id, part, indices, data) and csc: (col_id, part, indices, data) hold the entries of a row (column) whose minor positions lie in
one stretch of PART, in order; so a column that every one of a billion rows has stays in bounded arrays. dense:
(row_id, col_block, values) holds the stretches of a row that aren't all zero. Empty rows have no packed row; shapes are kept
beside the data. Explicit zeros of a sparse source stay; only dense values are tested against zero (NaN stays, -0.0 goes).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConversionError, ValidationError
from .ordinals import with_ordinal, with_prefix_sum

#: Minor positions of one packed array.
PART = 1 << 20
MAJOR = {"csr": "row_id", "csc": "col_id"}
MINOR = {"csr": "col_id", "csc": "row_id"}


@dataclass(frozen=True)
class Matrix:
    """A packed matrix, its shape, its value type, and for dense ones the columns of a stretch."""

    df: DataFrame
    layout: str
    n_rows: int
    n_cols: int
    dtype: str
    col_chunk: int = 2048

    # -- building

    @staticmethod
    def of_entries(entries: DataFrame, n_rows: int, n_cols: int) -> Matrix:
        """entries(row_id, col_id, value), coordinates unique."""
        return Matrix(entries.select("row_id", "col_id", "value"), "entries", n_rows, n_cols, dict(entries.dtypes)["value"])

    @staticmethod
    def of_facts(facts: DataFrame, rows: DataFrame, cols: DataFrame, value: Column, n_rows: int, n_cols: int, *, on_row: Column, on_col: Column, whole_rows: bool = False) -> Matrix:
        """Facts joined with the spines (row_id, col_id) on their keys; facts at one coordinate add up.

        whole_rows: all of a row in one task, so that packings by rows and stretches need no shuffle of their own.
        """
        found = facts.join(rows, on_row).join(cols, on_col).select("row_id", "col_id", value.alias("value"))
        found = (found.repartition("row_id") if whole_rows else found).groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
        return Matrix.of_entries(found, n_rows, n_cols)

    @staticmethod
    def of_vectors(vectors: DataFrame, row: str, vector: str, n_rows: int, n_cols: int, zero: Column | None = None) -> Matrix:
        """Dense rows as arrays. zero: which values count as zero; by default those that equal it."""
        at = vectors.select(F.col(row).cast("bigint").alias("row_id"), F.posexplode(vector).alias("col_id", "value"))
        keep = F.col("value") != 0 if zero is None else ~zero
        return Matrix.of_entries(at.where(keep).select("row_id", F.col("col_id").cast("bigint").alias("col_id"), "value"), n_rows, n_cols)

    # -- packings

    def entries(self) -> DataFrame:
        """The relation (row_id, col_id, value)."""
        if self.layout == "entries":
            return self.df
        if self.layout == "dense":
            stretch = self.df.select("row_id", "col_block", F.posexplode("values").alias("_i", "value")).where(F.col("value") != 0)
            return stretch.select("row_id", (F.col("col_block").cast("bigint") * self.col_chunk + F.col("_i")).alias("col_id"), "value")
        major, minor = MAJOR[self.layout], MINOR[self.layout]
        flat = self.df.select(major, F.inline(F.arrays_zip("indices", "data")))
        return flat.select(F.col(major), F.col("indices").cast("bigint").alias(minor), F.col("data").alias("value")).select("row_id", "col_id", "value")

    def to(self, layout: str, *, col_chunk: int | None = None) -> Matrix:
        """The same matrix in another layout: one shuffle by the major axis; none between equal layouts."""
        if layout == self.layout and (layout != "dense" or col_chunk in (None, self.col_chunk)):
            return self
        if layout == "entries":
            return replace(self, df=self.entries(), layout="entries")
        if layout == "dense":
            return self._dense(col_chunk or self.col_chunk)
        if layout not in MAJOR:
            raise ValidationError(f"unknown layout {layout!r}")
        major, minor = MAJOR[layout], MINOR[layout]
        grouped = self.entries().groupBy(major, F.floor(F.col(minor) / PART).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct(minor, "value"))).alias("_e"))
        packed = grouped.select(major, "part", F.col(f"_e.{minor}").cast("array<bigint>" if self._wide(minor) else "array<int>").alias("indices"), F.col("_e.value").alias("data"))
        return replace(self, df=packed, layout=layout)

    def _wide(self, axis: str) -> bool:
        return (self.n_cols if axis == "col_id" else self.n_rows) > (1 << 31) - 1

    def dense_in_order(self, width: int) -> Matrix:
        """to("dense") with rows ranged over the partitions and in order in each. Entries or packed rows are moved; zeros come last."""
        ranged = self if self.layout == "csr" else replace(self, df=self.entries(), layout="entries")
        return replace(ranged, df=ranged.df.repartitionByRange("row_id"))._dense(width, in_order=True)

    def _dense(self, width: int, in_order: bool = False) -> Matrix:
        """Stretches of `width` columns: zeros between the sorted values, in time linear in the width. in_order: sorted in each partition."""
        block = F.floor(F.col("col_id") / width).cast("int")
        grouped = self.entries().groupBy("row_id", block.alias("col_block")).agg(F.array_sort(F.collect_list(F.struct((F.col("col_id") % width).cast("int").alias("o"), F.col("value").alias("v")))).alias("_e"))
        grouped = grouped.sortWithinPartitions("row_id", "col_block") if in_order else grouped
        zeros = lambda n: F.array_repeat(F.lit(0).cast(self.dtype), n.cast("int"))
        size = F.least(F.lit(width), F.lit(self.n_cols) - F.col("col_block") * width)

        def with_gap(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1)).otherwise(F.col("_e")[F.greatest(i - 1, F.lit(0))]["o"])
            return F.concat(zeros(x["o"] - before - 1), F.array(x["v"]))

        tail = zeros(size - F.element_at("_e", -1)["o"] - 1)
        values = F.concat(F.flatten(F.transform("_e", with_gap)), tail)
        return replace(self, df=grouped.select("row_id", "col_block", values.alias("values")), layout="dense", col_chunk=width)

    def transposed(self) -> Matrix:
        """Axes swapped without moving data: a csc matrix is the csr matrix of its transpose."""
        names = {"row_id": "col_id", "col_id": "row_id"}
        layout = {"csr": "csc", "csc": "csr"}.get(self.layout)
        if layout is None:
            flipped = self.entries().select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")
            return Matrix(flipped, "entries", self.n_cols, self.n_rows, self.dtype)
        return Matrix(self.df.withColumnsRenamed(names), layout, self.n_cols, self.n_rows, self.dtype)

    # -- counting

    def row_nnz(self) -> DataFrame:
        """(row_id, nnz) for every row, empty ones too."""
        return self._nnz("row_id", self.n_rows)

    def col_nnz(self) -> DataFrame:
        """(col_id, nnz) for every column."""
        return self._nnz("col_id", self.n_cols)

    def _nnz(self, axis: str, n: int) -> DataFrame:
        packed = self.layout in MAJOR and MAJOR[self.layout] == axis
        counts = self.df.groupBy(axis).agg(F.sum(F.size("indices")).cast("bigint").alias("nnz")) if packed else self.entries().groupBy(axis).agg(F.count("*").alias("nnz"))
        spine = self.df.sparkSession.range(n).withColumnRenamed("id", axis)
        return spine.join(counts, axis, "left").select(axis, F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))

    def indptr(self) -> DataFrame:
        """(row_id, nnz, indptr): indptr is the number of entries in all rows before."""
        return with_prefix_sum(self.row_nnz(), ["row_id"], "nnz", "indptr")

    def nnz(self) -> int:
        source = self.df.agg(F.sum(F.size("indices"))) if self.layout in MAJOR else self.entries().agg(F.count("*"))
        return int(source.first()[0] or 0)

    def grid_histogram(self, cells: int, axis: str = "col_id") -> DataFrame:
        """(cell, nnz): entries by cell of an even grid over an axis; cells without entries are left out."""
        n = self.n_cols if axis == "col_id" else self.n_rows
        return self.entries().groupBy(F.floor(F.col(axis) * cells / n).cast("bigint").alias("cell")).agg(F.count("*").alias("nnz"))

    def band_group_nnz(self, groups: DataFrame, band: int) -> DataFrame:
        """(band, group, nnz): entries by band of that many columns and group of rows; groups is (row_id, group). One shuffle of sums a task."""
        counts = self.entries().select("row_id", F.floor(F.col("col_id") / band).cast("bigint").alias("band")).groupBy("row_id", "band").agg(F.count("*").alias("n"))
        return counts.join(groups.select("row_id", "group"), "row_id").groupBy("band", "group").agg(F.sum("n").cast("bigint").alias("nnz"))

    def numbered(self) -> DataFrame:
        """entries with position: the place of each entry in row order, as flat arrays have it."""
        return self._numbered()

    def _numbered(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """numbered(), of all entries or of those packed rows that reach into positions [start, end)."""
        packed = self.to("csr")
        starts = with_prefix_sum(packed.df.select("row_id", "part", F.size("indices").alias("_n")), ["row_id", "part"], "_n", "_start")
        if start is not None:
            starts = starts.where((F.col("_start") < end) & (F.col("_start") + F.col("_n") > start))
        flat = packed.df.join(starts.select("row_id", "part", "_start"), ["row_id", "part"]).select("row_id", "_start", F.posexplode(F.arrays_zip("indices", "data")).alias("_i", "_x"))
        return flat.select("row_id", F.col("_x.indices").cast("bigint").alias("col_id"), F.col("_x.data").alias("value"), (F.col("_start") + F.col("_i")).alias("position"))

    # -- selections

    def rows(self, start: int, end: int) -> Matrix:
        """The rows [start, end), at their own numbers: a filter that reaches the scan."""
        if self.layout == "csc":
            return replace(self, df=self.entries().where(F.col("row_id").between(start, end - 1)), layout="entries")
        return replace(self, df=self.df.where(F.col("row_id").between(start, end - 1)))

    def cols(self, start: int, end: int) -> Matrix:
        """The columns [start, end)."""
        if self.layout == "csc":
            return replace(self, df=self.df.where(F.col("col_id").between(start, end - 1)))
        pruned = self.df.where(F.col("col_block").between(start // self.col_chunk, (end - 1) // self.col_chunk)) if self.layout == "dense" else self.df
        return replace(self, df=replace(self, df=pruned).entries().where(F.col("col_id").between(start, end - 1)), layout="entries")

    def flat(self, start: int, end: int) -> DataFrame:
        """The entries at positions [start, end) of the flat arrays; only packed rows that reach into them are unpacked."""
        return self._numbered(start, end).where(F.col("position").between(start, end - 1))

    def block(self, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
        """(row_id, col_id, value) for every cell of a rectangle; ranges come before the grid."""
        spark = self.df.sparkSession
        grid = spark.range(r0, r1).withColumnRenamed("id", "row_id").select("row_id", F.explode(F.sequence(F.lit(c0).cast("bigint"), F.lit(c1 - 1).cast("bigint"))).alias("col_id"))
        found = self.rows(r0, r1).cols(c0, c1).entries()
        return grid.join(found, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("value", F.lit(0).cast(self.dtype)).alias("value"))

    def keep_cols(self, kept: DataFrame) -> Matrix:
        """Only the columns in kept (col_id), numbered anew without gaps in their order."""
        numbered = with_ordinal(kept.select("col_id"), ["col_id"], "_new")
        n = kept.count()
        found = self.entries().join(numbered, "col_id").select("row_id", F.col("_new").alias("col_id"), "value")
        return Matrix(found, "entries", self.n_rows, n, self.dtype)

    # -- permutations, casts, unions

    def permuted(self, perm: DataFrame, *, cols: bool = False) -> Matrix:
        """Rows moved to their new_row_id of perm(row_id, new_row_id); with cols, columns by the same numbers too (graphs)."""
        moved = self.entries().join(perm.select("row_id", "new_row_id"), "row_id").select(F.col("new_row_id").alias("row_id"), "col_id", "value")
        if cols:
            other = perm.select(F.col("row_id").alias("col_id"), F.col("new_row_id").alias("_c"))
            moved = moved.join(other, "col_id").select("row_id", F.col("_c").alias("col_id"), "value")
        return replace(self, df=moved, layout="entries")

    def cast(self, dtype: str) -> Matrix:
        if self.layout == "entries":
            return replace(self, df=self.df.withColumn("value", F.col("value").cast(dtype)), dtype=dtype)
        name = "values" if self.layout == "dense" else "data"
        return replace(self, df=self.df.withColumn(name, F.col(name).cast(f"array<{dtype}>")), dtype=dtype)

    def stacked(self, *others: Matrix) -> Matrix:
        """Rows of the others below these; columns and types must be the same. Only numbers shift, nothing is shuffled."""
        parts, at = [], 0
        layout = self.layout if self.layout in ("csr", "dense") and all((m.layout, m.col_chunk) == (self.layout, self.col_chunk) for m in others) else "entries"
        for m in (self, *others):
            if m.n_cols != self.n_cols:
                raise ConversionError(f"matrices have {self.n_cols} and {m.n_cols} columns")
            if m.dtype != self.dtype:
                raise ConversionError(f"matrices hold {self.dtype} and {m.dtype}")
            parts.append(m.to(layout).df.withColumn("row_id", F.col("row_id") + F.lit(at).cast("bigint")))
            at += m.n_rows
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part)
        return replace(self, df=df, layout=layout, n_rows=at)

    # -- checks

    def verify(self) -> dict[str, int]:
        """Counts and ranges, or a ConversionError: packed arrays of equal length, coordinates in range and unique."""
        if self.layout in MAJOR:
            odd = self.df.where(F.size("indices") != F.size("data")).limit(1).count()
            if odd:
                raise ConversionError("indices and data differ in length")
        found = self.entries().agg(F.count("*").alias("nnz"), F.min("row_id").alias("r0"), F.max("row_id").alias("r1"), F.min("col_id").alias("c0"), F.max("col_id").alias("c1")).first()
        if found["nnz"] and (found["r0"] < 0 or found["c0"] < 0 or found["r1"] >= self.n_rows or found["c1"] >= self.n_cols):
            raise ConversionError(f"coordinates leave the shape {self.n_rows} x {self.n_cols}")
        return found.asDict()


def require_unique(entries: DataFrame) -> None:
    """A ConversionError if a coordinate comes twice."""
    if entries.groupBy("row_id", "col_id").count().where("count > 1").limit(1).count():
        raise ConversionError("a coordinate comes more than once")


def runs(ordered: DataFrame, order: str, value: str) -> DataFrame:
    """(run_start, value) where value changes along order, a gapless number.

    Each row is joined with its predecessor by number, so there is no window over all rows.
    """
    before = ordered.select((F.col(order) + 1).alias(order), F.col(value).alias("_before"), F.lit(True).alias("_has"))
    joined = ordered.join(before, order, "left").where(F.col("_has").isNull() | ~F.col(value).eqNullSafe(F.col("_before")))
    return joined.select(F.col(order).alias("run_start"), value)


def group_ranges(perm: DataFrame, keys: list[str], order: str = "new_row_id") -> DataFrame:
    """Start, end and size of each group of equal keys in a sorted order."""
    return perm.groupBy(*keys).agg(F.min(order).alias("start_row"), (F.max(order) + 1).alias("end_row"), F.count("*").alias("n"))


def offsets(counts: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """counts with start: the exclusive running sum of n along order within each group of by."""
    return counts.withColumn("start", F.coalesce(F.sum(n).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def sort_permutation(rows: DataFrame, keys: list[Column | str], row: str = "row_id", name: str = "new_row_id") -> DataFrame:
    """rows with their place in a stable sort by keys: ties keep their order."""
    return with_ordinal(rows, [*keys, row], name)

"""Annotation frames: dictionaries, normalisation, matching of names and columns, and the rules for appending."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.scalar import code_width, family
from .ordinals import with_ordinal

#: Labels that a dictionary in the manifest may hold; a column with more stays a string column.
MAX_LABELS = 1_000_000


@dataclass(frozen=True)
class Column:
    """How a column is held. encoding: array, nullable-array, boolean, nullable-boolean, string, nullable-string, categorical."""

    name: str
    encoding: str
    type: str
    categories: tuple[str, ...] = ()
    ordered: bool = False

    @property
    def codes(self) -> str | None:
        return code_width(len(self.categories)) if self.encoding == "categorical" else None


@dataclass(frozen=True)
class Frame:
    """Rows (id, name, columns...), and how each column is held."""

    df: DataFrame
    id: str
    n: int
    columns: tuple[Column, ...] = field(default=())

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValidationError(f"there is no column {name!r}; columns are {', '.join(c.name for c in self.columns) or 'none'}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def normalise(df: DataFrame, id: str, n: int, *, known: dict[str, Column] | None = None) -> Frame:
    """A frame whose columns are classified by one aggregation: text that repeats (a missing value does, too) becomes categorical, with its labels sorted."""
    known = known or {}
    names = [c for c in df.columns if c not in (id, "name")]
    kinds = dict(df.dtypes)
    text = [c for c in names if kinds[c] == "string" and c not in known]
    stats = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n{i}") for i, c in enumerate(names)), *(F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(names) if c in text)).first()
    columns = []
    for i, c in enumerate(names):
        missing = stats[f"n{i}"] < stats["n"]
        if c in known:
            columns.append(known[c])
        elif c in text:
            if stats[f"d{i}"] < stats["n"] and stats[f"d{i}"] <= MAX_LABELS:
                labels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())  # at most MAX_LABELS
                columns.append(Column(c, "categorical", "string", tuple(labels)))
            else:
                columns.append(Column(c, "nullable-string" if missing else "string", "string"))
        else:
            plain = "boolean" if kinds[c] == "boolean" else "array"
            columns.append(Column(c, f"nullable-{plain}" if missing and kinds[c] not in ("float", "double") else plain, kinds[c]))
    return Frame(df, id, n, tuple(columns))


def dictionary(labels: DataFrame, column: str) -> DataFrame:
    """(label, code): the distinct labels, numbered in their order."""
    return with_ordinal(labels.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct(), ["label"], "code")


def recode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with code: the label's code, -1 where it is missing or unknown."""
    return df.join(codes.select(F.col("label").alias(column), "code"), column, "left").withColumn("code", F.coalesce("code", F.lit(-1).cast("bigint")))


def labels_of(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    """df with name: the label of a code, null for -1."""
    return df.join(codes.select(F.col("code").alias(code), F.col("label").alias(name)), code, "left")


def new_labels(incoming: DataFrame, column: str, order: str, codes: DataFrame) -> DataFrame:
    """(label, code): labels unknown to the dictionary in order of first appearance, numbered after it."""
    first = incoming.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.min(order).alias("first_seen"))
    unseen = first.join(codes, "label", "left_anti")
    known = codes.count()
    return with_ordinal(unseen, ["first_seen", "label"], "_i").select("label", (F.col("_i") + F.lit(known)).alias("code"))


def duplicate_names(incoming: DataFrame, name: str, order: str, store: DataFrame) -> DataFrame:
    """incoming with duplicate: whether its name is in the store (one column) or came earlier."""
    known = store.select(F.col(store.columns[0]).alias(name)).distinct().withColumn("_known", F.lit(True))
    earlier = F.row_number().over(Window.partitionBy(name).orderBy(order)) > 1
    return incoming.withColumn("_again", earlier).join(known, name, "left").withColumn("duplicate", F.col("_again") | F.col("_known").isNotNull()).drop("_again", "_known")


def same_names(a: DataFrame, b: DataFrame, id: str) -> bool:
    """Whether two frames (id, name) have the same names at the same places."""
    left, right = a.select(id, F.col("name").alias("_a")), b.select(id, F.col("name").alias("_b"))
    return not left.join(right, id, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).count()


def label_table(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """(label, place): labels of a manifest with their places from 1, as a table to join; Spark broadcasts it if it is small."""
    return spark.createDataFrame(pa.table({"label": pa.array(list(labels), pa.string()), "place": pa.array(range(1, len(labels) + 1), pa.int32())}))


def with_sort_keys(frame: Frame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame's rows with columns to sort by: a category's place, the value of others; missing ones first. NaN is refused by the caller."""
    df, keys = frame.df, []
    for i, name in enumerate(by):
        c, key = frame.column(name), f"_key{i}"
        if c.encoding == "categorical" and c.categories:
            places = label_table(df.sparkSession, c.categories).toDF(f"_label{i}", f"_place{i}")
            df = df.join(places, F.col(name) == F.col(f"_label{i}"), "left").withColumn(key, F.coalesce(f"_place{i}", F.lit(0))).drop(f"_label{i}", f"_place{i}")
        else:
            df = df.withColumn(key, F.col(name))
        keys.append(key)
    return df, keys


@dataclass(frozen=True)
class ColumnPlan:
    """What appending does with the columns: notes, columns only the cells have, filled ones, promoted ones, and the result's columns."""

    notes: tuple[str, ...]
    extra: tuple[str, ...]
    filled: tuple[str, ...]
    promoted: tuple[str, ...]
    columns: tuple[Column, ...]


def plan_columns(store: Frame, cells: Frame, *, include_new: bool = False) -> ColumnPlan:
    """Matches the columns by name; the store's schema wins. Raises ValidationError for what can't be appended."""
    notes, filled, promoted, out = [], [], [], []
    theirs = {c.name: c for c in cells.columns}
    for c in store.columns:
        other = theirs.pop(c.name, None)
        if other is None:
            filled.append(c.name)
            if c.encoding == "string":
                raise ValidationError(f"column {c.name!r} identifies rows, and the cells don't have it")
            if c.encoding in ("boolean", "array") and c.type not in ("float", "double"):
                promoted.append(c.name)
                c = replace(c, encoding=f"nullable-{c.encoding}")
            out.append(c)
            continue
        if family(c.encoding) != family(other.encoding) or c.type != other.type:
            raise ValidationError(f"column {c.name!r} is {c.encoding} of {c.type} in the store and {other.encoding} of {other.type} in the cells")
        missing = other.encoding.startswith("nullable-") and bool(cells.df.where(F.col(c.name).isNull()).limit(1).count())
        if c.encoding == "categorical":
            labels = set(other.categories) if other.encoding == "categorical" else None
            if c.ordered or other.ordered:
                if (c.ordered, c.categories) != (other.ordered, other.categories):
                    raise ValidationError(f"ordered categories of {c.name!r} differ")
            else:
                known = set(c.categories)
                seen = cells.df.where(F.col(c.name).isNotNull()).groupBy(F.col(c.name).alias("label")).agg(F.min(cells.id).alias("_f"))
                unseen = seen.join(label_table(cells.df.sparkSession, c.categories), "label", "left_anti")
                fresh = [r[0] for r in unseen.orderBy("_f").limit(MAX_LABELS + 1).collect()] if labels is None or labels - known else []
                if len(fresh) + len(known) > MAX_LABELS:
                    raise ValidationError(f"column {c.name!r} would have more than {MAX_LABELS} categories")
                if fresh:
                    wider = replace(c, categories=(*c.categories, *fresh))
                    notes.append(f"{c.name}: new categories {', '.join(fresh[:5])}{' and more' if len(fresh) > 5 else ''}")
                    if wider.codes != c.codes:
                        notes.append(f"{c.name}: codes widen from {c.codes} to {wider.codes}")
                    c = wider
        elif c.encoding == "string" and cells.df.where(F.col(c.name).isNull()).limit(1).count():
            raise ValidationError(f"column {c.name!r} can't hold missing values")
        elif missing and c.encoding in ("boolean", "array"):
            promoted.append(c.name)
            c = replace(c, encoding=f"nullable-{c.encoding}")
        out.append(c)
    extra = tuple(theirs)
    if extra:
        notes.append(f"columns only the cells have, {'added last' if include_new else 'left out'}: {', '.join(extra)}")
        if include_new:
            for c in theirs.values():
                out.append(replace(c, encoding=f"nullable-{c.encoding}") if c.encoding in ("array", "boolean", "string") and c.type not in ("float", "double") else c)
    if filled:
        notes.append(f"columns the cells lack, missing there: {', '.join(filled)}")
    if promoted:
        notes.append(f"columns that become nullable: {', '.join(promoted)}")
    return ColumnPlan(tuple(notes), extra, tuple(filled), tuple(promoted), tuple(out))


def extend(store: Frame, cells: Frame, plan: ColumnPlan) -> Frame:
    """The store's rows and the cells' after them, with the plan's columns; what a side lacks is missing there."""
    return Frame(_fitted(store, store.id, 0, plan).unionByName(added_rows(store, cells, plan)), store.id, store.n + cells.n, plan.columns)


def added_rows(store: Frame, cells: Frame, plan: ColumnPlan) -> DataFrame:
    """The cells' rows as they go below the store's."""
    return _fitted(cells, store.id, store.n, plan)


def _fitted(frame: Frame, id: str, shift: int, plan: ColumnPlan) -> DataFrame:
    kinds = dict(frame.df.dtypes)
    columns = [F.col(c.name) if c.name in kinds else (F.lit(float("nan")) if c.type in ("float", "double") else F.lit(None)).cast(c.type).alias(c.name) for c in plan.columns]
    return frame.df.select((F.col(frame.id) + F.lit(shift).cast("bigint")).alias(id), "name", *columns)

"""Embedding near-dedup: an exact metric range join of unit vectors.

cos(u, v) >= t for unit vectors means |u - v| <= r = sqrt(2 - 2 t), a metric range join. Pivots, chosen far from each other in a
bounded sample, partition the vectors: each lies in the cell of its nearest pivot, and cells with more than CELL vectors are
dealt into several. A vector v of a cell around p may have links in a cell around q only if, by the triangle inequality,
|v - q| - r is at most that cell's radius, and only if v lies within r of the plane between p and q, that is
(|v - q|^2 - |v - p|^2) / (2 |p - q|) <= r; it is copied to those cells that come later in the order, so each pair of cells
meets once. Cells then join on their own, in blocks of BLOCK vectors, in double precision.

Exact copies are one class with one representative before anything else, so that a group of copies of any size is one
vector. A cell returns sums and a spanning set of its links, not all pairs: n_links is counted over all links, and the
component comes from the spanning links.

Where vectors have no cluster structure (the distances hardly vary), no bound prunes, and copying nears one copy for each
later cell: an exact join then is quadratic by nature. Work and memory of a task stay bounded all the same.

Defined cases: null vectors, vectors that are all zero or hold a null or non-finite component, and vectors of another
length than the compared one link with nothing (only equal lengths are compared); -0.0 equals 0.0; rows with a null id
are returned with no links; rows that repeat an id and vector are counted as links of each other's class but give
one row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import materialize

THRESHOLD = 0.95
CELL = 4000
BLOCK = 1024
MAX_PIVOTS = 256
SAMPLE = 4000
#: Slack on bounds for rounding; the join itself is exact.
SLACK = 1e-6


def _unit(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(values.flatten()).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x: each the one farthest from those before."""
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        near = np.minimum(near, 2 - 2 * x @ x[chosen[-1]])
        if near.max() <= 1e-12:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def _deal(pivots: np.ndarray, radius: float, parts: list[int], reach: np.ndarray):
    """A function that copies vectors to their own cell and to later cells that may hold links."""
    first = np.concatenate(([0], np.cumsum(parts)))  # of each pivot's cells
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vec"), pivots.shape[1])
            near = np.maximum(2 - 2 * x @ pivots.T, 0)
            home = near.argmin(axis=1)
            ids = np.asarray(batch.column("rep")).astype(np.int64)
            sub = (((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)) % np.asarray(parts)[home]
            cell = first[home] + sub
            own = near[np.arange(len(x)), home]
            may = (near - own[:, None]) / (2 * apart[home]) <= radius + SLACK
            may &= np.sqrt(near) <= reach + radius + SLACK
            may[np.arange(len(x)), home] = True
            for q in range(len(parts)):
                for c in range(first[q], first[q + 1]):
                    at = np.flatnonzero(may[:, q] & (cell <= c))
                    if len(at):
                        rows = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(cell[at] != c), *rows.columns], ["cell", "guest", "rep", "n", "vec"])

    return deal


def _join(dims: int, threshold: float):
    """A function over partitions sorted by cell and guest, that joins each cell's own vectors with one another and with its guests."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own_ids, own_n, own_x = None, [], [], []
        held: tuple | None = None  # the cell's own vectors, once its first guest comes

        def met(ids, n, x, ids2, n2, x2, same):
            """Counts and spanning links between two sets."""
            out = []
            for i in range(0, len(ids), BLOCK):
                for k in range(i if same else 0, len(ids2), BLOCK):
                    linked = x[i : i + BLOCK] @ x2[k : k + BLOCK].T >= threshold
                    inner = same and i == k
                    if inner:
                        np.fill_diagonal(linked, False)
                    if not linked.any():
                        continue
                    a, b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                    p, q = ids[i : i + BLOCK], ids2[k : k + BLOCK]
                    # Each row links to its first partner, each column to its first: that spans what the block connects
                    # once each row's partners hang together, which the columns' links to their first row see to.
                    out.append((p[a], (linked[a] @ n2[k : k + BLOCK]).astype(np.int64), q[linked[a].argmax(axis=1)]))
                    if not inner:
                        out.append((q[b], (linked[:, b].T @ n[i : i + BLOCK]).astype(np.int64), p[linked[:, b].argmax(axis=0)]))
                    rows, cols = _spanning(linked)
                    out.append((p[rows], np.zeros(len(rows), np.int64), q[cols]))
            for x_, y_, z_ in out:
                yield pa.RecordBatch.from_arrays([pa.array(x_), pa.array(y_), pa.array(z_)], ["rep", "n_links", "other"])

        def own():
            return np.concatenate(own_ids), np.concatenate(own_n), np.concatenate(own_x)

        for batch in batches:
            cells, guests = np.asarray(batch.column("cell")), np.asarray(batch.column("guest"))
            x, ids, n = (_unit(batch.column("vec"), dims) if batch.num_rows else None), np.asarray(batch.column("rep")).astype(np.int64), np.asarray(batch.column("n")).astype(np.float64)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(guests.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if s == e:
                    continue
                if cells[s] != cell:
                    if own_ids and held is None:
                        mine = own()
                        yield from met(*mine, *mine, True)
                    cell, own_ids, own_n, own_x, held = cells[s], [], [], [], None
                if not guests[s]:
                    own_ids.append(ids[s:e]), own_n.append(n[s:e]), own_x.append(x[s:e])
                elif own_ids:
                    if held is None:
                        held = own()
                        yield from met(*held, *held, True)
                    yield from met(*held, ids[s:e], n[s:e], x[s:e], False)
        if own_ids and held is None:
            mine = own()
            yield from met(*mine, *mine, True)

    return join


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that the matrix connects: for each row, those to columns whose first row is another one, once for each first row."""
    rows, cols = np.nonzero(linked)
    first = linked.argmax(axis=0)[cols]
    _, at = np.unique(rows.astype(np.int64) * linked.shape[0] + first, return_index=True)
    keep = at[first[at] != rows[at]]
    return rows[keep], cols[keep]


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """For each row: key, n_links (other vectors with a cosine of threshold or more), component_id and kept."""
    spark = vectors.sparkSession
    good = F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(key), F.when(F.col(key).isNotNull() & F.coalesce(good, F.lit(False)), plain).alias("vec"))
    classes = materialize(rows.where("vec is not null").groupBy("vec").agg(F.min(key).cast("long").alias("rep"), F.count("*").alias("n")).select("rep", "n", "vec"), "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found = None
    for dims, count in sorted(tuple(x) for x in classes.groupBy(F.size("vec")).count().collect()):  # a row for each length
        mine = classes.where(F.size("vec") == dims)
        sample = mine.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").toArrow()
        pivots = _pivots(_unit(sample["vec"], dims), int(min(MAX_PIVOTS, max(1, -(-count // cell)))))

        def nearest(batches: Iterable[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = 2 - 2 * _unit(batch.column("vec"), pivots.shape[1]) @ pivots.T
                    home = near.argmin(axis=1)
                    kinds = np.unique(home)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([int((home == q).sum()) for q in kinds]), pa.array([float(np.sqrt(max(near[home == q, q].max(), 0))) for q in kinds])], ["p", "n", "far"])

        sizes = {r.p: (r.n, r.far) for r in mine.select("vec").mapInArrow(nearest, "p long, n long, far double").groupBy("p").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
        parts = [max(1, -(-sizes.get(q, (0, 0))[0] // cell)) for q in range(len(pivots))]
        reach = np.array([sizes.get(q, (0, -10.0))[1] for q in range(len(pivots))])
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("guest", T.BooleanType()), *classes.schema.fields])
        dealt = mine.mapInArrow(_deal(pivots, radius, parts, reach), schema).repartition(min(sum(parts), 2000), "cell").sortWithinPartitions("cell", "guest")
        part = dealt.mapInArrow(_join(dims, threshold), "rep long, n_links long, other long")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    found = materialize(found, "near")
    totals = found.groupBy("rep").agg(F.sum("n_links").alias("_links"))
    groups = components(found, "rep", "other")
    ranked = classes.join(totals, "rep", "left").join(groups, classes["rep"] == groups["id"], "left").select("vec", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_n"), F.coalesce("component_id", "rep").alias("_c"))
    return rows.join(ranked, "vec", "left").select(
        key, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", F.col(key).cast("long")).alias("component_id"), F.coalesce(F.col("_c") == F.col(key), F.col(key).isNotNull()).alias("kept")
    )

"""Sharding by a k-d tree over metadata: nodes are split at distributed weighted medians along their widest dimension until
every leaf has the target bytes.

The law is `bytes`: shards are as near in size as whole rows allow. A node that has to give k shards is cut where its bytes stand as
floor(k/2) to the rest. A cut is found without sorting: each row has a key of several 12-bit digits (its cell along the
dimension, then bits of a hash of its text, of its id and of its number); sums by digit, pre-aggregated in every task, locate the bin
that holds the median, and the next digit refines that bin alone. So a source, text or value that holds a third of all
rows is cut inside, also one of equal rows; copies of a text stay together but for such cuts, and the driver gets at most 4096
sums a node.
All nodes of a level are handled by the same few aggregations over the metadata, never over the texts.

Slots number each shard's rows without gaps: rows get numbers, written once, and are ordered within groups of about SLOT_GROUP
rows by a hash of that number, whose offsets are running sums of their counts; no shard is gathered in one task, whatever keys
repeat. Which of a shard's slots a row has follows these numbers, so it may differ from run to run.

DataFrame functions only. Defined cases: a null text has no bytes; null metadata has a cell of its own; rows with a null
id count like others; repeated rows get slots of their own; an empty table gives an empty result; a table with fewer
rows than shards leaves shards empty; a row larger than the target bytes fills its shard alone as far as cuts can do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes that a row has besides its text.
ROW_BYTES = 16
DIGIT = 12
CELLS = 1 << DIGIT
#: Digits of a row's key for a dimension: its cell, and four of hashes.
DIGITS = 5
#: Bits of a row's number in its key, and of the hashes of its text and its id.
ROW_BITS, HASH_BITS = 8, 20
assert ROW_BITS + 2 * HASH_BITS == DIGIT * (DIGITS - 1)
SLOT_GROUP = 5000
#: A bin of at most this share of a shard isn't refined.
CLOSE = 1e-4


@dataclass
class Node:
    """A part of the tree: shards first .. first + shards - 1; once cut, a dimension, the digits of the cut, and two children."""

    first: int
    shards: int
    dim: int = 0
    cut: tuple[int, ...] = ()
    low: Node | None = None
    high: Node | None = None

    def leaves(self) -> list[Node]:
        return self.low.leaves() + self.high.leaves() if self.low else [self]


def _value(digits: tuple[int, ...]) -> int:
    out = 0
    for digit in digits:
        out = (out << DIGIT) + digit
    return out


def _of(values: list[int], at: Column) -> Column:
    """values[at], from an array literal: expressions stay as short as the tree, however often they are used."""
    return F.get(F.lit(values), at.cast("int"))


def _walk(rows: DataFrame, root: Node) -> DataFrame:
    """rows with _node: the first shard of the leaf that a row falls in, found by a step down the tree's tables for each level.

    A row comes before a cut if its key along the cut's dimension is below the cut's digits, filled up with zeros.
    Each step is a projection of its own, and no filter is put on _node: either would multiply the steps' expressions.
    """
    nodes, depth = [root], 0
    for x in nodes:
        nodes += [x.low, x.high] if x.low else []
    level = [root]
    while any(x.low for x in level):
        level, depth = [y for x in level if x.low for y in (x.low, x.high)], depth + 1
    if not depth:
        return rows.withColumn("_node", F.lit(root.first))
    place = {id(x): i for i, x in enumerate(nodes)}
    cuts = [_value(x.cut) << DIGIT * (DIGITS - len(x.cut)) if x.low else 0 for x in nodes]
    low, high = ([place[id(y)] if y else i for i, y in enumerate(z)] for z in ([x.low for x in nodes], [x.high for x in nodes]))
    rows = rows.withColumn("_node", F.lit(0))
    at = F.col("_node")
    for _ in range(depth):
        rows = rows.withColumn("_node", F.when(F.get("_keys", _of([x.dim for x in nodes], at)) < _of(cuts, at), _of(low, at)).otherwise(_of(high, at)))
    return rows.withColumn("_node", _of([x.first for x in nodes], at))


def _cut(rows: DataFrame, root: Node, dims: int, target: float) -> bool:
    """Cuts every leaf that still has several shards; False if there is none."""
    nodes = [x for x in root.leaves() if x.shards > 1]
    if not nodes:
        return False
    rows = _walk(rows, root)
    cell = lambda key: F.shiftright(key, DIGIT * (DIGITS - 1))
    spread = [(F.max(cell(F.col("_keys")[d])) - F.min(cell(F.col("_keys")[d]))).alias(f"w{d}") for d in range(dims)]
    about = {r["_node"]: r for r in rows.groupBy("_node").agg(F.sum("_size").alias("size"), *spread).collect()}  # a row a node
    left: dict[int, float] = {}  # bytes still to come before the cut
    for node in nodes:
        r = about.get(node.first)
        widths = [r[f"w{d}"] for d in range(dims)] if r else [0]
        node.dim = widths.index(max(widths))
        left[node.first] = (r["size"] if r else 0) * (node.shards // 2) / node.shards
    open_nodes = {x.first: x for x in nodes if x.first in about}
    dims_of = [0] * root.shards
    for node in nodes:
        dims_of[node.first] = node.dim
    keyed = rows.select("_node", "_size", F.get("_keys", _of(dims_of, F.col("_node"))).alias("_key_at"))
    for k in range(DIGITS):
        if not open_nodes:
            break
        inside = [_value(open_nodes[i].cut) if i in open_nodes else -1 for i in range(root.shards)]  # the bin that is refined: its first k digits
        upper = lambda n: F.shiftright("_key_at", DIGIT * (DIGITS - n))
        digit_of = F.when(upper(k) == _of(inside, F.col("_node")), upper(k + 1).bitwiseAND(F.lit(CELLS - 1)).cast("int"))
        sums = keyed.groupBy("_node", digit_of.alias("_d")).agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
        bins: dict[int, list] = {}
        for r in sums.collect():  # at most CELLS rows a node that is open, one for any other
            if r["_d"] is None:
                continue
            bins.setdefault(r["_node"], []).append((r["_d"], r["size"], r["n"]))
        for node in list(open_nodes.values()):
            for digit, size, n in sorted(bins.get(node.first, [])):
                need = left[node.first]
                if size <= need:
                    left[node.first] -= size
                    continue
                if n == 1 or k == DIGITS - 1 or size <= CLOSE * target:  # the whole bin goes to the nearer side
                    node.cut += (digit + (size - need < need),)
                    del open_nodes[node.first]
                else:
                    node.cut += (digit,)
                break
            else:
                node.cut += (CELLS,)
                del open_nodes[node.first]
    for node in nodes:
        node.low = Node(node.first, node.shards // 2)
        node.high = Node(node.first + node.shards // 2, node.shards - node.shards // 2)
    return True


def _cell(value: Column, low, high) -> Column:
    """The cell of a number between low and high; 0 for null."""
    return F.coalesce(F.least(F.floor((value - low) / ((high - low) or 1) * CELLS), F.lit(CELLS - 1)).cast("int"), F.lit(0))


def _placed(numbered: DataFrame, shards: int | None, target_bytes: int | None, numbers: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """_row, _key, _size, _crc and shard of the rows of a written table with _row, _key, _text and the dimensions' columns."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    raw = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    is_number = dict(numbered.dtypes)["_key"] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    measured = [F.log2(F.col("_size").cast("double")), *([F.col("_key").cast("double")] if is_number else []), *(F.col(f"_n{i}") for i in range(len(numbers)))]
    hashed = [F.pmod(F.xxhash64(F.col(c), F.lit(7)), F.lit(CELLS)).cast("int").alias(f"_h{i}") for i, c in enumerate(names)]
    meta = numbered.select("_row", "_key", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("_size"), F.crc32(raw).alias("_crc"), *hashed, *(F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numbers)))
    meta = materialize(meta, "metadata")
    ends = meta.agg(F.sum("_size").alias("bytes"), *(x for i, c in enumerate(measured) for x in (F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")))).first()
    total = ends["bytes"] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    cells = [F.col(f"_h{i}") for i in range(len(names))] + [_cell(c, ends[f"l{i}"], ends[f"h{i}"]) if ends[f"h{i}"] is not None else F.lit(0) for i, c in enumerate(measured)]
    part = lambda c, bits: F.xxhash64(F.col(c), F.lit(1)).bitwiseAND(F.lit((1 << bits) - 1))
    ties = F.shiftleft(part("_crc", HASH_BITS), HASH_BITS + ROW_BITS) + F.shiftleft(part("_key", HASH_BITS), ROW_BITS) + part("_row", ROW_BITS)
    rows = meta.select("_row", "_key", "_size", "_crc", F.array(*(F.shiftleft(c.cast("long"), (DIGITS - 1) * DIGIT) + ties for c in cells)).alias("_keys"))
    rows = materialize(rows, "keys")
    root = Node(0, shards)
    while _cut(rows, root, len(cells), total / shards):
        pass
    # Written, for it is read twice, and a join's filters would multiply the walk's expressions.
    return materialize(_walk(rows, root).select("_row", "_key", "_size", "_crc", F.col("_node").alias("shard")), "placed")


def _dimensions(docs: DataFrame, numbers: tuple[str, ...], names: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Those columns that docs has."""
    return [c for c in numbers if c in docs.columns], [c for c in names if c in docs.columns]


def assign(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", numbers: tuple[str, ...] = (), names: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """For each row: key, size, text_crc32, shard and slot.

    Give the number of shards, or the bytes that a shard should reach. Dimensions are the size (as a logarithm), the key if
    it is a number, the columns `numbers`, and the columns `names` by hash; those that docs doesn't have are left out.
    """
    numbers, names = _dimensions(docs, numbers, names)
    own = [F.col(c).alias(f"_d{i}") for i, c in enumerate((*numbers, *names))]
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), *own)
    inner = [f"_d{i}" for i in range(len(own))]
    placed = _placed(numbered, shards, target_bytes, tuple(inner[: len(numbers)]), tuple(inner[len(numbers) :]))
    shard_rows = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, math.ceil(shard_rows / SLOT_GROUP))
    placed = placed.withColumn("_g", F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(groups)).cast("int"))
    counts = placed.groupBy("shard", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # over a shard's groups, not its rows
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_g").alias("_og"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_g").orderBy("_key", "_crc", "_size", "_row")) - 1)
    return numbered.join(offsets, (numbered["shard"] == offsets["_s"]) & (numbered["_g"] == offsets["_og"])).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_before") + F.col("_r")).cast("long").alias("slot")
    )


def write(docs: DataFrame, path: str, *, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", numbers: tuple[str, ...] = (), names: tuple[str, ...] = ("source", "lang"), tasks: int = 8) -> str:
    """Writes every row of docs to its shard, as a Parquet folder for each; returns the column that names the shard.

    Rows are numbered and written once, and meet their shards by number, so rows without a key and repeated ones go where assign's law
    puts them. A shard's rows are dealt to `tasks` tasks; a shard is never gathered. The column is called shard, with underscores where docs has one.
    """
    numbers, names = _dimensions(docs, numbers, names)
    column = "shard"
    while column.lower() in {c.lower() for c in docs.columns}:
        column = "_" + column
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    numbered = materialize(docs.toDF(*inner).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    placed = _placed(numbered.withColumns({"_key": F.col(at[key]), "_text": F.col(at[text])}), shards, target_bytes, tuple(at[c] for c in numbers), tuple(at[c] for c in names))
    rows = numbered.join(placed.select(F.col("_row").alias("_placed"), F.col("shard").alias("_shard")), F.col("_row") == F.col("_placed"))
    dealt = rows.repartition("_shard", F.pmod(F.xxhash64("_row"), F.lit(tasks)))
    dealt.select(*inner, "_shard").toDF(*docs.columns, column).write.partitionBy(column).parquet(path)
    return column

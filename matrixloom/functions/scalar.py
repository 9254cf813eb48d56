"""Value-level rules: casts, code widths, nullability families, text forms of packed rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significant bits of each numeric type (integers: with sign).
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
MANTISSA_BITS = {"float": 24, "double": 53}
#: Codes that fit each signed width.
CODE_WIDTHS = ((1 << 7, "tinyint"), (1 << 15, "smallint"), (1 << 31, "int"), (1 << 63, "bigint"))
#: How a type name of array libraries is held in a DataFrame; unsigned types widen.
HELD_AS = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "bool": "boolean",
}


def lossless(source: str, target: str) -> bool:
    """Whether every value of a type survives a cast: integers need the target's sign and mantissa bits."""
    if source == target:
        return True
    if source in INTEGER_BITS and target in INTEGER_BITS:
        return INTEGER_BITS[source] <= INTEGER_BITS[target]
    if source in INTEGER_BITS and target in MANTISSA_BITS:
        return INTEGER_BITS[source] <= MANTISSA_BITS[target]
    if source in MANTISSA_BITS and target in MANTISSA_BITS:
        return MANTISSA_BITS[source] <= MANTISSA_BITS[target]
    return source == "boolean" and (target in INTEGER_BITS or target in MANTISSA_BITS)


def code_width(categories: int) -> str:
    """The narrowest signed type for the codes of so many categories, -1 for missing among them."""
    return next(name for most, name in CODE_WIDTHS if categories <= most)


def family(encoding: str) -> str:
    """Encodings of one family append onto each other."""
    if encoding in ("categorical", "string", "nullable-string"):
        return "text"
    return encoding.removeprefix("nullable-")


def joined(values: Column) -> Column:
    """An array of whole numbers as comma-separated text."""
    return F.array_join(F.transform(values, lambda x: x.cast("bigint").cast("string")), ",")

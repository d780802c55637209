"""Size text to bytes and bytes to text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A size is a number, an optional binary unit, an optional b or ib.
UNIT_POWERS = {"k": 1, "m": 2, "g": 3, "t": 4}
SIZE_PATTERN = r"^(.*?)([kmgt]?)(i?b)?$"

# Unit labels by power of 1024, and the text of an empty total.
UNIT_LABELS = ["B ", "KB", "MB", "GB", "TB", "PB", "EB"]
ZERO_TEXT = "  0.00B "


def parse_size(text: str) -> float:
    """``"-10mb"`` to ``-10485760.0``. Units are powers of 1024, with or without ``i``."""
    number, unit, _ = re.match(SIZE_PATTERN, text.lower()).groups()
    return float(number) * 1024 ** UNIT_POWERS.get(unit, 0)


def size_bytes(text: Column) -> Column:
    """Column form of :func:`parse_size`."""
    lowered = F.lower(text)
    number = F.regexp_extract(lowered, SIZE_PATTERN, 1).cast("double")
    unit = F.regexp_extract(lowered, SIZE_PATTERN, 2)
    scale = F.lit(1.0)
    for name, power in UNIT_POWERS.items():
        scale = F.when(unit == name, F.lit(float(1024**power))).otherwise(scale)
    return number * scale


def _hundredths(size: Column, bits: int) -> Column:
    """``size * 100 / 2**bits`` rounded half to even, in whole numbers below 2**63.

    One decimal at a time: ten times a rest below 2**n is five times it below 2**(n - 1).
    """
    if bits == 0:
        return size * 100

    def below(value, n):
        return value.bitwiseAND(F.lit(2**n - 1))

    fives = below(size, bits) * 5
    tenth = F.shiftright(fives, bits - 1)
    fives = below(fives, bits - 1) * 5
    hundredth = F.shiftright(fives, bits - 2)
    rest, half = below(fives, bits - 2), F.lit(2 ** (bits - 3))
    up = (rest > half) | ((rest == half) & (hundredth % 2 == 1))
    return F.shiftright(size, bits) * 100 + tenth * 10 + hundredth + up.cast("long")


def pretty_size(size: Column) -> Column:
    """A byte count in the largest fitting unit, two decimals in a field of six.

    The decimals come from whole-number arithmetic, so no floating-point formatting rule of
    the JVM shows in the text.
    """
    size = size.cast("long")
    text = F.lit(None).cast("string")
    for power, label in enumerate(UNIT_LABELS):
        hundredths = _hundredths(size, 10 * power)
        shown = F.format_string(
            f"%3d.%02d{label}",
            F.floor(hundredths / 100).cast("long"),
            F.pmod(hundredths, F.lit(100)).cast("long"),
        )
        text = F.when(size >= F.lit(1024**power), shown).otherwise(text)
    return F.when(size == 0, F.lit(ZERO_TEXT)).otherwise(text)


def usage_line(size: Column, inodes: Column, path: Column) -> Column:
    """One report line: size, number of entries, path."""
    return F.format_string("%s, %8d files, %s", pretty_size(size), inodes.cast("long"), path)

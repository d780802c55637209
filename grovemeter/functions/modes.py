"""File-type bits of a mode column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# POSIX file-type mask and directory type.
TYPE_MASK = 0o170000
DIRECTORY = 0o040000


def is_directory(mode: Column | str) -> Column:
    mode = F.col(mode) if isinstance(mode, str) else mode
    return mode.bitwiseAND(F.lit(TYPE_MASK)) == F.lit(DIRECTORY)

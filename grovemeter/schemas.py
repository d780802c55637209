"""Declared schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of a snapshot entry.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("basename", T.StringType(), False),
        T.StructField("inode", T.LongType(), True),
        T.StructField("device", T.LongType(), False),
        T.StructField("mode", T.IntegerType(), True),
        T.StructField("uid", T.IntegerType(), True),
        T.StructField("gid", T.IntegerType(), True),
        T.StructField("size", T.LongType(), True),
        T.StructField("mtime", T.DoubleType(), True),
        T.StructField("atime", T.DoubleType(), True),
        T.StructField("scan_time", T.DoubleType(), True),
        T.StructField("root_inode", T.LongType(), True),
        T.StructField("parent_inode", T.LongType(), True),
    ]
)

ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

# Field order of a scan record on the wire.
SCAN_COLUMNS = [
    "inode",
    "device",
    "mode",
    "uid",
    "gid",
    "size",
    "mtime",
    "atime",
    "scan_time",
    "basename",
    "root_inode",
    "parent_inode",
]

SCAN_SCHEMA = T.StructType([ENTRY_SCHEMA[name] for name in SCAN_COLUMNS])

import random
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grovemeter.functions.sizes import parse_size, pretty_size, size_bytes, usage_line
from grovemeter.functions.times import months_before, parse_time, signed_time_epoch
from grovemeter.operators.filters import (
    EntryFilter,
    check_roots,
    non_root_rows,
    split_negation,
    text_filter,
)
from tests.trees import directory, frame, row, unreadable

AS_OF = datetime(2024, 3, 31, 12)

SIZES = {
    "0": 0.0, "16": 16.0, "16b": 16.0, "16ib": 16.0, "1k": 1024.0, "1KB": 1024.0, "2MiB": 2.0 * 1024**2,
    "1.5g": 1.5 * 1024**3, "-10mb": -10.0 * 1024**2, "3T": 3.0 * 1024**4, "1e3k": 1024e3, " 5 ": 5.0,
}


def test_size_text(spark):
    assert {text: parse_size(text) for text in SIZES} == SIZES
    texts = spark.createDataFrame([(t,) for t in SIZES], "t string")
    got = texts.select("t", size_bytes(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in got} == SIZES


@pytest.mark.parametrize("text", ["", "mb", "5i", "5x", "k5"])
def test_bad_size_text(spark, text):
    with pytest.raises(ValueError):
        parse_size(text)
    with pytest.raises(PySparkException):
        spark.createDataFrame([(text,)], "t string").select(size_bytes(F.col("t"))).collect()


#: Worked out by hand; ties between two decimals go to the even digit.
PRETTY = {
    0: "  0.00B ", 1: "  1.00B ", 999: "999.00B ", 1023: "1023.00B ", 1024: "  1.00KB", 1536: "  1.50KB", 1152: "  1.12KB",
    1280: "  1.25KB", 1408: "  1.38KB", 10240: " 10.00KB", 2**20: "  1.00MB", 3 * 2**20 + 2**19: "  3.50MB", 2**30 - 1: "1024.00MB",
    2**30: "  1.00GB", 5 * 2**40: "  5.00TB", 2**50: "  1.00PB", 2**60: "  1.00EB", 2**63 - 1: "  8.00EB",
}


def test_pretty_size(spark):
    df = spark.createDataFrame([(s,) for s in PRETTY], "s long")
    assert {r["s"]: r["t"] for r in df.select("s", pretty_size(F.col("s")).alias("t")).collect()} == PRETTY
    assert spark.range(1).select(pretty_size(F.lit(None))).head()[0] is None


def test_usage_line(spark):
    line = usage_line(F.lit(3 * 1024**2), F.lit(48), F.lit("/some/where/"))
    assert spark.range(1).select(line).head()[0] == "  3.00MB,       48 files, /some/where/"


def at(*moment):
    return datetime(*moment, tzinfo=timezone.utc).timestamp()


TIMES = {
    "2018": at(2018, 1, 1),
    "20180623": at(2018, 6, 23),
    "2018-06-23": at(2018, 6, 23),
    "2018-06-23T10:30:00": at(2018, 6, 23, 10, 30),
    "1y": at(2023, 3, 31, 12),
    "1m": at(2024, 2, 29, 12),
    "1mo": at(2024, 2, 29, 12),
    "1y6m": at(2022, 9, 30, 12),
    "13m": at(2023, 2, 28, 12),
    "2w": at(2024, 3, 17, 12),
    "30d": at(2024, 3, 1, 12),
    "1d6h": at(2024, 3, 30, 6),
    "90min": at(2024, 3, 31, 10, 30),
    "2018-06": at(2018, 6, 1),
    "June 2018": at(2018, 6, 1),
    "sep 2018": at(2018, 9, 1),
    "23 May 2018": at(2018, 5, 23),
    "10 days": at(2024, 3, 21, 12),
    "1 year 6 months": at(2022, 9, 30, 12),
    "1.5d": at(2024, 3, 30, 0),
    "1.5 hours": at(2024, 3, 31, 10, 30),
    "30s": at(2024, 3, 31, 11, 59, 30),
    "2 weeks 1 day 0.5 sec": at(2024, 3, 16, 11, 59, 59) + 0.5,
}


def test_time_text(spark):
    assert {t: parse_time(t, AS_OF) for t in TIMES} == TIMES
    texts = spark.createDataFrame([(t,) for t in TIMES] + [("-1y",), ("+30d",)], "t string")
    as_of = F.to_timestamp(F.lit("2024-03-31 12:00:00"))
    got = texts.select("t", signed_time_epoch(F.col("t"), as_of).alias("e")).collect()
    assert {r["t"]: r["e"] for r in got} == TIMES | {"-1y": -TIMES["1y"], "+30d": TIMES["30d"]}


@pytest.mark.parametrize("text", ["", "soon", "1x", "6m1y", "1.5y", "Juno 2018", "10 days ago"])
def test_bad_time_text(text):
    with pytest.raises(ValueError):
        parse_time(text, AS_OF)


def test_months_clamp_at_month_end():
    assert months_before(datetime(2024, 3, 31), 1) == datetime(2024, 2, 29)
    assert months_before(datetime(2024, 2, 29), 12) == datetime(2023, 2, 28)
    assert months_before(datetime(2024, 1, 31), 2) == datetime(2023, 11, 30)


@pytest.mark.parametrize("bad", [None, "x", [], [1], [(1,)], [(1, 2, 3)], [("1", 2)], [(1, None)], [(1, 2.5)]])
def test_bad_roots(bad):
    with pytest.raises(ValueError):
        check_roots(bad)


def test_roots_and_filter_arguments():
    assert check_roots([(1, 2), [3.0, 4]]) == [(1, 2), (3, 4)]
    assert EntryFilter().is_empty and not EntryFilter(uid=0).is_empty
    for bad in ({"uid": "root"}, {"size": [1]}, {"mtime": True}):
        with pytest.raises(ValueError):
            EntryFilter(**bad)
    assert split_negation("!bob") == split_negation("-bob") == (True, "bob")
    assert split_negation("bob") == (False, "bob")


def test_text_filter(spark):
    users = spark.createDataFrame([(5, "bob"), (6, "eve")], "uid int, user string")
    groups = spark.createDataFrame([(7, "staff")], "gid int, group string")
    made = text_filter(
        user="!bob", group="staff", mtime="-1y", size="-1k", users=users, groups=groups, as_of=AS_OF
    )
    assert text_filter(mtime="+30d", as_of=AS_OF) == EntryFilter(mtime=TIMES["30d"])
    assert made == EntryFilter(not_uid=5, gid=7, mtime=-TIMES["1y"], size=-1024.0)
    with pytest.raises(LookupError):
        text_filter(user="nobody", users=users)


def test_filters_are_inclusive_and_drop_nulls(spark):
    rows = [directory("/r", 1, None, size=5, mtime=5.0), row("a", 2, 1, size=4, mtime=4.0), unreadable("u", 1)]
    entries = frame(spark, rows)

    def names(**values):
        return sorted(r["basename"] for r in EntryFilter(**values).apply(entries).collect())

    assert names(size=5) == ["/r"] and names(size=-5) == ["/r", "a"] and names(size=0) == ["/r", "a"]
    assert names(mtime=4.5) == ["/r"] and names(mtime=-4.0) == ["a"]
    assert names(not_uid=99) == ["/r", "a"] and names(gid=99) == []
    assert sorted(r["basename"] for r in non_root_rows(entries).collect()) == ["a", "u"]

import csv
import random
import uuid

import pytest
from pyspark.sql import functions as F

from grovemeter.operators.tree import duplicate_directories
from grovemeter.schemas import ENTRY_COLUMNS, SCAN_COLUMNS
from grovemeter.scratch import scratch_root
from grovemeter.sources.listings import entries_from_listing, url_names, url_root
from grovemeter.sources.scan_csv import load_scan, read_scan_csv, write_scan_csv
from grovemeter.sources.snapshots import in_ranges, publish_snapshot, read_snapshot
from tests.trees import directory, frame, row, unreadable

ODD_NAMES = [
    "plain", "a,b", 'say "hi"', '"', '""', "line\nfeed", "return\rhere", "back\\slash", " padded ", "ünï",
    ",", "\n", 'x",2,3', "'", "tab\there", "NULL", "#hash",
]
SPLIT_NAMES = [
    "a\r\nb", "\r\n", "\r\n\r\n", 'q"\r\n"r', "x\r\n1,2,3,4,5,6,7,8,9,fake,1,1\r\ny", "end\r\n",
]


def odd_rows(names):
    rows = [directory("/data/r", 1, None, mtime=1.25)]
    for n, name in enumerate(names):
        rows.append(row(name, 10 + n, 1, size=2**40 + n, mtime=1.5e9 + n / 8))
        rows.append(unreadable(f"{name}?", 1))
    return rows


def as_set(df):
    return sorted(map(tuple, df.select(*ENTRY_COLUMNS).collect()), key=str)


def write_like_a_scanner(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([[r[c] for c in SCAN_COLUMNS] for r in rows])


@pytest.mark.parametrize("names", [ODD_NAMES, ODD_NAMES + SPLIT_NAMES])
def test_scan_csv_round_trip(spark, tmp_path, names):
    entries = frame(spark, odd_rows(names))
    write_scan_csv(entries, str(tmp_path / "ours"))
    assert as_set(read_scan_csv(spark, str(tmp_path / "ours"))) == as_set(entries)


def test_scan_csv_from_another_writer(spark, tmp_path):
    """Many files, some with broken records, read in splits smaller than a record."""
    rng = random.Random(4)
    written = []
    for n in range(4):
        names = ODD_NAMES + (SPLIT_NAMES if n % 2 else [])
        rows = odd_rows([rng.choice(names) + str(i) for i in range(60)])
        write_like_a_scanner(tmp_path / f"scan.{n}.csv", rows)
        written += rows
    want = as_set(frame(spark, written))
    loaded = load_scan(spark, str(tmp_path / "scan.*.csv"), str(tmp_path / "base"), "1")
    assert as_set(loaded) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4096", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert as_set(read_scan_csv(spark, str(tmp_path / "scan.*.csv"))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_feed_separated_scan(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"1,2,3,4,5,6,7.5,8.5,9.5,name,1,\n,2,,,,,,,9.5,u,1,1\n")
    got = read_scan_csv(spark, str(tmp_path / "s.csv"), separator="\n").collect()
    assert sorted((r["basename"], r["inode"], r["mtime"]) for r in got) == [
        ("name", 1, 7.5), ("u", None, None),
    ]


def test_malformed_scan_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"1,2,3\r\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_scan_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_snapshots_appear_whole(spark, tmp_path):
    base = str(tmp_path / "snap")
    with pytest.raises(LookupError):
        read_snapshot(spark, base)
    first = frame(spark, odd_rows(["a"]))
    second = frame(spark, odd_rows(["a", "b"]))
    publish_snapshot(first, base, "2024-01")
    # A load that stopped before its commit is not seen and can be run again.
    second.limit(1).write.parquet(f"{base}/data/snapshot=2024-02")
    assert as_set(read_snapshot(spark, base)) == as_set(first)
    publish_snapshot(second, base, "2024-02")
    assert as_set(read_snapshot(spark, base)) == as_set(second)
    assert as_set(read_snapshot(spark, base, "2024-01")) == as_set(first)
    with pytest.raises(ValueError):
        publish_snapshot(first, base, "2024-02")


def test_of_two_loads_of_one_name_one_wins(spark, tmp_path, monkeypatch):
    import threading

    from grovemeter.sources import snapshots

    base = str(tmp_path / "raced")
    loads = [frame(spark, [row(f"load{n}-{i}", i, None) for i in range(20)]) for n in range(3)]
    ready, put = threading.Barrier(3), snapshots._put_if_absent
    # all have found the name free and written their data before any commits
    monkeypatch.setattr(snapshots, "_put_if_absent", lambda *a: (ready.wait(60), put(*a))[1])
    outcome = {}

    def load(n):
        try:
            publish_snapshot(loads[n], base, "2024/01 a")
            outcome[n] = "won"
        except ValueError:
            outcome[n] = "lost"

    threads = [threading.Thread(target=load, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome.values()) == ["lost", "lost", "won"]
    (winner,) = [n for n, o in outcome.items() if o == "won"]
    assert as_set(read_snapshot(spark, base)) == as_set(loads[winner])
    assert len(list((tmp_path / "raced" / "data").glob("*/attempt-*"))) == 1
    with pytest.raises(ValueError, match="already"):
        publish_snapshot(loads[0], base, "2024/01 a")
    with pytest.raises(LookupError):
        read_snapshot(spark, base, "other")


def test_a_load_that_died_while_committing_is_not_read(spark, tmp_path):
    base = tmp_path / "died"
    first = frame(spark, [row("a", 1, None)])
    publish_snapshot(first, str(base), "1")
    (base / "commits" / "snapshot-2.json").touch()
    assert as_set(read_snapshot(spark, str(base))) == as_set(first)
    with pytest.raises(ValueError, match="already"):
        publish_snapshot(first, str(base), "2")


def test_snapshot_spreads_a_hot_directory(spark, tmp_path):
    many = spark.range(20000).select(
        *[
            {"basename": F.concat(F.lit("f"), F.col("id")), "inode": F.col("id") + 10,
             "device": F.lit(1), "parent_inode": F.lit(1)}.get(c, F.lit(0)).alias(c)
            for c in ENTRY_COLUMNS
        ]
    )
    typed = frame(spark, []).unionByName(many)
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish_snapshot(typed, str(tmp_path / "hot"), "1")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    sizes = (
        read_snapshot(spark, str(tmp_path / "hot"))
        .groupBy(F.input_file_name())
        .count()
        .select("count")
        .collect()
    )
    assert len(sizes) == 4 and max(r[0] for r in sizes) < 10000


def test_a_snapshot_of_files_in_ranges_is_written_without_a_shuffle(spark, tmp_path):
    rows = [directory("/data/r", 1, None)] + [row(f"f{n * 7 % 300:03}", 1000 + n, 1 + n % 40) for n in range(300)]
    published, mixed = str(tmp_path / "published"), str(tmp_path / "mixed")
    publish_snapshot(frame(spark, rows), published, "1", 6)
    laid_out = read_snapshot(spark, published)
    frame(spark, rows).repartition(5, "basename").write.parquet(mixed)
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    for source, ranged in ((laid_out, True), (laid_out.withColumn("size", F.col("size") + 1), True), (spark.read.parquet(mixed), False)):
        to = f"{tmp_path}/{uuid.uuid4().hex}"
        publish_snapshot(source, to, "2", from_files=True)
        again = read_snapshot(spark, to)
        assert as_set(again) == as_set(source)
        # six files stay six; the shuffle of these few rows makes one
        assert len(again.inputFiles()) == (len(laid_out.inputFiles()) if ranged else 1)
        spans = []
        for file in again.inputFiles():
            keys = [(r.device, r.parent_inode or -1, r.basename) for r in spark.read.parquet(file).collect()]
            assert keys == sorted(keys)
            spans.append((keys[0], keys[-1]))
        spans.sort()
        assert all(last <= first for (_, last), (first, _) in zip(spans, spans[1:]))
    assert spark.conf.get(setting) == before
    assert in_ranges(laid_out.limit(0)) and not in_ranges(laid_out.unionByName(laid_out))


def test_an_unclosed_quote_is_refused(spark, tmp_path):
    lines = [f'f{n},{n},1,33188,1,1,1,0.0,0.0,0.0,1,1' for n in range(1000)]
    lines[1] = 'f"' + lines[1][1:]
    (tmp_path / "scan.csv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    with pytest.raises(ValueError, match="not closed"):
        read_scan_csv(spark, str(tmp_path / "scan.csv"))


def test_staged_tables_can_be_temporary(spark):
    from grovemeter.scratch import stage, temporary_tables

    kept = stage(spark.range(3))
    with temporary_tables(spark):
        gone = stage(spark.range(5))
        assert gone.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_listing(spark):
    urls = [
        ("https://h.org/a/b/c?x=1",), ("http://h.org/a/b/",), ("https://h.org/a/d#top",),
        ("https://h.org/a/d",), ("https://k.org/",), ("https://k.org/a",),
    ]
    listing = spark.createDataFrame(urls, "url string")
    entries = entries_from_listing(listing, url_root(F.col("url")), url_names(F.col("url")))
    got = {r["path"]: (r["parent_path"], r["basename"], r["mode"]) for r in entries.collect()}
    assert got == {
        "h.org": (None, "h.org", 16384),
        "h.org/a": ("h.org", "a", 16384),
        "h.org/a/b": ("h.org/a", "b", 16384),
        "h.org/a/b/c": ("h.org/a/b", "c", 32768),
        "h.org/a/d": ("h.org/a", "d", 32768),
        "k.org": (None, "k.org", 16384),
        "k.org/a": ("k.org", "a", 32768),
    }
    assert duplicate_directories(entries).isEmpty()
    linked = entries.alias("c").join(
        entries.alias("p"),
        (F.col("c.parent_inode") == F.col("p.inode")) & (F.col("c.device") == F.col("p.device")),
    )
    assert linked.where(F.col("c.parent_path") == F.col("p.path")).count() == 5


def test_scratch_follows_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark).startswith(configured)
    else:
        assert scratch_root(spark).startswith("file:")

from pyspark.sql import functions as F

from grovemeter.operators import history, unreadable
from grovemeter.operators.tree import build_directory_index
from grovemeter.sources import reports
from grovemeter.sources.snapshots import append_summary, read_summary
from tests.trees import directory, frame, row, unreadable as closed


def seconds(spark, text):
    return float(spark.sql(f"SELECT unix_micros(timestamp '{text}') / 1e6").head()[0])


def bins_of(spark, as_of, times, summary=history.age_history, column="mtime"):
    rows = [row(f"f{n}", n, 1, uid=n, **{column: t}) for n, t in enumerate(times)]
    got = summary(frame(spark, rows), F.to_timestamp(F.lit(as_of))).collect()
    found = {r["uid"]: r["bin_label"] for r in got}
    return [found.get(n) for n in range(len(times))]


def test_bin_edges_are_half_open(spark):
    as_of = "2024-03-31 12:00:00"
    # one month before is clamped to the end of February
    edge = seconds(spark, "2024-02-29 12:00:00")
    now = seconds(spark, as_of)
    times = [now, now - 1e-6, edge, edge - 1e-6, now + 5, None, 0.0, seconds(spark, "2021-03-31 12:00:00"),
             seconds(spark, "2021-03-31 11:59:59")]
    assert bins_of(spark, as_of, times) == [
        None, "0 days", "0 days", "1 month", None, None, "3 years", "1 year", "3 years",
    ]


def test_leap_day_year(spark):
    times = [seconds(spark, "2023-02-28 00:00:00"), seconds(spark, "2023-02-27 23:59:59")]
    assert bins_of(spark, "2024-02-29 00:00:00", times) == ["6 months", "1 year"]


def test_access_bins(spark):
    now = seconds(spark, "2024-03-31 12:00:00")
    times = [now - 86400 * d for d in (0.5, 60, 61, 90, 91)]
    got = bins_of(spark, "2024-03-31 12:00:00", times, history.access_history, "atime")
    assert got == ["0 days", "0 days", "60 days", "60 days", "90 days"]


def test_bin_table_agrees_with_the_expression(spark):
    as_of = F.to_timestamp(F.lit("2024-03-31 12:00:00"))
    now = seconds(spark, "2024-03-31 12:00:00")
    rows = [row(f"f{n}", n, 1, mtime=now - 86400.0 * n * 7) for n in range(-3, 250)]
    entries = frame(spark, rows)
    bins = history.age_bins(spark, history.CHANGE_BINS, as_of)
    moment = F.timestamp_seconds("mtime")
    inside = (F.col("lo").isNull() | (moment >= F.col("lo"))) & (moment < F.col("hi"))
    joined = entries.join(bins, inside).groupBy("bin_ord").count()
    direct = history.age_history(entries, as_of).groupBy("bin_ord").agg(F.sum("inodes"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, direct.collect()))
    assert bins.where("lo IS NULL").select("bin_label").head()[0] == "3 years"


def test_history_merges_devices_and_appends(spark, tmp_path):
    rows = [row("a", 1, 9, device=1, size=3), row("b", 1, 9, device=2, size=4), row("c", 2, 9, uid=None, size=None)]
    path = str(tmp_path / "history")
    # two runs; each of them is repeated and leaves the history as it was
    for moment in ("2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        append_summary(history.age_history(frame(spark, rows), F.to_timestamp(F.lit(moment))), path)
    got = read_summary(spark, path).select("uid", "inodes", "size", "bin_label", "months")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(10, 2, 7, "3 years", 36), (None, 1, None, "3 years", 36)] * 2, key=str
    )


def test_named_runs_share_a_stamp_and_are_replaced(spark, tmp_path):
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    path = str(tmp_path / "history")
    summary = lambda *names: history.age_history(frame(spark, [row(n, 1, 9) for n in names]), as_of)
    append_summary(summary("a"), path, run="scan 1")
    append_summary(summary("a", "b"), path, run="scan/2")
    append_summary(summary("a", "b", "c"), path, run="scan 1")
    found = read_summary(spark, path)
    assert found.columns == summary("a").columns
    assert sorted(r.inodes for r in found.collect()) == [2, 3]


REPORT = [
    directory("/data/r", 1, None, gid=500),
    directory("home", 2, 1, uid=5, gid=50),
    closed("x", 2),
    closed("y", 2),
    directory("tmp", 3, 1, uid=5),
    closed("z", 3),
    directory("in", 4, 3, uid=5),
    closed("z", 4),
    directory("tmpdir", 6, 1, uid=None, gid=None),
    closed("w", 6),
] + [
    r
    for n in range(5)
    for r in (directory(f"many{n}", 20 + n, 2, uid=6), closed("q", 20 + n))
]

USERS = [(5, "ann", "Ann A"), (7, "other", "Other")]


def report(spark):
    entries = frame(spark, REPORT)
    found = unreadable.unreadable_directories(entries, build_directory_index(entries))
    return found, spark.createDataFrame(USERS, "uid int, user string, fullname string")


def check_report(spark):
    found, users = report(spark)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(
        [(5, 50, 500, "/data/r/home"), (5, 20, 500, "/data/r/tmp"), (None, None, 500, "/data/r/tmpdir")]
        + [(6, 20, 500, f"/data/r/home/many{n}") for n in range(5)],
        key=str,
    )
    by_user = unreadable.unreadable_by_user(found).collect()
    assert {(r["uid"], r["count"]) for r in by_user} == {(5, 2), (6, 5)}
    assert len(by_user) == 7
    return found, users


def test_unreadable_directories(spark):
    check_report(spark)


def test_unreadable_directories_at_scale(spark, at_scale):
    check_report(spark)


def test_notices_and_path_lists(spark, tmp_path):
    found, users = report(spark)
    reports.write_notices(unreadable.unreadable_notices(found, users), str(tmp_path / "notices"))
    notices = {r["to"]: r for r in reports.read_notices(spark, str(tmp_path / "notices")).collect()}
    assert set(notices) == {"Ann A <ann@example.org>", "6 <6@example.org>"}
    ann = notices["Ann A <ann@example.org>"]["message"]
    assert "2 directories of yours" in ann
    assert '    chmod -R g+rX "/data/r/home"\n    chmod -R g+rX "/data/r/tmp"\n' in ann
    many = notices["6 <6@example.org>"]["message"]
    assert "5 directories" in many and "xargs chmod -R g+rX < /data/unreadable/6.txt" in many
    assert "many0" not in many
    one = unreadable.unreadable_notices(found.where("path = '/data/r/home'"), users).head()
    assert "1 directory of yours" in one["message"]

    lists = unreadable.user_path_lists(found, users)
    reports.write_user_path_lists(lists, str(tmp_path / "lists"))
    back = reports.read_user_path_lists(spark, str(tmp_path / "lists"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lists.collect()))
    assert {p.name for p in (tmp_path / "lists").glob("username=*")} == {"username=ann", "username=6"}

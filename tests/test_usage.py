import pytest

from grovemeter.operators import tree, usage
from grovemeter.operators.filters import EntryFilter
from tests.trees import Account, directory, frame, random_forest, row, unreadable

FILTER = EntryFilter(not_uid=3, size=-2500, mtime=200.0)


def passes(r):
    return (
        r["uid"] is not None and r["uid"] != 3
        and r["size"] is not None and r["size"] <= 2500
        and r["mtime"] is not None and r["mtime"] >= 200.0
    )


def totals_by_directory(spark, rows, entry_filter):
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries)
    got = usage.all_directory_usage(entries, index, entry_filter).collect()
    return {(r["device"], r["inode"]): (r["size"], r["inodes"]) for r in got}


def check_all_directories(spark, rows, entry_filter, test):
    account = Account(rows)
    got = totals_by_directory(spark, rows, entry_filter)
    assert got == dict(zip(got, account.du(list(got), test)))


@pytest.mark.parametrize("entry_filter, test", [(EntryFilter(), lambda r: True), (FILTER, passes)])
def test_every_directory_matches_its_own_search(spark, entry_filter, test):
    check_all_directories(spark, random_forest(11), entry_filter, test)


def test_every_directory_at_scale(spark, at_scale):
    check_all_directories(spark, random_forest(12), FILTER, passes)


def test_every_directory_with_overlapping_scans(spark):
    rows = [
        directory("/data/r", 1, None),
        directory("sub", 2, 1),
        directory("deep", 3, 2),
        row("f", 4, 3, size=7),
        directory("/data/r/sub", 2, None),
        directory("deep", 3, 2),
        row("f", 4, 3, size=7),
    ]
    check_all_directories(spark, rows, EntryFilter(), lambda r: True)


def check_roots(spark, rows, entry_filter, test):
    account = Account(rows)
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries)
    roots = sorted({(r["device"], r["inode"]) for r in rows if r["inode"] is not None})[::7]
    roots += [roots[0], (99, 99)]
    got = usage.usage_by_root(entries, roots, index, entry_filter).orderBy("root_id").collect()
    assert [(r["device"], r["inode"]) for r in got] == roots
    want = account.du(roots, test)
    assert [(r["size"], r["inodes"]) for r in got] == want
    whole = usage.du(entries, roots, index, entry_filter).head()
    assert (whole["size"], whole["inodes"]) == tuple(map(sum, zip(*want)))


def test_totals_per_root(spark):
    check_roots(spark, random_forest(13), EntryFilter(), lambda r: True)


def test_filtered_totals_per_root_at_scale(spark, at_scale):
    check_roots(spark, random_forest(14), FILTER, passes)


def test_children_of_a_directory(spark):
    rows = [
        directory("/r", 1, None, size=100),
        directory("d", 2, 1, size=10),
        row("f", 3, 2, size=5),
        row("g", 4, 1, size=6),
        row("g2", 4, 2, size=6),
        unreadable("u", 1),
        directory("e", 5, 1, size=3),
    ]
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries)
    children = usage.children_usage(entries, [(1, 1)], index)
    got = {r["basename"]: (r["size"], r["inodes"], r["is_directory"]) for r in children.collect()}
    assert got == {
        "d": (21, 3, True),
        "g": (12, 2, False),  # both names of a hard link
        "u": (0, 0, False),
        "e": (3, 1, True),
    }
    order = [r["basename"] for r in usage.sorted_children(children).collect()]
    assert order == ["d", "g", "e", "u"]
    order = [r["basename"] for r in usage.sorted_children(children, "inodes", False).collect()]
    assert order == ["u", "e", "g", "d"]


def test_children_at_scale(spark, at_scale):
    rows = random_forest(15)
    account = Account(rows)
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries)
    tops = sorted(k for k in account.inside if k in account.holding)
    got = usage.children_usage(entries, tops, index).collect()
    children = [r for key in tops for r in account.inside[key]]
    want = []
    for r in children:
        size, inodes = (0, 0) if r["inode"] is None else account.du([(r["device"], r["inode"])])[0]
        want.append((r["device"], r["basename"], size, inodes))
    assert sorted((r["device"], r["basename"], r["size"], r["inodes"]) for r in got) == sorted(want)


def test_unknown_totals_sort_as_largest(spark):
    listing = spark.createDataFrame(
        [("a", 5), ("b", None), ("c", 9)], "basename string, size long"
    )
    assert [r[0] for r in usage.sorted_children(listing).collect()] == ["b", "c", "a"]
    assert [r[0] for r in usage.sorted_children(listing, descending=False).collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        usage.sorted_children(listing, by="name")


def test_empty_result_is_zero(spark):
    entries = frame(spark, [directory("/r", 1, None)])
    index = tree.build_directory_index(entries)
    assert usage.du(entries, [(1, 1)], index, EntryFilter(uid=77)).head().asDict() == {
        "size": 0, "inodes": 0,
    }


@pytest.mark.parametrize("seed", range(4))
def test_laid_out_entries_change_no_result(spark, seed):
    rows = random_forest(seed, devices=6, size=60)
    entries, account = frame(spark, rows), Account(rows)
    index = tree.lay_out_entries(entries, tree.build_directory_index(entries))
    assert index.laid_out is not None
    keys = sorted({(r["device"], r["inode"]) for r in rows if r["inode"] is not None})
    roots = (keys[:: max(1, len(keys) // 12)] * 2)[:20] + [(99, 1)]
    for wanted, passes in (
        (EntryFilter(), lambda r: True),
        (EntryFilter(uid=2), lambda r: r["uid"] == 2),
        (EntryFilter(size=2000), lambda r: r["size"] is not None and r["size"] >= 2000),
    ):
        totals = account.du(roots, passes)
        found = usage.usage_by_root(entries, roots, index, wanted).orderBy("root_id").collect()
        assert [(r.size, r.inodes) for r in found] == totals
        (whole,) = usage.du(entries, roots, index, wanted).collect()
        assert tuple(whole) == (sum(s for s, _ in totals), sum(n for _, n in totals))
        paths = sorted(p for _, r, p in account.search(roots) if passes(r))
        assert sorted(r.path for r in tree.find(entries, roots, index, wanted).collect()) == paths
        dirs = sorted(tuple(r) for r in index.directories.select("device", "inode").collect())
        every = dict(zip(dirs, account.du(dirs, passes)))
        found = usage.all_directory_usage(entries, index, wanted, with_path=False).collect()
        assert {(r.device, r.inode): (r.size, r.inodes) for r in found} == every


def test_ranks_are_intervals_of_subtrees(spark):
    rows = random_forest(7, devices=5, size=80)
    # names that sort before a separator, and two directories at one path
    top = next(r for r in rows if r["parent_inode"] is None and r["device"] == 1 and r["inode"])["inode"]
    rows += [
        directory("a", 9001, top), directory("a!b", 9002, top), directory("x", 9003, 9001), directory("a", 9004, top),
        directory("x", 9005, 9004), directory("x", 9006, 9001), row("f", 9007, 9005, size=7), directory("a-", 9008, top),
    ]
    entries, account = frame(spark, rows), Account(rows)
    found = tree.build_directory_index(entries).table.collect()
    assert len({r.rank for r in found}) == len(found)
    for r in found:
        below = {o.rank for o in found if o.device == r.device and r.inode in o.chain}
        assert below == {o.rank for o in found if r.rank <= o.rank <= r["last"]}
        size, inodes = account.du([(r.device, r.inode)])[0]
        assert (r.all_bytes + (r.size or 0), r.all_entries + 1) == (size, inodes)


def test_a_kept_layout_is_opened_again(spark, tmp_path):
    rows = random_forest(3, devices=2)
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries, path=str(tmp_path / "index"))
    laid = tree.lay_out_entries(entries, index, path=str(tmp_path / "entries"))
    again = tree.open_layout(tree.open_directory_index(spark, str(tmp_path / "index")), str(tmp_path / "entries"))
    assert again.laid_out.count() == laid.laid_out.count() == sum(1 for r in rows if (r["device"], r["parent_inode"]) in {(d["device"], d["inode"]) for d in rows if d["inode"]})


@pytest.mark.parametrize("seed", range(2))
def test_totals_by_level_count_every_way(spark, seed):
    rows = random_forest(seed, devices=4, size=40)
    dirs = [r for r in rows if r["inode"] is not None and r["mode"] != 0o100644]
    # second and third rows of directories: as scan roots, repeated, and below another directory
    tops = {r["device"]: r["inode"] for r in dirs if r["parent_inode"] is None}
    rows += [{**r, "parent_inode": None, "basename": f"/again/{r['inode']}"} for r in dirs[::5]]
    rows += [dict(r) for r in dirs[1::7]]
    rows += [{**r, "parent_inode": tops[r["device"]], "basename": "moved"} for r in dirs[2::9] if r["parent_inode"] not in (None, tops[r["device"]])]
    entries, account = frame(spark, rows), Account(rows)
    index = tree.build_directory_index(entries)
    assert not index.single
    keys = sorted({(r["device"], r["inode"]) for r in rows if r["inode"] is not None})
    roots = spark.createDataFrame([(n, *key) for n, key in enumerate(keys * 2)], "root_id long, device long, inode long")
    for wanted, check in ((EntryFilter(), lambda r: True), (FILTER, passes)):
        totals = account.du(keys, check)
        found = usage.usage_by_root(entries, roots, index, wanted).orderBy("root_id").collect()
        assert [(r.size, r.inodes) for r in found] == totals * 2
        every = dict(zip(keys, totals))
        found = usage.all_directory_usage(entries, index, wanted, with_path=False).collect()
        assert found and all((r.size, r.inodes) == every[r.device, r.inode] for r in found)


def test_totals_by_level_notice_a_cycle(spark):
    rows = [
        directory("/data", 1, None), directory("a", 2, 1), directory("b", 3, 2), directory("c", 4, 3),
        directory("a", 2, 4),  # the second row closes a cycle
        row("f", 9, 4),
    ]
    entries = frame(spark, rows)
    index = tree.build_directory_index(entries)
    with pytest.raises(ValueError, match="inside itself"):
        usage.all_directory_usage(entries, index).collect()

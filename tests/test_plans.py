"""What the plans promise at scale: no Python, no cross joins, narrow and filtered scans."""

import os
import re

import pytest
from pyspark.sql import functions as F

from grovemeter.operators import history, tree, usage
from grovemeter.operators.filters import EntryFilter
from grovemeter.plans import catalog
from grovemeter.plans.sample import Sample, sample

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def loaded(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return sample(spark, FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_query_needs_python_or_a_cross_join(loaded, name):
    text = plan(catalog.QUERIES[name](loaded))
    for word in ("Python", "Pandas", "NestedLoop", "Cartesian", "ExistingRDD"):
        assert word not in text, word


def test_history_is_one_narrow_scan_and_one_shuffle(loaded):
    text = plan(history.age_history(loaded.entries, catalog.as_of()))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"root_inode", "uid", "gid", "size", "mtime"}
    assert "Window" not in text


def test_filters_reach_the_scan(loaded):
    found = tree.find(loaded.entries, loaded.roots, loaded.index, EntryFilter(uid=5, size=1024))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(found))
    assert any("EqualTo(uid,5)" in p and "GreaterThanOrEqual(size" in p for p in pushed)


def test_unfiltered_totals_never_read_the_entries(loaded):
    text = plan(usage.du(loaded.entries, loaded.roots, loaded.index))
    assert "directory-index" in text and "snapshot=" not in text
    assert "SortMergeJoin" not in text
    text = plan(usage.all_directory_usage(loaded.entries, loaded.index, with_path=False))
    assert "snapshot=" not in text


ONE_REGION = [(1, 2)]


def scans(text, table):
    """(pushed filters, columns read) of the scans of a staged table."""
    found = re.findall(r"FileScan parquet [^\n]*Location: [^\n]*?/([a-z-]+)-[0-9a-f]{32}[^\n]*PushedFilters: \[(.*?)\], ReadSchema: struct<([^\n]*)>", text)
    return [(pushed, {c.split(":")[0] for c in columns.split(",")}) for name, pushed, columns in found if name == table]


def test_totals_of_a_root_read_only_its_own_rows(loaded):
    text = plan(usage.du(loaded.entries, ONE_REGION, loaded.index))
    assert "EqualTo(rank," in text and "chain" not in text and "laid-out" not in text


@pytest.mark.parametrize("search", [tree.find, usage.du, usage.usage_by_root])
def test_a_filtered_search_below_a_root_is_a_scan_of_its_range(loaded, search):
    wanted = catalog.FILTERS["find_filtered"]
    text = plan(search(loaded.entries, ONE_REGION, loaded.index, wanted))
    ((pushed, columns),) = scans(text, "laid-out")
    assert "GreaterThanOrEqual(dir_rank," in pushed and "LessThanOrEqual(dir_rank," in pushed
    assert "LessThanOrEqual(mtime," in pushed and "EqualTo(gid,3)" in pushed
    # no entry is shuffled: what is summed has been reduced, what is found goes nowhere
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text and "snapshot=" not in text
    if search is tree.find:
        assert "Exchange hashpartitioning" not in text
    else:
        assert "basename" not in columns and "dir_path" not in columns
        assert all("root_id" in keys or keys == "" for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text))


@pytest.mark.parametrize(
    "name", ["all_dir_usage", "all_dir_usage_filtered", "children_usage", "children_usage_sorted", "du_per_root", "du_filtered"]
)
def test_totals_explode_no_chains(loaded, name):
    assert "explode(chain" not in plan(catalog.QUERIES[name](loaded))


def test_totals_of_all_directories_are_a_scan(loaded):
    text = plan(usage.all_directory_usage(loaded.entries, loaded.index))
    assert "Exchange" not in text and "Join" not in text


def test_du_builds_no_paths_from_entries(loaded):
    text = plan(usage.du(loaded.entries, loaded.roots, loaded.index, EntryFilter(uid=5)))
    scans = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert not any("basename" in s for s in scans)


def test_latest_grants_use_hash_aggregates(loaded):
    assert "SortAggregate" not in plan(loaded.accounting.storage_grants_latest())


def test_first_paths_of_a_user_are_cut_before_the_shuffle(loaded):
    from grovemeter.operators import unreadable

    found = unreadable.unreadable_directories(loaded.entries, loaded.index)
    assert "WindowGroupLimit" in plan(unreadable.unreadable_notices(found, loaded.users()))


def test_pushdown_of_the_unreadable_mark(loaded):
    from grovemeter.operators.filters import unreadable

    assert "IsNull(mode)" in plan(unreadable(loaded.entries).select(F.col("device")))


def test_copies_are_built_without_a_layout_or_a_second_snapshot(spark):
    fresh = Sample(spark, FOLDER)
    for name in ("overlapping", "shared_keys", "mounted"):
        assert "snapshot=" in plan(getattr(fresh, name))
    assert "index" not in vars(fresh) and "bare_index" in vars(fresh)


def test_shuffles_start_with_partitions_for_the_size_of_the_tables(spark, monkeypatch):
    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(setting, None)
    monkeypatch.setattr("grovemeter.plans.sample.PARTITION_BYTES", 1024)
    Sample(spark, FOLDER)
    assert int(spark.conf.get(setting)) > 50
    spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_tasks_of_a_sample_stay_small(spark):
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "64m")
    Sample(spark, FOLDER)
    assert int(spark.conf.get(setting).removesuffix("b")) <= 16 * 1024**2

import pytest
from pyspark.sql import functions as F

from grovemeter.operators import lookup


def tables(spark):
    """A third of the facts on one key, all alike; another hot key; NULL and unmatched keys."""
    n = F.col("id")
    key = (
        F.when(n % 3 == 0, F.lit(7))
        .when(n % 5 == 0, F.lit(8))
        .when(n % 31 == 0, F.lit(None))
        .otherwise(n % 40)
    )
    facts = spark.range(0, 900, 1, 6).select(
        key.cast("int").alias("k"), F.when(n % 3 == 0, F.lit("same")).otherwise(n.cast("string")).alias("v")
    )
    names = spark.range(0, 35).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    return facts, names


def rows(df):
    return sorted(map(tuple, df.select("k", "v", "w").collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_plain_join(spark, at_scale, how):
    facts, names = tables(spark)
    names = names.unionByName(names.where("k = 7"))  # a key may have several lookup rows
    joined = lookup.join_lookup(facts, names, ["k"], how)
    assert "salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == rows(facts.join(names, ["k"], how))


def test_equal_rows_of_a_hot_key_are_spread(spark, at_scale):
    facts, names = tables(spark)
    hot = lookup.find_hot_keys(facts, ["k"])
    assert {r["k"]: r["pieces"] for r in hot.collect()}[7] >= 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup.salted_join(facts, names, ["k"], "inner", hot).where("k = 7")
        spread = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(spread) > 1


def test_size_checks(spark, monkeypatch, tmp_path):
    facts, names = tables(spark)
    assert lookup.find_hot_keys(facts.limit(50).coalesce(1), ["k"]) is None
    names.write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    assert "BroadcastHashJoin" in lookup.join_lookup(facts, names, ["k"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 5)
    assert not lookup.is_small(names)
    joined = lookup.join_lookup(facts, names, ["k"])
    assert "salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == rows(facts.join(names, ["k"]))


def test_size_checks_run_no_job(spark, tmp_path):
    """200 partitions: the size is known from the files, and nothing is read for it."""
    path = str(tmp_path / "wide")
    spark.range(0, 4000, 1, 200).write.parquet(path)
    wide = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("size", "size")
    try:
        assert lookup.is_small(wide)
        assert lookup.estimated_bytes(wide.where("id > 5").select("id")) > 0
        assert not lookup.is_small(wide.join(wide.withColumnRenamed("id", "j"), F.col("id") > F.col("j")))
        assert not tracker.getJobIdsForGroup("size")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equal_rows_that_take_no_space_are_counted(spark, monkeypatch, tmp_path):
    """Far more rows than bytes: one key that must be split all the same."""
    path = str(tmp_path / "alike")
    spark.range(0, 400_000, 1, 2).select(F.lit(1).alias("k"), F.lit(2).alias("v")).write.parquet(path)
    alike = spark.read.parquet(path)
    assert lookup.estimated_bytes(alike) < 400_000
    monkeypatch.setattr(lookup, "ROWS_PER_PIECE", 100_000)
    assert [tuple(r) for r in lookup.find_hot_keys(alike, ["k"]).collect()] == [(1, 4)]
    monkeypatch.setattr(lookup, "ROWS_PER_PIECE", 400_000)
    assert lookup.find_hot_keys(alike, ["k"]) is None


def test_a_star_finds_hot_values_of_all_keys_in_one_scan(spark, at_scale, monkeypatch):
    facts, names = tables(spark)
    facts = facts.withColumn("j", (F.col("v") == "same").cast("int")).withColumn("i", F.col("v"))
    marks = spark.createDataFrame([(0, "other"), (1, "like")], "j int, mark string")
    plain = facts.join(names, "k").join(marks, "j")
    hot = lookup.hot_values(facts, ["k", "j", "i"])
    for column, found in hot.items():
        want = {tuple(r) for r in lookup.hot_keys(facts.where(F.col(column).isNotNull()), [column]).collect()}
        assert {tuple(r) for r in found.collect()} == want
    assert lookup.hot_values(facts.withColumn("own", F.monotonically_increasing_id()), ["own"]) == {"own": None}

    scans = []
    monkeypatch.setattr(lookup, "stage", lambda df, label, real=lookup.stage: scans.append(label) or real(df, label))
    joined = lookup.join_star(facts, [(names, "k"), (marks, "j")])
    assert scans == ["hot"]
    assert "salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    columns = ["k", "j", "v", "w", "mark"]
    assert sorted(map(str, joined.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))

"""The star-schema sample tables read as a storage snapshot and as accounting tables.

Each sample folder is loaded once per application, as a site would load a scan: the derived
entries are published as a snapshot and the directory index is built from it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemeter.operators.lookup import estimated_bytes
from grovemeter.operators.tree import DirectoryIndex, build_directory_index, lay_out_entries
from grovemeter.plans.accounting import Accounting
from grovemeter.schemas import ENTRY_COLUMNS, ENTRY_SCHEMA
from grovemeter.scratch import new_scratch_path
from grovemeter.scratch import stage_packed as stage
from grovemeter.sources.snapshots import publish_snapshot, read_snapshot

DIRECTORY_MODE = 16877
FILE_MODE = 33188
ROOT_INODE = 2
TMP_NATION = 7
LARGE_TABLES = ("customer", "orders", "lineitem")
# Bytes of the large tables for which a shuffle starts with one more partition.
PARTITION_BYTES = 4 * 1024**2
# Shuffled bytes up to which adaptive execution joins partitions. Packed rows grow twentyfold once they
# are sorted or hashed, so a task takes about 350 MB whatever the size of the tables.
JOINED_BYTES = 16 * 1024**2


def epoch(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)


class Sample:
    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder
        # Shuffles start with as many partitions as the tables need; adaptive execution joins small ones.
        needed = sum(estimated_bytes(self.table(name)) for name in LARGE_TABLES) // PARTITION_BYTES
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), needed)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED_BYTES)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- snapshot ---

    @cached_property
    def entries(self) -> DataFrame:
        base = new_scratch_path(self.spark, "sample")
        publish_snapshot(self.mapped_entries(), base, "1")
        return read_snapshot(self.spark, base)

    @cached_property
    def bare_index(self) -> DirectoryIndex:
        return build_directory_index(self.entries)

    @cached_property
    def index(self) -> DirectoryIndex:
        """The index with the entries laid out by it."""
        return lay_out_entries(self.entries, self.bare_index)

    @property
    def roots(self) -> list[tuple[int, int]]:
        return [(device, ROOT_INODE) for device in range(1, 6)]

    @cached_property
    def overlapping(self) -> DataFrame:
        """The snapshot as left by a second scan of every nation directory."""
        nations = (F.col("parent_inode") == ROOT_INODE) & F.col("inode").isNotNull()
        second_root = self.bare_index.table.where(nations).select(
            *[F.col("path") if c == "basename" else F.col(c) for c in ENTRY_COLUMNS if c != "parent_inode"],
            F.lit(None).cast("long").alias("parent_inode"),
        )
        second_root = second_root.withColumnRenamed("path", "basename").select(*ENTRY_COLUMNS)
        below = self.entries.where(F.col("parent_inode") != ROOT_INODE)
        return self.entries.unionByName(stage(second_root, "second-roots")).unionByName(below)

    @cached_property
    def overlapping_index(self) -> DirectoryIndex:
        return build_directory_index(self.overlapping)

    @cached_property
    def shared_keys(self) -> DataFrame:
        """The snapshot with a file beside every nation directory that has the same number."""
        files = self.bare_index.table.where(F.col("parent_inode") == ROOT_INODE).select(*ENTRY_COLUMNS)
        files = files.withColumns(
            {"basename": F.concat("basename", F.lit(".lnk")), "mode": F.lit(33188), "size": F.lit(100).cast("long")}
        )
        return self.entries.unionByName(stage(files, "shared-keys"))

    @cached_property
    def shared_keys_index(self) -> DirectoryIndex:
        return build_directory_index(self.shared_keys)

    @cached_property
    def mounted(self) -> DataFrame:
        """The snapshot with a scan of /data, where each region is seen as a mount point."""
        roots = self.bare_index.table.where(F.col("inode") == ROOT_INODE).select(*ENTRY_COLUMNS)
        outer = roots.withColumns(
            {"device": F.lit(900).cast("long"), "size": F.lit(10).cast("long"), "root_inode": F.lit(1).cast("long")}
        )
        points = outer.withColumns(
            {"basename": F.element_at(F.split("basename", "/"), -1), "parent_inode": F.lit(1).cast("long")}
        )
        top = outer.limit(1).withColumns({"basename": F.lit("/data"), "inode": F.lit(1).cast("long")})
        return self.entries.unionByName(stage(points.unionByName(top), "mounts"))

    @cached_property
    def mounted_index(self) -> DirectoryIndex:
        return build_directory_index(self.mounted)

    def mapped_entries(self) -> DataFrame:
        region = self.table("region")
        nation = self.table("nation")
        device = nation.select(
            F.col("n_nationkey"), (F.col("n_regionkey") + 1).cast("long").alias("device")
        )
        customer = self.table("customer").select(
            "c_custkey", "c_name", "c_nationkey"
        ).join(device, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(
            customer, F.col("o_custkey") == F.col("c_custkey")
        )
        lineitem = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
        ).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

        region_rows = _entries(
            region,
            basename=F.concat(F.lit("/data/"), "r_name"),
            inode=F.lit(ROOT_INODE),
            device=F.col("r_regionkey") + 1,
            uid=F.lit(0),
            gid=F.col("r_regionkey"),
        )
        nation_rows = _entries(
            nation,
            basename=F.when(F.col("n_nationkey") == TMP_NATION, F.lit("tmp")).otherwise(F.col("n_name")),
            inode=1000 + F.col("n_nationkey"),
            device=F.col("n_regionkey") + 1,
            uid=F.lit(0),
            gid=F.col("n_nationkey"),
            parent_inode=F.lit(ROOT_INODE),
        )
        customer_rows = _entries(
            customer,
            basename=F.col("c_name"),
            inode=1_000_000 + F.col("c_custkey"),
            device=F.col("device"),
            uid=F.col("c_custkey"),
            gid=F.col("c_nationkey"),
            parent_inode=1000 + F.col("c_nationkey"),
        )
        order_rows = _entries(
            orders,
            basename=F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")),
            inode=1_000_000_000 + F.col("o_orderkey"),
            device=F.col("device"),
            uid=F.col("c_custkey"),
            gid=F.col("c_nationkey"),
            mtime=epoch(F.col("o_orderdate")),
            parent_inode=1_000_000 + F.col("o_custkey"),
        )
        readable = ~(
            (F.col("l_linenumber") == 1)
            & (F.col("l_discount") == 0.0)
            & (F.col("l_orderkey") % 7 == 0)
        )
        mtime = epoch(F.col("l_shipdate"))
        file_values = {
            "inode": 1_000_000_000_000 + F.col("l_orderkey") * 16 + F.col("l_linenumber"),
            "mode": F.lit(FILE_MODE),
            "uid": F.col("c_custkey"),
            "gid": F.col("c_nationkey"),
            "size": (F.col("l_quantity") * 1048576).cast("long"),
            "mtime": mtime,
            "atime": mtime + F.lit(86400.0) * F.col("l_quantity"),
        }
        file_rows = _entries(
            lineitem,
            basename=F.concat(
                F.lit("item_"),
                F.col("l_linenumber").cast("string"),
                F.lit("_"),
                F.col("l_partkey").cast("string"),
            ),
            device=F.col("device"),
            parent_inode=1_000_000_000 + F.col("l_orderkey"),
            **{name: F.when(readable, value) for name, value in file_values.items()},
        )
        return (
            region_rows.unionByName(nation_rows)
            .unionByName(customer_rows)
            .unionByName(order_rows)
            .unionByName(file_rows)
        )

    # --- names ---

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("int").alias("uid"),
            F.col("c_name").alias("user"),
            F.col("c_mktsegment").alias("fullname"),
        )

    def groups(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("gid"), F.col("n_name").alias("group")
        )

    # --- accounting ---

    @cached_property
    def accounting(self) -> Accounting:
        return Accounting(
            {
                "projects": self._projects,
                "systems": self._systems,
                "system_queues": self._system_queues,
                "project_usage": self._project_usage,
                "schemes": self._schemes,
                "quarters": self._quarters,
                "storage_points": self._storage_points,
                "storage_grants": self._storage_grants,
                "usage_grants": self._usage_grants,
                "users": self._account_users,
                "user_storage": self._user_storage,
                "user_usage": self._user_usage,
            }
        )

    def _projects(self):
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("project")
        )

    def _systems(self):
        return self.table("region").select(
            F.col("r_regionkey").alias("id"), F.col("r_name").alias("system")
        )

    def _system_queues(self):
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_regionkey").alias("system_id"),
            F.col("n_name").alias("queue"),
            (F.lit(1.0) + F.col("n_nationkey") % 4).alias("chargeweight"),
        )

    def _project_usage(self):
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("project_id"),
            (F.col("l_partkey") % 25).alias("systemqueue_id"),
            F.col("l_shipdate").alias("date"),
            F.col("l_discount").alias("usage_cpu"),
            F.col("l_quantity").alias("usage_wall"),
            F.col("l_extendedprice").alias("usage_su"),
        )

    def _schemes(self):
        names = self.table("orders").select(F.col("o_orderpriority").alias("scheme")).distinct()
        return stage(names.withColumn("id", F.xxhash64("scheme")), "schemes")

    def _quarters(self):
        moments = self.table("orders").select(
            F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
        )
        return stage(
            moments.distinct().withColumn("id", F.col("year") * 10 + F.col("quarter")),
            "quarters",
        )

    def _storage_points(self):
        points = F.array(
            F.struct(F.lit(0).alias("id"), F.lit("/data").alias("storagepoint")),
            F.struct(F.lit(1).alias("id"), F.lit("/scratch").alias("storagepoint")),
        )
        return self.spark.range(1).select(F.inline(points))

    def _grants(self):
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_custkey") % 10).alias("project_id"),
            (F.col("o_custkey") % 5).alias("system_id"),
            F.xxhash64("o_orderpriority").alias("scheme_id"),
            (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("quarter_id"),
            (F.col("o_orderkey") % 2).alias("storagepoint_id"),
            F.col("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("capacity"),
            (F.col("o_orderkey") * 1000).alias("inodes"),
        )

    def _storage_grants(self):
        return self._grants()

    def _usage_grants(self):
        return self._grants().drop("storagepoint_id", "inodes").withColumnRenamed(
            "capacity", "allocation"
        )

    def _account_users(self):
        return self.users().withColumnRenamed("uid", "id")

    def _usage_facts(self):
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def _user_storage(self):
        month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
        return self._usage_facts().select(
            F.col("l_suppkey").alias("project_id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("l_linenumber") % 2).alias("storagepoint_id"),
            F.concat(F.lit("dir_"), F.col("l_partkey").cast("string")).alias("folder"),
            month.cast("timestamp_ntz").alias("scandate"),
            F.col("l_linenumber").cast("long").alias("inodes"),
            (F.col("l_quantity") * 1048576).cast("long").alias("size"),
        )

    def _user_usage(self):
        return self._usage_facts().select(
            F.col("l_suppkey").alias("project_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_shipdate").alias("date"),
            F.col("l_discount").alias("usage_cpu"),
            F.col("l_quantity").alias("usage_wall"),
            F.col("l_extendedprice").alias("usage_su"),
            (F.col("l_discount") / F.col("l_quantity")).alias("efficiency"),
        )


def _entries(df: DataFrame, **values: Column) -> DataFrame:
    """Directory entries by default: mode, size and times may be left out."""
    mtime = values.setdefault("mtime", F.lit(0.0))
    values.setdefault("atime", mtime)
    values.setdefault("mode", F.lit(DIRECTORY_MODE))
    values.setdefault("size", F.lit(4096))
    values.setdefault("scan_time", F.lit(0.0))
    values.setdefault("root_inode", F.lit(ROOT_INODE))
    values.setdefault("parent_inode", F.lit(None))
    return df.select(
        *[values[name].cast(ENTRY_SCHEMA[name].dataType).alias(name) for name in ENTRY_COLUMNS]
    )


_SAMPLES: dict[tuple[str, str], Sample] = {}


def sample(spark: SparkSession, folder: str) -> Sample:
    """The sample of ``folder``, loaded once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SAMPLES:
        _SAMPLES[key] = Sample(spark, folder)
    return _SAMPLES[key]

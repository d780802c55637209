"""Accounting views over grants and usage of compute and storage.

Facts are joined to their dimensions one key at a time. A dimension is broadcast where its
estimated size allows; a larger one is joined by shuffle, with hot fact keys split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.operators.lookup import is_small, join_star

# Base tables of the accounting model.
TABLES = (
    "projects",
    "systems",
    "system_queues",
    "project_usage",
    "schemes",
    "quarters",
    "storage_points",
    "storage_grants",
    "usage_grants",
    "users",
    "user_storage",
    "user_usage",
)


class Accounting:
    """The nine views over a set of base tables.

    ``tables`` maps a name in ``TABLES`` to a DataFrame, or to a function giving one so that
    only the tables a view needs are opened. Table ids are unique.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._sources = dict(tables)

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def _named(
        self, facts: DataFrame, *dimensions: tuple[DataFrame | str, ...], small: dict[str, bool] | None = None
    ) -> DataFrame:
        """Inner joins of ``facts`` to dimensions, each (table or its name, key, columns to add).

        The key of the facts is the dimension's id; it is dropped.
        """
        star = []
        for source, key, *columns in dimensions:
            dimension = self.table(source) if isinstance(source, str) else source
            star.append((dimension.select(F.col("id").alias(key), *columns), key))
        return join_star(facts, star, small).drop(*[key for _, key in star])

    def project_usage(self) -> DataFrame:
        """Compute usage with project, queue and system; zero and unknown usage left out."""
        facts = self.table("project_usage").where(~(F.col("usage_cpu") == F.lit(0.0)))
        queues = self.table("system_queues").select("id", "system_id", "queue")
        # a queue with its system's name is one row still, whatever the planner expects of a join
        small = {"systemqueue_id": is_small(queues)}
        queues = self._named(queues, ("systems", "system_id", "system"))
        facts = self._named(
            facts, ("projects", "project_id", "project"), (queues, "systemqueue_id", "system", "queue"), small=small
        )
        return facts.select(
            "project", "system", "queue", "date", "usage_cpu", "usage_wall", "usage_su"
        )

    def _storage_grants(self, grants: DataFrame) -> DataFrame:
        grants = self._named(
            grants,
            ("projects", "project_id", "project"),
            ("systems", "system_id", "system"),
            ("schemes", "scheme_id", "scheme"),
            ("quarters", "quarter_id", "year", "quarter"),
            ("storage_points", "storagepoint_id", "storagepoint"),
        )
        return grants.select(
            "id",
            "project",
            "system",
            "storagepoint",
            "scheme",
            "year",
            "quarter",
            "date",
            "capacity",
            "inodes",
        )

    def storage_grants(self) -> DataFrame:
        """Storage grants with the names of their five dimensions."""
        return self._storage_grants(self.table("storage_grants"))

    def storage_grants_latest(self) -> DataFrame:
        """The grant with the largest id per project, system, point, scheme and quarter.

        The year is not part of the key.
        """
        keys = ["project", "system", "storagepoint", "scheme", "quarter"]
        return _latest(self.storage_grants(), keys)

    def system_queues(self) -> DataFrame:
        """Queues with their system and charge weight."""
        queues = self._named(self.table("system_queues"), ("systems", "system_id", "system"))
        return queues.select("system", "queue", "chargeweight")

    def user_storage(self) -> DataFrame:
        """Storage use per folder with project, user and storage point."""
        facts = self._named(
            self.table("user_storage"),
            ("projects", "project_id", "project"),
            ("users", "user_id", "user", "fullname"),
            ("storage_points", "storagepoint_id", "storagepoint"),
        )
        return facts.select(
            "project", "user", "fullname", "storagepoint", "folder", "scandate", "inodes", "size"
        )

    def total_user_storage(self) -> DataFrame:
        """Storage use per user, summed over folders: by ids first, then by names."""
        ids = ["project_id", "user_id", "storagepoint_id", "scandate"]
        sums = [F.sum("inodes").alias("inodes"), F.sum("size").alias("size")]
        facts = self.table("user_storage").groupBy(*ids).agg(*sums)
        facts = self._named(
            facts,
            ("projects", "project_id", "project"),
            ("users", "user_id", "user", "fullname"),
            ("storage_points", "storagepoint_id", "storagepoint"),
        )
        return facts.groupBy("project", "user", "fullname", "storagepoint", "scandate").agg(*sums)

    def _usage_grants(self, grants: DataFrame) -> DataFrame:
        grants = self._named(
            grants,
            ("projects", "project_id", "project"),
            ("systems", "system_id", "system"),
            ("schemes", "scheme_id", "scheme"),
            ("quarters", "quarter_id", "year", "quarter"),
        )
        return grants.select(
            "id", "project", "system", "scheme", "year", "quarter", "date", "allocation"
        )

    def usage_grants(self) -> DataFrame:
        """Compute grants with the names of their four dimensions."""
        return self._usage_grants(self.table("usage_grants"))

    def usage_grants_latest(self) -> DataFrame:
        """The grant with the largest id per project, system, scheme and quarter."""
        return _latest(self.usage_grants(), ["project", "system", "scheme", "quarter"])

    def user_usage(self) -> DataFrame:
        """Compute usage and efficiency per user."""
        facts = self._named(
            self.table("user_usage"),
            ("projects", "project_id", "project"),
            ("users", "user_id", "user", "fullname"),
        )
        return facts.select(
            "project",
            "user",
            "fullname",
            "date",
            "usage_cpu",
            "usage_wall",
            "usage_su",
            "efficiency",
        )

    def register_views(self, prefix: str = "") -> None:
        """Make every view available to SQL."""
        for name in VIEWS:
            getattr(self, name)().createOrReplaceTempView(f"{prefix}{name}")


# The views by name.
VIEWS = (
    "project_usage",
    "storage_grants",
    "storage_grants_latest",
    "system_queues",
    "user_storage",
    "total_user_storage",
    "usage_grants",
    "usage_grants_latest",
    "user_usage",
)


def _latest(grants: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the largest id of each group, without the id.

    The limit of one row a group runs before the shuffle as well as after it.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return grants.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth", "id")

"""Entry filters: owner, group, age and size.

Thresholds are signed. A value of zero or more asks for entries at or above it; a negative
value asks for entries at or below its absolute value. Every comparison drops rows whose
column is NULL, as SQL does.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import datetime
from numbers import Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemeter.functions.sizes import parse_size
from grovemeter.functions.times import parse_time

NEGATIONS = ("!", "-")


def signed_threshold(column: Column, value: Real) -> Column:
    return column <= F.lit(-value) if value < 0 else column >= F.lit(value)


@dataclass(frozen=True)
class EntryFilter:
    """Conditions an entry must meet; ``None`` means no condition."""

    gid: Real | None = None
    not_gid: Real | None = None
    uid: Real | None = None
    not_uid: Real | None = None
    mtime: Real | None = None
    size: Real | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, Real)):
                raise ValueError(f"{f.name} must be a number or None, not {value!r}")

    @property
    def is_empty(self) -> bool:
        return all(getattr(self, f.name) is None for f in fields(self))

    def conditions(self) -> list[Column]:
        found = []
        if self.gid is not None:
            found.append(F.col("gid") == F.lit(self.gid))
        if self.not_gid is not None:
            found.append(F.col("gid") != F.lit(self.not_gid))
        if self.uid is not None:
            found.append(F.col("uid") == F.lit(self.uid))
        if self.not_uid is not None:
            found.append(F.col("uid") != F.lit(self.not_uid))
        if self.mtime is not None:
            found.append(signed_threshold(F.col("mtime"), self.mtime))
        if self.size is not None:
            found.append(signed_threshold(F.col("size"), self.size))
        return found

    def apply(self, entries: DataFrame) -> DataFrame:
        for condition in self.conditions():
            entries = entries.where(condition)
        return entries


NO_FILTER = EntryFilter()


def split_negation(text: str) -> tuple[bool, str]:
    """``("!name" or "-name")`` to ``(True, "name")``, anything else to ``(False, text)``."""
    return (True, text[1:]) if text.startswith(NEGATIONS) else (False, text)


def resolve_name(table: DataFrame, name_column: str, id_column: str, name: str) -> int:
    """The id of ``name``; two rows at most reach the driver."""
    found = table.where(F.col(name_column) == name).select(F.min(id_column).alias("id")).head()
    if found["id"] is None:
        raise LookupError(f"unknown {name_column}: {name!r}")
    return found["id"]


def text_filter(
    *,
    user: str | None = None,
    group: str | None = None,
    mtime: str | None = None,
    size: str | None = None,
    users: DataFrame | None = None,
    groups: DataFrame | None = None,
    as_of: datetime | None = None,
) -> EntryFilter:
    """Build a filter from its text form: names, times such as ``1y6m``, sizes as ``-10mb``.

    Names become ids before the plan is built, so they reach the scan as plain comparisons
    on ``uid`` / ``gid`` instead of a join.
    """
    values: dict[str, Real] = {}
    if user is not None:
        negated, name = split_negation(user)
        values["not_uid" if negated else "uid"] = resolve_name(users, "user", "uid", name)
    if group is not None:
        negated, name = split_negation(group)
        values["not_gid" if negated else "gid"] = resolve_name(groups, "group", "gid", name)
    if mtime is not None:
        older = mtime.startswith("-")
        epoch = parse_time(mtime[1:] if mtime[:1] in ("-", "+") else mtime, as_of)
        values["mtime"] = -epoch if older else epoch
    if size is not None:
        values["size"] = parse_size(size)
    return EntryFilter(**values)


def check_roots(roots: Iterable) -> list[tuple[int, int]]:
    """Validate a root argument: a non-empty list of (device, inode) number pairs."""
    if isinstance(roots, (str, bytes)) or not isinstance(roots, Iterable):
        raise ValueError("roots must be a list of (device, inode) pairs")
    pairs = []
    for root in roots:
        if (
            not isinstance(root, (tuple, list))
            or len(root) != 2
            or any(isinstance(v, bool) or not isinstance(v, Real) for v in root)
        ):
            raise ValueError(f"not a (device, inode) pair: {root!r}")
        if any(v != int(v) for v in root):
            raise ValueError(f"device and inode are whole numbers: {root!r}")
        pairs.append((int(root[0]), int(root[1])))
    if not pairs:
        raise ValueError("at least one root is needed")
    return pairs


def non_root_rows(entries: DataFrame) -> DataFrame:
    """Entries that are not the top of a scan (a scan root is named by its absolute path)."""
    return entries.where(~F.col("basename").like("/%"))


def unreadable(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("mode").isNull())

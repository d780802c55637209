"""Hand-made and random trees, and a plain-Python account of what searches should return."""

from __future__ import annotations

import random

from grovemeter.schemas import ENTRY_COLUMNS, ENTRY_SCHEMA

DIR, FILE = 0o040755, 0o100644


def row(basename, inode, parent, device=1, mode=FILE, uid=10, gid=20, size=1, mtime=0.0,
        atime=None, scan_time=0.0, root=1):
    return dict(
        basename=basename, inode=inode, device=device, mode=mode, uid=uid, gid=gid, size=size,
        mtime=mtime, atime=mtime if atime is None else atime, scan_time=scan_time,
        root_inode=root, parent_inode=parent,
    )


def directory(basename, inode, parent, **values):
    return row(basename, inode, parent, **{"mode": DIR, **values})


def unreadable(basename, parent, **values):
    blank = dict(mode=None, uid=None, gid=None, size=None)
    made = row(basename, None, parent, **{**blank, **values})
    return {**made, "mtime": None, "atime": None}


def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(r[c] for c in ENTRY_COLUMNS) for r in rows], ENTRY_SCHEMA
    )


def random_forest(seed, devices=12, size=40):
    """One tree or more per device, with orphans, hard links and unreadable entries."""
    rng = random.Random(seed)
    rows = []
    for device in range(1, devices + 1):
        dirs = []
        number = 100
        for n in range(rng.randint(5, size)):
            number += 1
            kind = rng.random()
            common = dict(
                device=device, uid=rng.randint(1, 4), gid=rng.randint(1, 3),
                size=rng.randint(0, 5000), mtime=float(rng.randint(0, 1000)),
                root=dirs[0] if dirs else number,
            )
            if not dirs or kind < 0.04:
                rows.append(directory(f"/data/{number}", number, None, **common))
                dirs.append(number)
            elif kind < 0.08:
                rows.append(directory(f"lost{number}", number, 9_000_000 + number, **common))
                dirs.append(number)
            elif kind < 0.5:
                rows.append(directory(f"d{number}", number, rng.choice(dirs), **common))
                dirs.append(number)
            elif kind < 0.6:
                rows.append(unreadable(f"u{number}", rng.choice(dirs), device=device))
            elif kind < 0.7:
                files = [r["inode"] for r in rows if r["device"] == device and r["mode"] == FILE]
                inode = rng.choice(files) if files else number
                rows.append(row(f"h{number}", inode, rng.choice(dirs), **common))
            else:
                rows.append(row(f"f{number}", number, rng.choice(dirs), **common))
    rng.shuffle(rows)
    return rows


class Account:
    """Search results worked out one row at a time."""

    def __init__(self, rows):
        self.rows = rows
        self.inside = {}
        self.holding = {}
        for r in rows:
            if r["parent_inode"] is not None:
                self.inside.setdefault((r["device"], r["parent_inode"]), []).append(r)
            if r["inode"] is not None:
                self.holding.setdefault((r["device"], r["inode"]), []).append(r)

    def path(self, r):
        """Names up to the topmost known ancestor, preferring rows whose parent is known."""
        names = [r["basename"]]
        while r["parent_inode"] is not None:
            above = self.holding.get((r["device"], r["parent_inode"]))
            if not above:
                break
            r = max(above, key=self._preference)
            names.append(r["basename"])
        return "/".join(reversed(names))

    def _preference(self, r):
        known = (r["device"], r["parent_inode"]) in self.holding
        return (known, r["parent_inode"] is None)

    def search(self, roots):
        """(root number, row, path) of everything at or below the roots, repeats included."""
        for number, root in enumerate(roots):
            todo = [(r, self.path(r)) for r in self.holding.get(tuple(root), [])]
            while todo:
                r, path = todo.pop()
                yield number, r, path
                if r["inode"] is not None:
                    for child in self.inside.get((r["device"], r["inode"]), []):
                        todo.append((child, path + "/" + child["basename"]))

    def du(self, roots, passes=lambda r: True):
        totals = {n: [0, 0] for n in range(len(roots))}
        for number, r, _ in self.search(roots):
            if passes(r):
                totals[number][0] += r["size"] or 0
                totals[number][1] += 1
        return [tuple(totals[n]) for n in range(len(roots))]

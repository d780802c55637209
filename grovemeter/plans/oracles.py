"""The catalogue's queries in SQL, for a comparison in another engine.

Written straight from the semantics: recursive common table expressions walk the tree, and
nothing here shares code with the operators.
"""

from __future__ import annotations

INODE = """
inode AS MATERIALIZED (
  SELECT '/data/' || r_name AS basename, CAST(2 AS BIGINT) AS inode,
         CAST(r_regionkey + 1 AS BIGINT) AS device, CAST(16877 AS INTEGER) AS mode,
         CAST(0 AS INTEGER) AS uid, CAST(r_regionkey AS INTEGER) AS gid,
         CAST(4096 AS BIGINT) AS size, CAST(0 AS DOUBLE) AS mtime, CAST(0 AS DOUBLE) AS atime,
         CAST(0 AS DOUBLE) AS scan_time, CAST(2 AS BIGINT) AS root_inode,
         CAST(NULL AS BIGINT) AS parent_inode
  FROM region
  UNION ALL
  SELECT CASE WHEN n_nationkey = 7 THEN 'tmp' ELSE n_name END, 1000 + n_nationkey,
         n_regionkey + 1, 16877, 0, n_nationkey, 4096, 0, 0, 0, 2, 2
  FROM nation
  UNION ALL
  SELECT c_name, 1000000 + c_custkey, n_regionkey + 1, 16877, CAST(c_custkey AS INTEGER), c_nationkey,
         4096, 0, 0, 0, 2, 1000 + c_nationkey
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL
  SELECT 'order_' || o_orderkey, 1000000000 + o_orderkey, n_regionkey + 1, 16877, CAST(c_custkey AS INTEGER),
         c_nationkey, 4096, epoch(o_orderdate), epoch(o_orderdate), 0, 2, 1000000 + o_custkey
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL
  SELECT 'item_' || l_linenumber || '_' || l_partkey,
         CASE WHEN ok THEN 1000000000000 + l_orderkey * 16 + l_linenumber END, n_regionkey + 1,
         CASE WHEN ok THEN 33188 END, CASE WHEN ok THEN CAST(c_custkey AS INTEGER) END,
         CASE WHEN ok THEN c_nationkey END,
         CASE WHEN ok THEN CAST(l_quantity * 1048576 AS BIGINT) END,
         CASE WHEN ok THEN epoch(l_shipdate) END,
         CASE WHEN ok THEN epoch(l_shipdate) + 86400.0 * l_quantity END,
         0, 2, 1000000000 + l_orderkey
  FROM (SELECT *, NOT (l_linenumber = 1 AND l_discount = 0.0 AND l_orderkey % 7 = 0) AS ok
        FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
)"""

# The directories alone, few and narrow, so that no estimate makes a join build on all entries.
DIRS = """, dirs AS MATERIALIZED (SELECT device, inode, basename, uid, gid FROM inode WHERE mode = 16877) """

# Every entry below the five roots, with its path.
TREE = (
    INODE
    + """,
tree AS (
  SELECT *, basename AS path, 0 AS depth FROM inode WHERE inode = 2
  UNION ALL
  SELECT c.*, t.path || '/' || c.basename, t.depth + 1
  FROM inode c JOIN tree t ON c.parent_inode = t.inode AND c.device = t.device
)"""
)

# Every entry below every inode: (top_device, top_inode) names the start.
UNDER = (
    INODE
    + """,
under AS (
  SELECT device AS top_device, inode AS top_inode, * FROM inode WHERE inode IS NOT NULL
  UNION ALL
  SELECT u.top_device, u.top_inode, c.*
  FROM inode c JOIN under u ON c.parent_inode = u.inode AND c.device = u.device
)"""
)

OVERLAPPING = (
    INODE
    + """,
overlapping AS MATERIALIZED (
  SELECT basename, inode, device, mode, size, parent_inode FROM inode
  UNION ALL
  SELECT r.basename || '/' || n.basename, n.inode, n.device, n.mode, n.size, NULL
  FROM inode n JOIN inode r ON r.inode = 2 AND r.device = n.device
  WHERE n.parent_inode = 2
  UNION ALL
  SELECT basename, inode, device, mode, size, parent_inode FROM inode WHERE parent_inode <> 2
)"""
)

SHARED_KEYS = (
    INODE
    + """,
shared_keys AS MATERIALIZED (
  SELECT basename, inode, device, mode, size, parent_inode FROM inode
  UNION ALL
  SELECT basename || '.lnk', inode, device, 33188, 100, parent_inode FROM inode WHERE parent_inode = 2 AND mode = 16877
)"""
)


def totals_sql(relation: str, name: str, start: str) -> str:
    """Totals of all keys that pass ``start``, each by a walk of its own."""
    return f"""WITH RECURSIVE {relation},
        walk AS (
          SELECT device, inode AS top, inode, size FROM {name} WHERE (device, inode) IN
            (SELECT (device, inode) FROM {name} WHERE mode = 16877 AND {start})
          UNION ALL
          SELECT c.device, w.top, c.inode, c.size FROM {name} c JOIN walk w ON c.parent_inode = w.inode AND c.device = w.device
        )
        SELECT device, top AS inode, CAST(coalesce(SUM(size), 0) AS BIGINT) AS size, COUNT(*) AS inodes
        FROM walk GROUP BY device, top"""


UNREADABLE = (
    TREE
    + """,
spots AS (
  SELECT DISTINCT p.uid, p.gid, r.gid AS root_gid, p.basename, p.device, p.parent_inode, p.path
  FROM inode i
  JOIN tree p ON i.parent_inode = p.inode AND i.device = p.device
  JOIN inode r ON i.root_inode = r.inode AND i.device = r.device
  WHERE i.mode IS NULL
),
unreadable AS (SELECT uid, gid, root_gid, path FROM spots WHERE path NOT LIKE '%/tmp/%')"""
)

LATE_ITEM = "mtime <= 959817600 AND size >= 10485760 AND gid <> 3 AND uid <> 5"


def tree_sql(select: str) -> str:
    return f"WITH RECURSIVE {TREE} {select}"


def under_sql(select: str) -> str:
    return f"WITH RECURSIVE {UNDER} {select}"


def unreadable_sql(select: str) -> str:
    return f"WITH RECURSIVE {UNREADABLE} {select}"


def inode_sql(select: str) -> str:
    return f"WITH {INODE} {select}"


def found_sql(condition: str) -> str:
    return tree_sql(f"SELECT path FROM tree WHERE {condition}")


# The unit labels and the text of an empty total.
def pretty(size: str) -> str:
    cases = "".join(
        f" WHEN {size} >= {1024**n} THEN printf('%6.2f', {size} / {float(1024**n)!r}) || '{label}'"
        for n, label in reversed(list(enumerate(["B ", "KB", "MB", "GB", "TB"])))
    )
    return f"CASE WHEN {size} = 0 THEN '  0.00B '{cases} END"


def summary_sql(column: str, bins: list[tuple[str, int, int]]) -> str:
    """Bins as (label, months, days), young to old."""
    as_of = "TIMESTAMP '2001-10-31 12:00:00'"
    rows = []
    for n, (label, months, days) in enumerate(bins):
        hi = f"{as_of} - INTERVAL '{months} months' - INTERVAL '{days} days'"
        lo = "NULL"
        if n + 1 < len(bins):
            _, m, d = bins[n + 1]
            lo = f"{as_of} - INTERVAL '{m} months' - INTERVAL '{d} days'"
        rows.append(f"({n}, '{label}', {months}, {days}, CAST({lo} AS TIMESTAMP), {hi})")
    moment = f"make_timestamp(CAST({column} * 1000000 AS BIGINT))"
    return f"""{INODE},
bins(bin_ord, bin_label, months, days, lo, hi) AS (VALUES {", ".join(rows)}),
binned AS (
  SELECT * FROM inode JOIN bins ON (lo IS NULL OR {moment} >= lo) AND {moment} < hi
)"""


# The age bins.
CHANGE_BINS = [
    ("0 days", 0, 0),
    ("1 month", 1, 0),
    ("6 months", 6, 0),
    ("1 year", 12, 0),
    ("3 years", 36, 0),
]
ACCESS_BINS = [("0 days", 0, 0), ("60 days", 0, 60), ("90 days", 0, 90)]

SUMMARY_SELECT = """
SELECT root_inode, uid, gid, COUNT(*) AS inodes, CAST(SUM(size) AS BIGINT) AS size, bin_ord,
       bin_label, months, days, TIMESTAMP '2001-10-31 12:00:00' AS time
FROM binned GROUP BY root_inode, uid, gid, bin_ord, bin_label, months, days"""

ENTRY_LIST = (
    "basename, inode, device, mode, uid, gid, size, mtime, atime, scan_time, root_inode, "
    "parent_inode"
)

SIZE_TEXT = """
SELECT l_orderkey, l_linenumber, size_text,
       CAST(regexp_extract(lower(size_text), '^-?[0-9.]+') AS DOUBLE)
       * CASE WHEN lower(size_text) LIKE '%k%' THEN 1024.0
              WHEN lower(size_text) LIKE '%m%' THEN 1048576.0
              WHEN lower(size_text) LIKE '%g%' THEN 1073741824.0
              WHEN lower(size_text) LIKE '%t%' THEN 1099511627776.0
              ELSE 1.0 END AS bytes
FROM (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || CAST(l_quantity AS INTEGER)
         || CASE WHEN l_linestatus = 'F' THEN '.5' ELSE '' END
         || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'b' WHEN 3 THEN 'K' WHEN 4 THEN 'kb'
            WHEN 5 THEN 'MiB' WHEN 6 THEN 'g' WHEN 7 THEN 'Tb' END AS size_text
  FROM lineitem)"""

TIME_TEXT = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '-' || ltrim(text, '+') ELSE text END AS time_text,
       CASE WHEN o_orderstatus = 'F' THEN -epoch(moment) ELSE epoch(moment) END AS epoch
FROM (
  SELECT *,
    CASE o_orderkey % 12
      WHEN 0 THEN strftime(o_orderdate, '%Y')
      WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 3 THEN '1y' || (o_custkey % 30) || 'm'
      WHEN 4 THEN o_custkey || 'd12h'
      WHEN 5 THEN strftime(o_orderdate, '%Y-%m')
      WHEN 6 THEN strftime(o_orderdate, '%B %Y')
      WHEN 7 THEN strftime(o_orderdate, '%-d %b %Y')
      WHEN 8 THEN '+' || o_custkey || ' days'
      WHEN 9 THEN o_custkey || '.5d'
      WHEN 10 THEN o_custkey || 's'
      ELSE o_custkey || ' hours 30 minutes' END AS text,
    CASE
      WHEN o_orderkey % 12 = 0 THEN CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)
      WHEN o_orderkey % 12 IN (1, 2, 7) THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)
      WHEN o_orderkey % 12 IN (5, 6) THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)
      ELSE TIMESTAMP '2001-10-31 12:00:00' - CASE o_orderkey % 12
        WHEN 3 THEN to_months(CAST(12 + o_custkey % 30 AS INTEGER))
        WHEN 8 THEN to_days(CAST(o_custkey AS INTEGER))
        WHEN 10 THEN to_seconds(o_custkey)
        WHEN 11 THEN to_minutes(60 * o_custkey + 30)
        ELSE to_hours(24 * o_custkey + 12) END END AS moment
  FROM orders)"""

LISTING = r"""
WITH RECURSIVE bare AS (
  SELECT string_split(rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), '/') AS parts
  FROM pages
),
levels AS (
  SELECT DISTINCT parts[1:n] AS parts, n < len(parts) AS inner_level
  FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS n FROM bare)
)
SELECT array_to_string(parts, '/') AS path,
       CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') END AS parent_path,
       parts[len(parts)] AS basename,
       CAST(CASE WHEN bool_or(inner_level) THEN 16384 ELSE 32768 END AS INTEGER) AS mode
FROM levels GROUP BY parts"""

NOTICES = r"""
, people AS (
  SELECT uid, COUNT(*) AS n, string_agg('    chmod -R g+rX "' || path || '"', chr(10) ORDER BY path) AS commands
  FROM unreadable WHERE uid IS NOT NULL GROUP BY uid
)
SELECT coalesce(c_mktsegment, CAST(uid AS VARCHAR)) || ' <' || coalesce(c_name, CAST(uid AS VARCHAR))
         || '@example.org>' AS "to",
       'Storage use on the storage service for ' || coalesce(c_name, CAST(uid AS VARCHAR)) AS subject,
       'Hello ' || coalesce(c_mktsegment, CAST(uid AS VARCHAR)) || ',' || chr(10) || chr(10)
         || n || CASE WHEN n > 1 THEN ' directories' ELSE ' directory' END
         || ' of yours on the storage service cannot be read by the usage scan.' || chr(10) || chr(10)
         || CASE WHEN n < 5 THEN
              'If nothing below needs to stay private, please run:' || chr(10) || commands
            ELSE 'They are listed in /data/unreadable/' || coalesce(c_name, CAST(uid AS VARCHAR))
              || '.txt. If none needs to stay private, please run:' || chr(10)
              || '    xargs chmod -R g+rX < /data/unreadable/' || coalesce(c_name, CAST(uid AS VARCHAR)) || '.txt'
            END
         || chr(10) || chr(10) || 'Questions: storage-help@example.org' || chr(10) AS message
FROM people LEFT JOIN customer ON c_custkey = uid"""

STORAGE_GRANTS = """
storage AS MATERIALIZED (
  SELECT o_orderkey AS id, s_name AS project, r_name AS system,
         CASE o_orderkey % 2 WHEN 0 THEN '/data' ELSE '/scratch' END AS storagepoint,
         o_orderpriority AS scheme, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(quarter(o_orderdate) AS INTEGER) AS quarter, o_orderdate AS date,
         o_totalprice AS capacity, o_orderkey * 1000 AS inodes
  FROM orders JOIN supplier ON s_suppkey = o_custkey % 10
  JOIN region ON r_regionkey = o_custkey % 5
)"""

USER_STORAGE = """
storage AS (
  SELECT s_name AS project, c_name AS "user", c_mktsegment AS fullname,
         CASE l_linenumber % 2 WHEN 0 THEN '/data' ELSE '/scratch' END AS storagepoint,
         'dir_' || l_partkey AS folder,
         CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS scandate,
         CAST(l_linenumber AS BIGINT) AS inodes, CAST(l_quantity * 1048576 AS BIGINT) AS size
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
)"""


def oracle_sql() -> dict[str, str]:
    entry = "device, parent_inode, basename"
    total = "CAST(coalesce(SUM(size), 0) AS BIGINT) AS size, COUNT(*) AS inodes"
    late = f"FILTER (WHERE {LATE_ITEM})"
    late_total = (
        f"CAST(coalesce(SUM(u.size) {late}, 0) AS BIGINT) AS size, COUNT(*) {late} AS inodes"
    ).replace("mtime", "u.mtime").replace("size >=", "u.size >=").replace("gid", "u.gid").replace("uid", "u.uid").replace("u.u.", "u.")
    directory_totals = """
      SELECT d.device, d.inode, {total}, min(t.path) AS path
      FROM inode d
      JOIN under u ON u.top_device = d.device AND u.top_inode = d.inode
      JOIN tree t ON t.device = d.device AND t.inode = d.inode
      WHERE d.mode = 16877 GROUP BY d.device, d.inode"""
    tree_and_under = UNDER + TREE[len(INODE):]
    all_total = "CAST(SUM(u.size) AS BIGINT) AS size, COUNT(*) AS inodes"
    return {
        "ingest_scan_csv": inode_sql(f"SELECT {ENTRY_LIST} FROM inode"),
        "snapshot_refresh": inode_sql(
            f"SELECT {ENTRY_LIST.replace('scan_time', 'CAST(1 AS DOUBLE) AS scan_time')} FROM inode"
        ),
        "inodes_from_listing": LISTING,
        "directory_index": tree_sql(
            """SELECT t.device, t.inode, t.path, t.depth, COUNT(c.device) AS entries,
               CAST(SUM(c.size) AS BIGINT) AS bytes
               FROM tree t LEFT JOIN inode c ON c.parent_inode = t.inode AND c.device = t.device
               WHERE t.mode = 16877 GROUP BY t.device, t.inode, t.path, t.depth"""
        ),
        "inode_path": tree_sql(f"SELECT {entry}, path FROM tree"),
        "path_string_agg": tree_sql("SELECT device, inode, path FROM tree WHERE mode = 16877"),
        "select_roots": inode_sql(
            """, roots(root_id, device, inode) AS (VALUES (0, 1, 2), (1, 2, 2), (2, 3, 2),
                 (3, 4, 2), (4, 5, 2), (5, 1, 2), (6, 2, 2))
               SELECT CAST(root_id AS BIGINT) AS root_id, i.device, i.inode, basename
               FROM inode i JOIN roots r ON r.device = i.device AND r.inode = i.inode"""
        ),
        "descendants": tree_sql(f"SELECT {entry}, inode, mode, uid, gid, size, mtime, path FROM tree"),
        "find": found_sql("TRUE"),
        "first_inode": tree_sql(
            """SELECT r.basename IS NOT NULL AS has_root, p.basename IS NOT NULL AS has_parent,
                      t.path IS NOT NULL AS has_path
               FROM tree t
               LEFT JOIN inode p ON p.inode = t.parent_inode AND p.device = t.device
               LEFT JOIN inode r ON r.inode = t.root_inode AND r.device = t.device
               WHERE t.basename NOT LIKE '/%' LIMIT 1"""
        ),
        "inode_parent": inode_sql(
            DIRS
            + """SELECT i.device, i.parent_inode, i.basename, p.basename AS parent_basename,
                      p.uid AS parent_uid, p.gid AS parent_gid
               FROM inode i LEFT JOIN dirs p ON p.inode = i.parent_inode AND p.device = i.device"""
        ),
        "inode_root": inode_sql(
            DIRS
            + """SELECT i.device, i.parent_inode, i.basename, r.basename AS root_basename,
                      r.gid AS root_gid
               FROM inode i LEFT JOIN dirs r ON r.inode = i.root_inode AND r.device = i.device"""
        ),
        "duplicate_dirs": f"""WITH {OVERLAPPING}
            SELECT device, inode, COUNT(*) AS copies FROM overlapping
            WHERE mode = 16877 GROUP BY device, inode HAVING COUNT(*) > 1""",
        "filter_gid": found_sql("gid = 3"),
        "filter_not_gid": found_sql("gid <> 3"),
        "filter_uid": found_sql("uid = 0"),
        "filter_not_uid": found_sql("uid <> 0"),
        "filter_mtime_newer": found_sql("mtime >= epoch(TIMESTAMP '1999-01-01')"),
        "filter_mtime_older": found_sql("mtime <= epoch(TIMESTAMP '1999-01-01')"),
        "filter_size_min": found_sql("size >= 16777216"),
        "filter_size_max": found_sql("size <= 16777216"),
        "find_filtered": found_sql(LATE_ITEM),
        "filter_by_name": found_sql(
            """uid <> (SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000001')
               AND gid <> (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')
               AND mtime >= epoch(TIMESTAMP '2001-10-31 12:00:00' - INTERVAL '42 months')
               AND size >= 10485760"""
        ),
        "size_text_to_bytes": SIZE_TEXT,
        "mtime_text": TIME_TEXT,
        "non_root_rows": inode_sql(f"SELECT {entry} FROM inode WHERE basename NOT LIKE '/%'"),
        "du": tree_sql(f"SELECT {total} FROM tree"),
        "du_filtered": tree_sql(f"SELECT {total} FROM tree WHERE {LATE_ITEM}"),
        "du_overlapping_scans": f"""WITH RECURSIVE {OVERLAPPING},
            walk AS (
              SELECT * FROM overlapping WHERE inode = 2
              UNION ALL
              SELECT c.* FROM overlapping c
              JOIN walk w ON c.parent_inode = w.inode AND c.device = w.device
            )
            SELECT {total} FROM walk""",
        "find_overlapping_scans": f"""WITH RECURSIVE {OVERLAPPING},
            walk AS (
              SELECT *, basename AS path FROM overlapping WHERE inode = 2
              UNION ALL
              SELECT c.*, w.path || '/' || c.basename FROM overlapping c
              JOIN walk w ON c.parent_inode = w.inode AND c.device = w.device
            )
            SELECT path FROM walk""",
        "all_dir_usage_overlapping": totals_sql(OVERLAPPING, "overlapping", "TRUE"),
        "du_shared_keys": totals_sql(SHARED_KEYS, "shared_keys", "parent_inode = 2"),
        "all_dir_usage_shared_keys": totals_sql(SHARED_KEYS, "shared_keys", "TRUE"),
        "du_report_mounts": tree_sql(
            f"""SELECT {pretty('size')} || ', ' || printf('%8d', inodes) || ' files, ' || root || '/' AS line
                FROM (SELECT string_split(path, '/')[3] AS name, '/data/' || name AS root,
                             CAST(SUM(size) AS BIGINT) AS size, COUNT(*) AS inodes
                      FROM tree GROUP BY name)"""
        ),
        "du_per_root": tree_sql(
            f"SELECT device, CAST(2 AS BIGINT) AS inode, {total} FROM tree GROUP BY device"
        ),
        "du_report": tree_sql(
            f"""SELECT {pretty('size')} || ', ' || printf('%8d', inodes) || ' files, ' || root || '/' AS line
                FROM (SELECT string_split(path, '/')[3] AS name, '/data/' || name AS root,
                             CAST(SUM(size) AS BIGINT) AS size, COUNT(*) AS inodes
                      FROM tree WHERE size <= 16777216 GROUP BY name)"""
        ),
        "children_usage": under_sql(
            """, totals AS (
                 SELECT top_device, top_inode, SUM(size) AS size, COUNT(*) AS inodes
                 FROM under GROUP BY top_device, top_inode)
               SELECT i.device, i.parent_inode, i.inode, i.basename,
                      CAST(coalesce(t.size, 0) AS BIGINT) AS size, coalesce(t.inodes, 0) AS inodes,
                      coalesce(i.mode = 16877, FALSE) AS is_directory
               FROM inode i
               LEFT JOIN totals t ON t.top_device = i.device AND t.top_inode = i.inode
               WHERE i.parent_inode IS NOT NULL"""
        ),
        "children_usage_sorted": under_sql(
            f"""SELECT d.device, d.basename, {late_total}, TRUE AS is_directory
                FROM inode d JOIN under u ON u.top_device = d.device AND u.top_inode = d.inode
                WHERE d.parent_inode = 2 GROUP BY d.device, d.basename"""
        ),
        "all_dir_usage": f"WITH RECURSIVE {tree_and_under} {directory_totals.format(total=all_total)}",
        "all_dir_usage_filtered": f"WITH RECURSIVE {tree_and_under} {directory_totals.format(total=late_total)}",
        "top_directories": f"""WITH RECURSIVE {tree_and_under}
            SELECT path, size, inodes FROM ({directory_totals.format(total=all_total)})
            ORDER BY size DESC, path LIMIT 20""",
        "pretty_size": f"""SELECT l_orderkey, l_linenumber, size, {pretty('size')} AS size_text
            FROM (SELECT *, CAST(l_quantity AS BIGINT) * l_partkey
                            * CAST(power(16, l_linenumber) AS BIGINT) AS size FROM lineitem)""",
        "age_history": f"WITH {summary_sql('mtime', CHANGE_BINS)} {SUMMARY_SELECT}",
        "access_history": f"WITH {summary_sql('atime', ACCESS_BINS)} {SUMMARY_SELECT}",
        "age_bins": f"""WITH {summary_sql('mtime', CHANGE_BINS)}
            SELECT bin_ord, bin_label, months, days, lo, hi, COUNT(*) AS inodes,
                   CAST(SUM(size) AS BIGINT) AS size
            FROM binned GROUP BY bin_ord, bin_label, months, days, lo, hi""",
        "unreadable_dirs": unreadable_sql("SELECT uid, gid, root_gid, path FROM unreadable"),
        "unreadable_by_user": unreadable_sql(
            """SELECT uid, path, COUNT(*) OVER (PARTITION BY uid) AS count
               FROM unreadable WHERE uid IS NOT NULL"""
        ),
        "unreadable_path_lists": unreadable_sql(
            """SELECT coalesce(c_name, CAST(uid AS VARCHAR)) AS username, path
               FROM unreadable LEFT JOIN customer ON c_custkey = uid WHERE uid IS NOT NULL"""
        ),
        "unreadable_notices": unreadable_sql(NOTICES),
        "project_usage": """
            SELECT s_name AS project, r_name AS system, n_name AS queue, l_shipdate AS date,
                   l_discount AS usage_cpu, l_quantity AS usage_wall, l_extendedprice AS usage_su
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
            JOIN nation ON n_nationkey = l_partkey % 25
            JOIN region ON r_regionkey = n_regionkey
            WHERE NOT (l_discount = 0.0)""",
        "storage_grants": f"WITH {STORAGE_GRANTS} SELECT * FROM storage",
        "storage_grants_latest": f"""WITH {STORAGE_GRANTS}
            SELECT g.project, g.system, g.storagepoint, g.scheme, g.year, g.quarter, g.date,
                   g.capacity, g.inodes
            FROM storage g JOIN (
              SELECT max(id) AS id FROM storage
              GROUP BY project, system, storagepoint, scheme, quarter) x ON g.id = x.id""",
        "system_queues": """
            SELECT r_name AS system, n_name AS queue,
                   CAST(1.0 + n_nationkey % 4 AS DOUBLE) AS chargeweight
            FROM nation JOIN region ON r_regionkey = n_regionkey""",
        "user_storage": f"WITH {USER_STORAGE} SELECT * FROM storage",
        "total_user_storage": f"""WITH {USER_STORAGE}
            SELECT project, "user", fullname, storagepoint, scandate,
                   CAST(SUM(inodes) AS BIGINT) AS inodes, CAST(SUM(size) AS BIGINT) AS size
            FROM storage GROUP BY project, "user", fullname, storagepoint, scandate""",
        "usage_grants": f"""WITH {STORAGE_GRANTS}
            SELECT id, project, system, scheme, year, quarter, date, capacity AS allocation
            FROM storage""",
        "usage_grants_latest": f"""WITH {STORAGE_GRANTS}
            SELECT g.project, g.system, g.scheme, g.year, g.quarter, g.date,
                   g.capacity AS allocation
            FROM storage g JOIN (
              SELECT max(id) AS id FROM storage
              GROUP BY project, system, scheme, quarter) x ON g.id = x.id""",
        "user_usage": """
            SELECT s_name AS project, c_name AS "user", c_mktsegment AS fullname,
                   l_shipdate AS date, l_discount AS usage_cpu, l_quantity AS usage_wall,
                   l_extendedprice AS usage_su, l_discount / l_quantity AS efficiency
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey
            JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey""",
    }

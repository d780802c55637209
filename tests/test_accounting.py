from datetime import datetime

import pytest

from grovemeter.plans.accounting import VIEWS, Accounting

DAY = datetime(2024, 1, 1)


@pytest.fixture
def accounting(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Accounting(
        {
            "projects": table([(1, "p1"), (2, "p2")], "id int, project string"),
            "systems": table([(1, "s1")], "id int, system string"),
            "system_queues": table(
                [(1, 1, "normal", 1.0), (2, 9, "orphan", 3.0)],
                "id int, system_id int, queue string, chargeweight double",
            ),
            "project_usage": table(
                [
                    (1, 1, DAY, 1.0, 2.0, 3.0),
                    (1, 1, DAY, 0.0, 2.0, 3.0),
                    (1, 1, DAY, -0.0, 2.0, 3.0),
                    (1, 1, DAY, None, 2.0, 3.0),
                    (1, 1, DAY, float("nan"), 2.0, 3.0),
                    (9, 1, DAY, 1.0, 2.0, 3.0),
                    (1, 2, DAY, 1.0, 2.0, 3.0),
                ],
                "project_id int, systemqueue_id int, date timestamp, usage_cpu double, "
                "usage_wall double, usage_su double",
            ),
            "schemes": table([(1, "merit")], "id int, scheme string"),
            "quarters": table([(1, 2023, 1), (2, 2024, 1), (3, 2024, 2)], "id int, year int, quarter int"),
            "storage_points": table([(1, "/data")], "id int, storagepoint string"),
            "storage_grants": table(
                [
                    (10, 1, 1, 1, 1, 1, DAY, 5.0, 50),
                    (11, 1, 1, 1, 2, 1, DAY, 6.0, 60),
                    (12, 1, 1, 1, 3, 1, DAY, 7.0, 70),
                    (13, 9, 1, 1, 3, 1, DAY, 8.0, 80),
                ],
                "id long, project_id int, system_id int, scheme_id int, quarter_id int, "
                "storagepoint_id int, date timestamp, capacity double, inodes long",
            ),
            "usage_grants": table(
                [(1, 1, 1, 1, 1, DAY, 5.0), (2, 1, 1, 1, 2, DAY, 6.0), (3, 2, 1, 1, 2, DAY, 7.0)],
                "id long, project_id int, system_id int, scheme_id int, quarter_id int, "
                "date timestamp, allocation double",
            ),
            "users": table([(5, "ann", "Ann A")], "id long, user string, fullname string"),
            "user_storage": table(
                [
                    (1, 5, 1, "a", DAY, 1, 10),
                    (1, 5, 1, "b", DAY, 2, 20),
                    (2, 5, 1, "a", DAY, 4, 40),
                    (1, 6, 1, "a", DAY, 8, 80),
                ],
                "project_id int, user_id long, storagepoint_id int, folder string, "
                "scandate timestamp, inodes long, size long",
            ),
            "user_usage": table(
                [(1, 5, DAY, 1.0, 2.0, 3.0, 0.5), (1, None, DAY, 1.0, 2.0, 3.0, 0.5)],
                "project_id int, user_id long, date timestamp, usage_cpu double, "
                "usage_wall double, usage_su double, efficiency double",
            ),
        }
    )


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def check(accounting):
    usage = accounting.project_usage()
    assert rows(usage, "project", "queue", "usage_cpu") == [
        ("p1", "normal", 1.0), ("p1", "normal", pytest.approx(float("nan"), nan_ok=True)),
    ]
    assert rows(accounting.storage_grants(), "id", "year", "quarter") == [
        (10, 2023, 1), (11, 2024, 1), (12, 2024, 2),
    ]
    # The year is not part of the key, so 2024 replaces 2023 for quarter 1.
    assert rows(accounting.storage_grants_latest(), "year", "quarter", "capacity") == [
        (2024, 1, 6.0), (2024, 2, 7.0),
    ]
    assert rows(accounting.usage_grants(), "id", "project") == [(1, "p1"), (2, "p1"), (3, "p2")]
    assert rows(accounting.usage_grants_latest(), "project", "allocation") == [("p1", 6.0), ("p2", 7.0)]
    assert rows(accounting.system_queues(), "queue", "chargeweight") == [("normal", 1.0)]
    assert rows(accounting.user_storage(), "project", "user", "folder", "size") == [
        ("p1", "ann", "a", 10), ("p1", "ann", "b", 20), ("p2", "ann", "a", 40),
    ]
    assert rows(accounting.total_user_storage(), "project", "fullname", "inodes", "size") == [
        ("p1", "Ann A", 3, 30), ("p2", "Ann A", 4, 40),
    ]
    assert rows(accounting.user_usage(), "user", "efficiency") == [("ann", 0.5)]


def test_views(accounting):
    check(accounting)


def test_views_at_scale(accounting, at_scale):
    check(accounting)


def test_views_are_open_to_sql(spark, accounting):
    accounting.register_views("acct_")
    assert spark.sql("SELECT sum(size) FROM acct_total_user_storage").head()[0] == 70
    assert {t.name for t in spark.catalog.listTables()} >= {f"acct_{v}" for v in VIEWS}

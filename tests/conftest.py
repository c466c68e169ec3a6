import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from drillsight.session import build_session

    session = build_session(
        "drillsight-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def views(spark):
    from drillsight.views import Views

    return Views(spark, SMALL)


@pytest.fixture
def apply(spark):
    """Apply a column expression to rows of texts: ``apply(f, (a, b), (c, d))`` lists the results."""
    from pyspark.sql import functions as F

    def run(f, *rows, types=None):
        width = len(rows[0])
        schema = ", ".join(f"c{i} {(types or ['string'] * width)[i]}" for i in range(width))
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, {schema}")
        out = df.select("n", f(*[F.col(f"c{i}") for i in range(width)]).alias("x"))
        return [r["x"] for r in out.orderBy("n").collect()]

    return run


@pytest.fixture
def star(spark):
    """A small star with every edge the reports have; see the tests for what it holds."""
    import datetime as dt

    from drillsight import schemas

    def at(day, hour=12, minute=0, month=1):
        return dt.datetime(2024, month, day, hour, minute)

    recipients = spark.createDataFrame(
        [
            (1, "Ann", "Zed", "ann@x.com", " Sales ", "Dev", False, None),
            (2, None, "Young", "y@x.com", "Sales", None, True, '{"location":"Rome"}'),
            (3, "", "", "three@x.com", "", "Ops", False, None),
            (4, "Dan", None, None, None, "Ops", True, "broken"),
            (5, "Eve", "Xu", "", "  ", None, False, None),
            (6, "Fay", "West", "fay@x.com", "IT", None, False, None),
        ],
        schemas.RECIPIENTS,
    )
    campaigns = spark.createDataFrame(
        [
            (10, "B", "low", None, at(1)),
            (20, "A", "high", "training", at(2)),
            (30, "C", None, None, at(3)),
        ],
        schemas.CAMPAIGNS,
    )
    links = spark.createDataFrame(
        [
            (101, 10, 1, "k101", at(1)),
            (102, 20, 1, "k102", at(2)),
            (103, 10, 2, "k103", at(1)),
            (104, 20, 3, "k104", at(2)),
            (105, 10, 4, "k105", at(1)),
            (106, 20, 5, "k106", at(2)),
        ],
        schemas.LINKS,
    )
    chrome = "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537"
    events = spark.createDataFrame(
        [
            ("1", 101, "click", "1.1.1.1", "old", at(1, 23, 30)),
            ("2", 101, "click", "1.1.1.2", chrome, at(2, 0, 30)),
            ("3", 101, "click", "1.1.1.1", None, at(2, 0, 10)),
            ("4", 103, "click", "1.1.1.1", chrome, at(5)),
            ("5", 103, "click", "1.1.1.1", "tie, larger id", at(5)),
            ("6", 104, "click", "1.1.1.3", "", at(5)),
            ("7", 105, "click", "1.1.1.3", "", at(5)),
            ("8", 999, "click", "1.1.1.3", "", at(5)),
        ],
        schemas.LINK_EVENTS,
    )
    departments = spark.createDataFrame([("HR",), ("IT",)], "name string")
    from types import SimpleNamespace

    return SimpleNamespace(
        recipients=recipients, campaigns=campaigns, links=links, events=events, departments=departments, at=at
    )

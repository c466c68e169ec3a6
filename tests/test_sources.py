"""Files read and written."""

import csv
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from drillsight.operators.aggregates import recipient_engagement
from drillsight.session import shared_dir, shared_root, stage
from drillsight.sources import articles, click_log, database, export, roster


def created(done):
    return sorted((r["email"], r["first_name"], r["last_name"], r["job_title"]) for r in done.created.collect())


def refused(done):
    return sorted((r["email"], r["error"]) for r in done.refused.collect())


def test_roster_csv(spark, star, tmp_path):
    (tmp_path / "r.csv").write_text(
        "first_name,last_name,email,job_title\nAnn,Zed, A@X.com ,Dev\n\n,,,\nAnn,Zed,a@x.com,Dev\nOld,Hand,ANN@x.com,\n"
    )
    done = roster.import_roster(roster.read_roster_csv(spark, str(tmp_path)), star.recipients)
    assert created(done) == [("a@x.com", "Ann", "Zed", "Dev")]
    assert refused(done) == [("", "Missing email"), ("a@x.com", "Email already exists"), ("ann@x.com", "Email already exists")]
    assert tuple(done.summary().first()) == (1, 3)
    assert done.created.first()["id"] == 7
    both = roster.append_created(star.recipients, done.created)
    assert both.count() == 7 and both.filter("id = 7").first()["high_risk"] is False


@pytest.mark.parametrize("multi_line", [True, False])
def test_roster_quotes_headers_and_first_row_wins(spark, star, tmp_path, multi_line):
    (tmp_path / "r.csv").write_text(
        'email,firstName,first_name,lastName,department\n'
        'q@x.com,,Snake,"O""Neil, Jr"," R&D "\n'
        'q@x.com,Later,,x,\n'
        'r@x.com,Camel,Snake,,\n'
    )
    done = roster.import_roster(roster.read_roster_csv(spark, str(tmp_path), multi_line), star.recipients)
    assert created(done) == [("q@x.com", "Snake", 'O"Neil, Jr', ""), ("r@x.com", "Camel", "", "")]
    assert {r["email"]: r["department"] for r in done.created.collect()} == {"q@x.com": "R&D", "r@x.com": ""}


def test_roster_line_breaks_in_fields(spark, star, tmp_path):
    (tmp_path / "r.csv").write_text('email,department\n"a@y.com","two\nlines"\nb@y.com,one\n')
    rows = roster.read_roster_csv(spark, str(tmp_path))
    assert sorted((r["email"], r["department"]) for r in rows.collect()) == [("a@y.com", "two\nlines"), ("b@y.com", "one")]


def test_first_row_wins_across_files_and_splits(spark, star, tmp_path):
    """Many small files and splits: the earlier file wins, and within it the earlier row."""
    for n in range(5):
        lines = [f"p{i}@x.com,file{n} row{i}" for i in range(400)] + [f"p{i}@x.com,later{n}" for i in range(400)]
        (tmp_path / f"part-{n}.csv").write_text("email,firstName\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = roster.read_roster_csv(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 5
        done = roster.import_roster(rows, star.recipients)
        assert sorted((r["email"], r["first_name"]) for r in done.created.collect()) == sorted(
            (f"p{i}@x.com", f"file0 row{i}") for i in range(400)
        )
        assert done.refused.count() == 5 * 800 - 400
        assert sorted(r["id"] for r in done.created.collect()) == list(range(7, 407))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_roster_scan(star):
    got = roster.scan_roster(star.recipients).collect()
    assert [r["id"] for r in got] == [4, 3, 6, 5, 2, 1]
    by_id = {r["id"]: r for r in got}
    assert by_id[2]["profile"]["location"] == "Rome" and by_id[4]["profile"] is None
    assert [by_id[i]["highRisk"] for i in (1, 2)] == [False, True]


def test_click_log(spark, tmp_path):
    line = {"linkId": "a", "at": "2024-01-01T23:59:59.250Z", "ua": "", "ref": None, "ipHash": "h"}
    other = {**line, "linkId": "b", "at": "2024-01-02T00:00:00.000Z"}
    broken_time = {**line, "at": "yesterday"}
    text = "\n".join([json.dumps(line), "not json", "", "null", "5", "[]", '{"at":"x"}', json.dumps(other), '{"linkId": "a"', json.dumps(broken_time)])
    (tmp_path / "clicks.ndjson").write_text(text + "\n")
    log = click_log.read_click_log(spark, str(tmp_path))
    assert log.count() == 3
    got = sorted((r["link_key"], r["clicked_at"]) for r in log.filter("clicked_at is not null").collect())
    assert got == [("a", dt.datetime(2024, 1, 1, 23, 59, 59, 250000)), ("b", dt.datetime(2024, 1, 2))]
    assert click_log.read_click_log(spark, str(tmp_path), "b").count() == 1


def test_click_log_append(spark, tmp_path):
    path = str(tmp_path / "log")
    clicks = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5), None, None, "h")],
        "link_key string, clicked_at timestamp_ntz, ua string, ref string, ip_hash string",
    )
    click_log.append_click_log(clicks, path)
    click_log.append_click_log(clicks, path)
    got = click_log.read_click_log(spark, path).collect()
    assert [tuple(r) for r in got] == [("a", dt.datetime(2024, 1, 1, 5), "", None, "h")] * 2


def test_clicks_from_requests(spark):
    requests = spark.createDataFrame([("a", " 9.9.9.9 , 1", "2.2.2.2")], "link_key string, forwarded string, remote string")
    row = click_log.clicks_from_requests(requests).first()
    want = spark.range(1).select(F.sha2(F.lit("9.9.9.9"), 256)).first()[0]
    assert row.asDict() == {"link_key": "a", "ip_hash": want}


def test_link_map(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"a": {"url": "u", "name": None}, "b": {"url": "v", "name": "n"}}, indent=2))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    got = click_log.read_link_map(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", "u", None), ("b", "v", "n")]


def test_articles(spark, tmp_path):
    article = {"title": "t", "url": "u", "publishedAt": "p", "source": {"id": 1, "name": "s"}, "urlToImage": None, "description": "d"}
    (tmp_path / "news.json").write_text(json.dumps({"status": "ok", "articles": [article, {**article, "source": None}]}) + "\n" + json.dumps({"articles": []}) + "\n")
    got = articles.read_articles(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("t", "u", "p", "s", None, "d"), ("t", "u", "p", None, None, "d")]


def test_engagement_csv(spark, star, tmp_path):
    people = star.recipients.withColumn("department", F.lit('a "quoted", b'))
    path = str(tmp_path / "out")
    export.write_engagement_csv(recipient_engagement(people, star.links, star.campaigns, star.events), path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == ",".join(export.HEADER)
    assert lines[-1] == '"Ann","Zed","ann@x.com","a ""quoted"", b","Dev","A; B","B",3,"2024-01-01","2024-01-02"'
    rows = list(csv.DictReader(lines))
    assert [r["lastName"] for r in rows] == sorted(r["lastName"] for r in rows) and len(rows) == 6


def test_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second and first.startswith(root + "/x-")
    kept = stage(spark.range(3), "numbers")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    assert kept.inputFiles()


def test_database_reader_asks_for_ranges(monkeypatch):
    """No database runs here, so this looks at what is asked of Spark."""
    calls = []

    class Reader:
        def __init__(self):
            self.set = {}

        def format(self, name):
            self.set["format"] = name
            return self

        def options(self, **more):
            self.set.update(more)
            return self

        def option(self, key, value):
            self.set[key] = value
            return self

        def load(self):
            calls.append(self.set)
            return self

        def first(self):
            return {"lo": 3, "hi": 90}

    class Session:
        @property
        def read(self):
            return Reader()

    database.read_table(Session(), "jdbc:x", "links", "u", "p", partitions=4)
    limits, table = calls
    assert limits["query"] == "select min(id) as lo, max(id) as hi from links" and "dbtable" not in limits
    assert "query" not in table
    assert {k: table[k] for k in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")} == {
        "dbtable": "links", "partitionColumn": "id", "lowerBound": 3, "upperBound": 91, "numPartitions": 4,
    }

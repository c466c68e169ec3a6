"""The two long paths: clicks in and reports out, rosters in and the export out."""

import csv
import datetime as dt

from pyspark.sql import functions as F

from drillsight.operators import aggregates, joins, merge
from drillsight.sources import click_log, export, roster
from drillsight.streaming import clicks as streams

AT = dt.datetime(2024, 5, 1)


def test_from_upload_to_export(spark, star, tmp_path):
    """Upload a roster, link everyone to two campaigns, click, and export."""
    (tmp_path / "in.csv").write_text(
        "firstName,lastName,email,department,jobTitle\n"
        "Gus,Able,gus@x.com,IT,Dev\nHal,Baker, HAL@x.com ,IT,Dev\nNo,Mail,,,\nAnn,Zed,ann@x.com,,\n"
    )
    done = roster.import_roster(roster.read_roster_csv(spark, str(tmp_path / "in.csv")), star.recipients)
    assert tuple(done.summary().first()) == (2, 2)
    people = roster.append_created(star.recipients, done.created)

    created = done.created
    asked = created.select((2 * F.col("id")).alias("seq"), F.lit(10).cast("long").alias("campaign_id"), F.col("id").alias("recipient_id"))
    asked = asked.unionByName(
        created.select((2 * F.col("id") + 1).alias("seq"), F.lit(20).cast("long").alias("campaign_id"), F.col("id").alias("recipient_id"))
    )
    links = merge.assign_links(star.links, asked, "salt", AT)
    new = {(r["campaign_id"], r["recipient_id"]): r for r in links.filter("is_new").collect()}
    assert sorted(new) == [(10, 7), (10, 8), (20, 7), (20, 8)]

    gus = new[(20, 7)]
    requests = spark.createDataFrame(
        [(1, gus["tracking_id"], "8.8.8.8, 1.1.1.1", "2.2.2.2", "agent", dt.datetime(2024, 5, 2)),
         (2, gus["tracking_id"], None, "2.2.2.2", None, dt.datetime(2024, 5, 3)),
         (3, "nobody", None, "2.2.2.2", None, dt.datetime(2024, 5, 3))],
        "event_id long, link_key string, forwarded string, remote string, ua string, clicked_at timestamp_ntz",
    )
    db_links = links.select(F.col("tracking_id").alias("link_key"), F.col("id").alias("link_id"))
    no_files = spark.createDataFrame([], "link_key string, url string, name string")
    rows = click_log.event_rows(joins.by_source_priority(requests, no_files, db_links))
    assert sorted((r["id"], r["ip_address"], r["user_agent"]) for r in rows.collect()) == [
        ("1", "8.8.8.8, 1.1.1.1", "agent"), ("2", "2.2.2.2", ""),
    ]
    events = star.events.unionByName(rows)

    report = aggregates.recipient_engagement(people, links, star.campaigns, events)
    out = tmp_path / "out"
    export.write_engagement_csv(report, str(out))
    lines = "".join(p.read_text() for p in sorted(out.glob("part-*"))).splitlines()
    by_email = {r["email"]: r for r in csv.DictReader(lines)}
    assert by_email["gus@x.com"] == {
        "firstName": "Gus", "lastName": "Able", "email": "gus@x.com", "department": "IT", "jobTitle": "Dev",
        "campaigns_targeted": "A; B", "campaigns_clicked": "A", "total_clicks": "2",
        "first_click_date": "2024-05-02", "last_click_date": "2024-05-03",
    }
    assert by_email["hal@x.com"]["total_clicks"] == "0"


def test_from_click_to_report(spark, star, tmp_path):
    """Clicks arrive as files, are resolved and stored by a stream, and show in the reports."""
    arriving = tmp_path / "arriving"
    requests = spark.createDataFrame(
        [(n, key, dt.datetime(2024, 5, 1 + n), None, "9.9.9.9", "ua", None)
         for n, key in enumerate(["k102", "k102", "file", "gone", "k104"])],
        "event_id long, link_key string, clicked_at timestamp_ntz, forwarded string, remote string, ua string, ref string",
    )
    requests.repartition(3).write.parquet(str(arriving))
    files = spark.createDataFrame([("file", "u", "n"), ("k104", "v", "m")], "link_key string, url string, name string")
    db_links = star.links.select(F.col("tracking_id").alias("link_key"), F.col("id").alias("link_id"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(arriving))
    out = str(tmp_path / "out")
    streams.finish(streams.store_clicks(stream, files, db_links, out, str(tmp_path / "cp")))

    stored = spark.read.schema(
        "event_id long, link_key string, clicked_at timestamp_ntz, forwarded string, remote string, ua string, ref string, "
        "url string, name string, link_id long, source string, batch long, status string, day date"
    ).parquet(out)
    assert stored.filter("status = 'unknown'").count() == 1
    log = {r["link_key"]: r["clicks"] for r in aggregates.link_daily_clicks(click_log.log_rows(stored)).collect()}
    assert log == {"file": 1, "k104": 1}

    events = star.events.unionByName(click_log.event_rows(stored))
    got = {r["id"]: r["total_clicks"] for r in aggregates.campaign_summary(star.campaigns, star.links, events).collect()}
    assert got == {10: 6, 20: 3, 30: 0}

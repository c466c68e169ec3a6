"""Changes to tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from drillsight import schemas
from drillsight.operators import merge

AT = dt.datetime(2024, 6, 1, 8, 30)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_get_or_create(spark, star):
    asked = spark.createDataFrame(
        [(5, "B", None, " B@x.com"), (1, "A", "A", "ANN@X.com "), (3, "First", None, "b@x.com"), (4, "N", "N", ""), (6, "C", "C", "c@x.com")],
        "seq long, first_name string, last_name string, email string",
    )
    got = merge.get_or_create_recipients(star.recipients, asked)
    new = {r["id"]: (r["first_name"], r["last_name"], r["email"], r["high_risk"]) for r in got.filter("is_new").collect()}
    assert new == {7: ("First", "", "b@x.com", False), 8: ("C", "C", "c@x.com", False)}
    assert got.filter("not is_new").count() == 6
    assert got.columns == [*star.recipients.columns, "is_new"]


def test_get_or_create_with_one_email_on_a_third_of_the_rows(spark, star):
    n = F.col("id")
    asked = spark.range(30_000).select(
        n.alias("seq"), F.lit("x").alias("first_name"), F.lit("y").alias("last_name"),
        F.when(n % 3 == 0, "hot@x.com").otherwise(F.concat(F.lit("p"), n % 1000, F.lit("@x.com"))).alias("email"),
    )
    new = merge.get_or_create_recipients(star.recipients, asked).filter("is_new")
    assert new.count() == 1001
    assert new.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (7, 1007, 1001)


def test_update(spark, star):
    changes = spark.createDataFrame(
        [(1, 1, "X", "Y", "n@x.com", "IT", "J", True, "{}"), (2, 1, None, None, "m@x.com", "", "", None, None), (3, 2, "Q", "Q", "", "Q", "Q", True, None)],
        "seq long, id long, first_name string, last_name string, email string, department string, job_title string, high_risk boolean, profile_json string",
    )
    before, after = by_id(star.recipients), by_id(merge.update_recipients(star.recipients, changes))
    assert tuple(after[1]) == (1, "", "", "m@x.com", None, None, False, None)
    assert {i: after[i] for i in after if i != 1} == {i: before[i] for i in before if i != 1}


def test_toggle(spark, star):
    ids = spark.createDataFrame([(1,), (2,), (2,), (4,), (99,)], "id long")
    got = {i: r["high_risk"] for i, r in by_id(merge.toggle_flag(star.recipients, ids)).items()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_delete_cascades(spark, star):
    ids = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    left = merge.delete_recipients(merge.Tables(star.recipients, star.links, star.events), ids)
    assert (left.recipients.count(), left.links.count(), left.events.count()) == (5, 4, 5)
    assert left.events.columns == star.events.columns and left.links.columns == star.links.columns
    # An event whose link was missing before is not the cascade's business.
    assert left.events.filter("link_id = 999").count() == 1


def test_departments(spark, star):
    names = spark.createDataFrame([(" IT ",), ("\tNew\n",), ("New",), ("",), ("  ",), (None,), ("it",)], "name string")
    got = sorted(r["name"] for r in merge.insert_departments(star.departments, names).collect())
    assert got == ["HR", "IT", "New", "it"]


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, other string")
    changes = spark.createDataFrame([(1, 1, "first"), (2, 1, None), (3, 3, "new")], "seq long, id long, name string")
    got = {i: tuple(r)[1:] for i, r in by_id(merge.upsert(table, changes, "id")).items()}
    assert got == {1: (None, "x"), 2: ("b", "y"), 3: ("new", None)}


def test_links_are_assigned_once(spark, star):
    asked = spark.createDataFrame(
        [(1, 10, 1), (9, 30, 1), (4, 30, 2), (5, 30, 1), (6, 30, 2)], "seq long, campaign_id long, recipient_id long"
    )
    got = merge.assign_links(star.links, asked, "salt", AT)
    new = {r["id"]: (r["campaign_id"], r["recipient_id"], r["created_at"]) for r in got.filter("is_new").collect()}
    assert new == {107: (30, 2, AT), 108: (30, 1, AT)}
    assert got.count() == 8 and got.select("tracking_id").distinct().count() == 8
    again = merge.assign_links(got.drop("is_new"), asked, "salt", AT)
    assert again.filter("is_new").count() == 0


def test_orphans(spark, star):
    links = star.links.unionByName(
        spark.createDataFrame([(200, 0, 0, "k", AT), (201, 10, 0, "l", AT)], schemas.LINKS)
    )
    got = merge.orphans(star.events, links, star.campaigns, star.recipients)
    assert sorted(map(tuple, got.collect())) == [
        ("link_events", "8", "link_id"), ("links", "200", "campaign_id"), ("links", "200", "recipient_id"), ("links", "201", "recipient_id"),
    ]


def test_dropping_links(spark):
    links = spark.createDataFrame([("a", "u"), ("b", "v")], "link_key string, url string")
    keys = spark.createDataFrame([("a",), ("z",), ("a",)], "link_key string")
    left, unknown = merge.drop_links(links, keys)
    assert [r["link_key"] for r in left.collect()] == ["b"]
    assert [r["link_key"] for r in unknown.collect()] == ["z"]


DRAFTS = [
    ("n", None, "other", ("n", "medium", "google", None)),
    ("n", "extreme", "training", ("n", "extreme", "training", "unknown difficulty")),
    ("", "low", None, ("", "low", "google", "Campaign name required")),
    (None, "high", "google", (None, "high", "google", "Campaign name required")),
    ("n", "", None, ("n", "", "google", "unknown difficulty")),
]


@pytest.mark.parametrize("name,level,target,want", DRAFTS)
def test_campaign_checks(spark, name, level, target, want):
    drafts = spark.createDataFrame([(name, level, target)], "name string, difficulty string, redirect_to string")
    assert tuple(merge.check_campaigns(drafts).first()) == want
    named = merge.check_campaigns(drafts, merge.UNTITLED).first()
    assert named["name"] == (name or "Untitled Campaign")


def test_conform(spark, star):
    old = star.recipients.drop("high_risk", "profile_json", "department").withColumn("extra", F.lit(1))
    got = merge.conform(old, "recipients")
    assert got.schema.simpleString() == schemas.RECIPIENTS.simpleString()
    row = got.filter("id = 1").first()
    assert (row["high_risk"], row["profile_json"], row["department"], row["email"]) == (False, None, None, "ann@x.com")
    campaigns = merge.conform(star.campaigns, "campaigns")
    assert {r["id"]: r["redirect_to"] for r in campaigns.collect()} == {10: "google", 20: "training", 30: "google"}
    assert merge.conform(star.campaigns.drop("redirect_to"), "campaigns").filter("redirect_to = 'google'").count() == 3


def test_emails_are_kept_as_given(spark, star):
    requests = spark.createDataFrame(
        [(1, "N", "M", " New.Name@X.com "), (2, "N", "M", "new.name@x.com"), (3, "", "", "   "), (4, "A", "Z", "ANN@x.com")],
        "seq long, first_name string, last_name string, email string",
    )
    new = merge.get_or_create_recipients(star.recipients, requests).filter("is_new").collect()
    assert [(r["id"], r["email"]) for r in new] == [(7, " New.Name@X.com ")]


def test_people_are_added_to_a_campaign_by_email(spark, star):
    requests = spark.createDataFrame(
        [(1, 30, "N", "M", "New@X.com"), (2, 30, "", "", "new@x.com "), (3, 10, "", "", "ANN@x.com"), (4, 30, "", "", "ann@x.com"), (5, 30, "", "", " ")],
        "seq long, campaign_id long, first_name string, last_name string, email string",
    )
    people, links = merge.add_to_campaign(star.recipients, star.links, requests, "s", dt.datetime(2024, 1, 1))
    assert [(r["id"], r["email"]) for r in people.filter("is_new").collect()] == [(7, "New@X.com")]
    got = sorted((r["campaign_id"], r["recipient_id"]) for r in links.filter("is_new").collect())
    assert got == [(30, 1), (30, 7)]  # the first person has a link of campaign 10 already

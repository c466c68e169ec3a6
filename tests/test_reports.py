"""Reports, joins, filters and orders on the small star of conftest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from drillsight import schemas
from drillsight.operators import aggregates, filters, joins, ordering, ranking, sets
from drillsight.plans.shares import dealt


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def names(df):
    return [r["name"] for r in df.collect()]


def test_engagement(star):
    got = by_id(aggregates.recipient_engagement(star.recipients, star.links, star.campaigns, star.events))
    assert len(got) == 6
    ann = got[1]
    assert (ann["campaigns_targeted"], ann["campaigns_clicked"], ann["total_clicks"]) == ("A; B", "B", 3)
    assert (ann["first_click_date"], ann["last_click_date"]) == ("2024-01-01", "2024-01-02")
    fay = got[6]
    assert (fay["campaigns_targeted"], fay["campaigns_clicked"], fay["total_clicks"]) == ("None", "None", 0)
    assert (fay["first_click_date"], fay["last_click_date"]) == ("N/A", "N/A")
    assert got[2]["firstName"] == "" and got[4]["lastName"] == ""


def test_campaign_names_are_listed_once(star, spark):
    twins = star.campaigns.withColumn("name", F.lit("same"))
    got = by_id(aggregates.recipient_engagement(star.recipients, star.links, twins, star.events))
    assert got[1]["campaigns_targeted"] == "same"


def test_link_of_an_unknown_campaign_counts_but_has_no_name(star, spark):
    only = star.campaigns.filter("id = 20")
    ann = by_id(aggregates.recipient_engagement(star.recipients, star.links, only, star.events))[1]
    assert (ann["campaigns_targeted"], ann["campaigns_clicked"], ann["total_clicks"]) == ("A", "None", 3)


def test_campaigns(star):
    got = aggregates.campaign_rates(star.campaigns, star.links, star.events)
    assert {r["id"]: (r["emails_sent"], r["total_clicks"], r["click_rate"]) for r in got.collect()} == {
        10: (3, 6, 200), 20: (3, 1, 33), 30: (0, 0, 0),
    }
    assert [r["id"] for r in ordering.newest_first(got).collect()] == [30, 20, 10]


def test_totals(star):
    assert tuple(aggregates.overall_totals(star.campaigns, star.links, star.events).first()) == (3, 6, 7, 117)
    nothing = aggregates.overall_totals(star.campaigns.limit(0), star.links, star.events)
    assert tuple(nothing.first()) == (0, 0, 0, 0)
    assert aggregates.recipient_count(star.recipients).first()[0] == 6


def test_recipients_of_a_campaign(star):
    rows = aggregates.campaign_recipients(star.links, star.recipients, star.events, 10)
    got = {r["link_id"]: (r["id"], r["click_count"], r["last_user_agent"]) for r in rows.collect()}
    chrome = "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537"
    assert got == {101: (1, 3, chrome), 103: (2, 2, "tie, larger id"), 105: (4, 1, "")}
    every = aggregates.campaign_recipients(star.links, star.recipients, star.events)
    assert every.count() == 6
    quiet = every.filter("link_id = 102").first()
    assert (quiet["click_count"], quiet["last_clicked_at"], quiet["last_user_agent"]) == (0, None, None)


def test_campaign_detail(star):
    got = {r["link_id"]: r for r in aggregates.campaign_detail(star.links, star.recipients, star.events).collect()}
    assert (got[101]["name"], got[101]["clicked"], got[101]["agent"]) == ("Ann Zed", "Yes", "Chrome / Windows")
    assert (got[104]["name"], got[104]["department"], got[104]["agent"]) == ("—", "—", "—")
    assert (got[102]["clicked"], got[102]["agent"]) == ("No", "—")


def test_at_risk(spark, star):
    people = spark.range(1, 7).select(
        "id", *[F.lit("x").alias(c) for c in ("first_name", "last_name", "email", "department")]
    )
    links = spark.range(1, 8).select(
        "id", F.lit(10).cast("long").alias("campaign_id"), F.col("id").alias("recipient_id")
    )
    clicks = {1: 2, 2: 3, 3: 5, 4: 3, 5: 4, 6: 0, 7: 9}  # 7 belongs to nobody known
    events = spark.createDataFrame(
        [(link, dt.datetime(2024, 1, 1)) for link, n in clicks.items() for _ in range(n)],
        "link_id long, created_at timestamp_ntz",
    )
    got = [(r["id"], r["total_clicks"]) for r in aggregates.at_risk(people, links, events).collect()]
    assert got == [(3, 5), (5, 4), (2, 3), (4, 3), (1, 2)]
    ranked = ranking.ranked_at_risk(people, links, events).collect()
    assert [(r["rank"], r["id"]) for r in ranked] == [(1, 3), (2, 5), (3, 2), (4, 4), (5, 1)]


def test_departments(star):
    risk = {r["department"]: r for r in aggregates.department_risk(star.recipients, star.links, star.events).collect()}
    assert set(risk) == {"Sales", "Unknown"}
    assert tuple(risk["Sales"]) == ("Sales", 3, 5, 166.7)
    assert tuple(risk["Unknown"]) == ("Unknown", 3, 2, 66.7)
    assert sorted(names(aggregates.distinct_departments(star.recipients))) == [" Sales ", "IT", "Sales"]
    assert names(sets.department_union(star.departments, star.recipients)) == [" Sales ", "HR", "IT", "Sales"]
    assert names(sets.department_options(star.departments, star.recipients)) == ["  ", " Sales ", "HR", "IT", "Sales"]


def test_departments_in_any_case(spark, star):
    people = star.recipients.withColumn("department", F.when(F.col("id") == 2, "sALES").otherwise(F.col("department")))
    risk = aggregates.department_risk(people, star.links, star.events, "UTF8_LCASE").collect()
    assert {tuple(r) for r in risk} == {("Sales", 3, 5, 166.7), ("Unknown", 3, 2, 66.7)}
    more = star.departments.unionByName(spark.createDataFrame([("it",)], "name string"))
    assert names(sets.department_union(more, people, "UTF8_LCASE")) == [" Sales ", "HR", "IT", "sALES"]
    assert sorted(by_id(filters.in_departments(people, ["SALES"], "UTF8_LCASE"))) == [2]
    assert sorted(by_id(filters.in_departments(people, ["SALES"]))) == []


def test_joins(star):
    every = joins.recipients_to_events(star.recipients, star.links, star.campaigns, star.events)
    got = sorted((r["recipient_id"], r["link_id"] or 0, r["event_id"] or "") for r in every.collect())
    assert got == [
        (1, 101, "1"), (1, 101, "2"), (1, 101, "3"), (1, 102, ""), (2, 103, "4"), (2, 103, "5"),
        (3, 104, "6"), (4, 105, "7"), (5, 106, ""), (6, 0, ""),
    ]
    stars = joins.campaigns_to_events(star.campaigns, star.links, star.events)
    assert stars.count() == 10 and stars.filter("link_id is null").first()["campaign_id"] == 30
    assert sorted(by_id(joins.never_clicked(star.recipients, star.links, star.events))) == [5, 6]
    assert sorted(by_id(joins.unclicked_links(star.links, star.events))) == [102, 106]
    detail = joins.link_detail(star.links, star.campaigns, star.recipients)
    assert {r["link_id"]: r["employee"] for r in detail.collect()}[105] == "Dan"


def test_tracking(spark, star):
    asked = spark.createDataFrame([(1, "k101"), (2, "k102"), (3, "gone"), (4, "k101"), (5, None)], "n int, tracking_id string")
    got = joins.resolve_tracking(asked, star.links, star.campaigns)
    assert sorted((r["n"], r["link_id"], r["redirect_to"]) for r in got.collect()) == [
        (1, 101, "google"), (2, 102, "training"), (4, 101, "google"),
    ]


def test_link_file_comes_first(spark):
    clicks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, None)], "n int, link_key string")
    files = spark.createDataFrame([("a", "u", None)], "link_key string, url string, name string")
    db = spark.createDataFrame([("a", 1), ("b", 2)], "link_key string, link_id long")
    got = joins.by_source_priority(clicks, files, db).collect()
    assert sorted((r["n"], r["source"], r["url"], r["link_id"]) for r in got) == [
        (1, "file", "u", None), (2, "db", None, 2), (3, None, None, None), (4, "file", "u", None), (5, None, None, None),
    ]


def campaigns_with_rates(spark, rates):
    """Campaigns with the given clicks per thousand links, oldest first."""
    rows = [(n, f"Name {n}", dt.datetime(2024, 1, 1 + n)) for n in range(len(rates))]
    campaigns = spark.createDataFrame(rows, "id long, name string, created_at timestamp_ntz").withColumn(
        "difficulty", F.lit("low")
    )
    links = spark.range(len(rates) * 1000).select(
        "id", F.expr("id div 1000").alias("campaign_id"), F.col("id").alias("recipient_id")
    )
    clicks = [(1000 * n + i, dt.datetime(2024, 2, 1)) for n, r in enumerate(rates) for i in range(r)]
    events = spark.createDataFrame(clicks or [(-1, None)], "link_id long, created_at timestamp_ntz")
    return campaigns, links, events


@pytest.mark.parametrize(
    "rates,want",
    [
        ([300, 500, 100], ("Improving", "20.0")),
        ([999, 300, 500, 325], ("Worsening", "2.5")),
        ([110, 104], ("Stable", "0")),
        ([104, 114], ("Worsening", "1.0")),
        ([100], None),
        ([], None),
    ],
)
def test_trend(spark, rates, want):
    if not rates:
        tables = [t.limit(0) for t in campaigns_with_rates(spark, [0])]
    else:
        tables = campaigns_with_rates(spark, rates)
    got = ranking.click_rate_trend(*tables).collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_newest_campaigns(spark):
    tables = campaigns_with_rates(spark, [10, 20, 30, 40, 50, 60, 70, 80])
    got = [(r["id"], r["click_rate"]) for r in ranking.last_campaigns(*tables).collect()]
    assert got == [(2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)]
    assert tuple(ranking.most_recent_campaign(*tables).select("id", "click_rate").first()) == (7, 8)


def test_days_since_last(spark):
    campaigns = spark.createDataFrame([(1, dt.datetime(2024, 3, 1, 23, 59))], "id long, created_at timestamp_ntz")
    assert ranking.days_since_last(campaigns, dt.date(2024, 3, 2)).first()["days"] == 1
    assert ranking.days_since_last(campaigns.limit(0), dt.date(2024, 3, 2)).first()["days"] is None


def test_filters(spark, star):
    r = star.recipients
    assert sorted(by_id(filters.in_departments(r, []))) == [1, 2, 3, 6]
    assert sorted(by_id(filters.in_departments(r, ["Sales", "IT"]))) == [2, 6]
    assert sorted(by_id(filters.in_departments(r, star.departments))) == [6]
    ids = spark.createDataFrame([(1,), (2,), (4,), (2,)], "id long")
    assert sorted(by_id(filters.high_risk_of(r, ids))) == [2]
    assert sorted(by_id(filters.search(r))) == [1, 2, 3, 4, 5, 6]
    assert sorted(by_id(filters.search(r, "X.COM"))) == [1, 2, 3, 6]
    assert sorted(by_id(filters.search(r, "ops", department=""))) == [3, 4]
    assert sorted(by_id(filters.search(r, "y", department="Sales"))) == [2]
    assert sorted(by_id(filters.search(r, "%"))) == []
    assert sorted(by_id(filters.of_campaign(star.links, 20))) == [102, 104, 106]
    some, none = star.departments, star.departments.limit(0)
    everybody = sorted(by_id(filters.in_departments(r, [])))
    assert sorted(by_id(filters.in_departments(r, none))) == everybody != sorted(by_id(filters.in_departments(r, some)))


def test_orders(star):
    def order(df):
        return [r["id"] for r in df.collect()]

    assert order(ordering.by_name(star.recipients)) == [4, 3, 6, 5, 2, 1]
    assert order(ordering.sorted_by(star.recipients, "first_name")) == [3, 2, 1, 4, 5, 6]
    assert order(ordering.sorted_by(star.recipients, "first_name", descending=True)) == [6, 5, 4, 1, 3, 2]
    assert order(ordering.take_first(star.recipients)) == [1]
    with pytest.raises(ValueError):
        ordering.sorted_by(star.recipients, "id; drop table")
    detail = aggregates.campaign_recipients(star.links, star.recipients, star.events)
    assert [r["link_id"] for r in ordering.by_clicks(detail).collect()] == [101, 103, 105, 104, 106, 102]
    placed = {r["link_id"]: r["position"] for r in ordering.with_position(ordering.by_clicks(detail)).collect()}
    assert placed == {101: 1, 103: 2, 105: 3, 104: 4, 106: 5, 102: 6}


def test_articles_with_image(spark):
    rows = [(f"t{i}", f"l{i}", f"2024-01-0{i}", "s", image, "d") for i, image in enumerate(["x", "", "y", None, "z", "w"])]
    df = spark.createDataFrame(rows, "title string, link string, published string, source string, image string, description string")
    assert [r["title"] for r in filters.with_image(df).collect()] == ["t5", "t4", "t2"]


def test_click_reports(spark):
    at = dt.datetime
    clicks = spark.createDataFrame(
        [("a", at(2024, 1, 1, 23, 59), "x", "h1"), ("a", at(2024, 1, 2), "", "h1"), ("a", at(2024, 1, 2), None, "h2"), ("b", at(2024, 1, 2), "x", "h1")],
        "link_key string, clicked_at timestamp_ntz, ua string, ip_hash string",
    )
    daily = {(r["link_key"], r["day"]): r["clicks"] for r in aggregates.link_daily_clicks(clicks).collect()}
    assert daily == {("a", "2024-01-01"): 1, ("a", "2024-01-02"): 2, ("b", "2024-01-02"): 1}
    agents = {(r["link_key"], r["agent"]): r["clicks"] for r in aggregates.link_agent_counts(clicks).collect()}
    assert agents == {("a", "x"): 1, ("a", "unknown"): 2, ("b", "x"): 1}
    close = {r["link_key"]: r["unique_users"] for r in aggregates.link_unique_visitors_approx(clicks).collect()}
    assert close == {"a": 2, "b": 1}


def test_deliveries(spark):
    runs = spark.createDataFrame(
        [(1, 1, "A", "B", "a", True, None), (1, 2, None, "C", "b", False, "gone"), (2, 3, "", None, "c", True, None)],
        "run_id long, link_id long, first_name string, last_name string, email string, success boolean, error string",
    )
    got = {r["run_id"]: tuple(r)[1:] for r in aggregates.delivery_outcome(runs).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 1, 0)}
    assert [(r["name"], r["email"]) for r in aggregates.delivery_failures(runs).collect()] == [("C", "b")]


def test_link_analytics(spark):
    """File links win, unclicked links show zeros, unknown links nothing."""
    at = dt.datetime
    files = spark.createDataFrame([("a", "u", "File A"), ("b", "u", None)], "link_key string, url string, name string")
    db = spark.createDataFrame(
        [("a", 1, "Camp", "Ann Zed"), ("c", 2, "Camp", "Bo"), ("d", 3, "Other", "")],
        "link_key string, link_id long, campaign_name string, employee string",
    )
    log = spark.createDataFrame(
        [("a", at(2024, 1, 1), "x", "h1"), ("a", at(2024, 1, 2), "", "h1"), ("a", at(2024, 1, 2), None, "h2"), ("z", at(2024, 1, 2), "x", "h1")],
        "link_key string, clicked_at timestamp_ntz, ua string, ip_hash string",
    )
    events = spark.createDataFrame(
        [("1", 1, "click", "9", "x", at(2024, 1, 1)), ("2", 2, "click", "9", "x", at(2024, 1, 5)), ("3", 2, "click", "9", "y", at(2024, 1, 5)), ("4", 77, "click", "9", "x", at(2024, 1, 5))],
        schemas.LINK_EVENTS,
    )
    links, clicks = aggregates.known_links(files, db), aggregates.clicks_of_both(log, events)
    got = sorted(map(tuple, aggregates.link_summary(links, clicks).collect()))
    assert got == [
        ("a", "file", "File A", None, 3, 2, 2, "2024-01-01", "2024-01-02"),
        ("b", "file", None, None, 0, 0, 0, None, None),
        ("c", "db", "Camp", "Bo", 2, 1, 1, "2024-01-05", "2024-01-05"),
        ("d", "db", "Other", "", 0, 0, 0, None, None),
    ]
    items = sorted(map(tuple, aggregates.link_breakdown(links, clicks).collect()))
    assert items == [
        ("a", "file", "agent", "unknown", 2), ("a", "file", "agent", "x", 1),
        ("a", "file", "day", "2024-01-01", 1), ("a", "file", "day", "2024-01-02", 2),
        ("c", "db", "agent", "x", 1), ("c", "db", "agent", "y", 1), ("c", "db", "day", "2024-01-05", 2),
    ]


def test_analytics_of_a_crowded_link(spark):
    """One link has nearly all clicks, some days and visitors are unknown; no task gets them all."""
    start = dt.datetime(2024, 1, 1)
    made = [
        (str(k), 1 if k % 10 else 2, "click", None if k % 7 == 0 else str(k % 90), "ab"[k % 2], None if k % 11 == 0 else start + dt.timedelta(hours=k % 200))
        for k in range(3000)
    ]
    events = spark.createDataFrame(made, schemas.LINK_EVENTS)
    db = spark.createDataFrame([("c", 1, "Camp", "Bo"), ("d", 2, None, None)], "link_key string, link_id long, campaign_name string, employee string")
    none = spark.createDataFrame([], "link_key string, url string, name string")
    log = spark.createDataFrame([], "link_key string, clicked_at timestamp_ntz, ua string, ip_hash string")
    links, clicks = aggregates.known_links(none, db), aggregates.clicks_of_both(log, events)
    want, items = set(), {}
    for key, link, name, employee in (("c", 1, "Camp", "Bo"), ("d", 2, None, None)):
        own = [x for x in made if x[1] == link]
        days = {x[5].strftime("%Y-%m-%d") for x in own if x[5]}
        want.add((key, "db", name, employee, len(own), len({x[3] for x in own if x[3]}), len(days), min(days), max(days)))
        for x in own:
            for kind, item in (("day", x[5] and x[5].strftime("%Y-%m-%d")), ("agent", x[4])):
                items[key, "db", kind, item] = items.get((key, "db", kind, item), 0) + 1
    summary = aggregates.link_summary(links, clicks)
    assert set(map(tuple, summary.collect())) == want
    assert {tuple(r)[:4]: r["clicks"] for r in aggregates.link_breakdown(links, clicks).collect()} == items
    shares = dealt(clicks, "source", "id", "day", "visitor", "agent", "spread")
    sizes = shares.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == 8 and max(sizes) < 900


def test_schemas_of_the_views(views):
    for name, schema in {
        "recipients": schemas.RECIPIENTS, "campaigns": schemas.CAMPAIGNS,
        "links": schemas.LINKS, "link_events": schemas.LINK_EVENTS,
    }.items():
        got = [(f.name, f.dataType) for f in getattr(views, name).schema]
        assert got == [(f.name, f.dataType) for f in schema]

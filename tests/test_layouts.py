"""Bucketed joins, the search index, and readers that divide one file among many tasks."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_kept import plan_of, scan_metrics
from test_streams import rows

from drillsight.operators import filters, joins, search_index
from drillsight.plans import buckets as kept
from drillsight.plans import skew, splits
from drillsight.sources import roster


def moved_scans(plan):
    """Of each bucketed scan in a plan, whether an exchange by hash stands above it on its way to a join."""
    found, lines = [], plan.split("\n")
    for k, line in enumerate(lines):
        if "Scan parquet" in line and "Bucketed: true" in line:
            depth, exchanged = len(line) - len(line.lstrip(" :+-*()0123456789")), False
            for above in reversed(lines[:k]):
                indent = len(above) - len(above.lstrip(" :+-*()0123456789"))
                if indent < depth:
                    depth = indent
                    if "SortMergeJoin" in above:
                        break
                    exchanged |= "Exchange hashpartitioning" in above
            found.append(exchanged)
    return found


@pytest.fixture
def linked(spark):
    n = F.col("id")
    links = spark.range(5000).select(
        "id", (n % 7).alias("campaign_id"), F.when(n % 3 == 0, 0).otherwise(n % 400).alias("recipient_id"),
        F.sha2(n.cast("string"), 256).alias("tracking_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    campaigns = spark.range(6).select("id", F.lit("c").alias("name"), F.lit("low").alias("difficulty"), F.lit(None).cast("string").alias("redirect_to"))
    people = spark.range(500).select("id", *[F.lit("x").alias(c) for c in ("first_name", "last_name", "email", "department", "job_title")])
    requests = spark.range(30_000).select("id", F.when(n % 3 == 0, F.sha2(F.lit("5"), 256)).when(n % 100 == 1, None).otherwise(F.sha2((n % 6000).cast("string"), 256)).alias("tracking_id"))
    events = spark.range(3000).select("id", (n % 900).alias("link_id"), F.lit("i").alias("ip_address"), F.lit("u").alias("user_agent"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return links, campaigns, people, requests, events


def test_bucketed_links_do_not_move(spark, linked, tmp_path, monkeypatch):
    links, campaigns, _, requests, _ = linked
    table = kept.store_bucketed(links, "tracking_id", 16, str(tmp_path / "links"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = rows(joins.resolve_tracking(requests, links, campaigns))
        for least in (10**9, 1000):  # without hot keys, and with one
            monkeypatch.setattr(skew, "MIN_HOT_ROWS", least)
            for held in (table, kept.open_bucketed(spark, str(tmp_path / "links"), "tracking_id", 16)):
                got = joins.resolve_tracking(requests, held, campaigns, bucketed=True)
                plan = plan_of(got)
                assert moved_scans(plan)[0] is False and "Exchange hashpartitioning(tracking_id" in plan
                assert ("Union" in plan) == (least == 1000)
                assert rows(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neither_side_moves(spark, linked, tmp_path, monkeypatch):
    links, campaigns, people, _, events = linked
    tables = kept.store_bucketed(people, "id", 8, str(tmp_path / "p")), kept.store_bucketed(links, "recipient_id", 8, str(tmp_path / "l"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = rows(joins.recipients_to_events(people, links, campaigns, events))
        for least in (10**9, 1000):
            monkeypatch.setattr(skew, "MIN_HOT_ROWS", least)
            got = joins.recipients_to_events(*tables, campaigns, events, bucketed=True)
            assert rows(got.select(joins.recipients_to_events(people, links, campaigns, events).columns)) == want
            named = skew.dimension_join(joins._links(tables[1]), joins._campaigns(campaigns), "campaign_id", "left")
            owned = kept.bucketed_fanout(joins._recipients(tables[0]), named, "recipient_id")
            assert moved_scans(plan_of(owned))[:2] == [False, False]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_indexed_search_is_the_plain_one(spark, star, tmp_path):
    draw = random.Random(3)
    letters = "abAB é%_\\ÄßİΣ"
    made = [tuple([k, *["".join(draw.choice(letters) for _ in range(draw.randrange(12))) if draw.random() < 0.9 else None for _ in range(5)]]) for k in range(800)]
    people = spark.createDataFrame(made, "id long, first_name string, last_name string, email string, department string, job_title string")
    path = str(tmp_path / "index")
    search_index.build_index(people, path)
    terms = ["", "ab", "ABA", "zzz", "a%_", "\\aB", "İaΣ"]
    terms += [t[k : k + 4] for row in made[::400] for t in row[1:3] if t for k in (0, 2)]
    for term in terms:
        assert rows(search_index.search_indexed(people, path, term)) == rows(filters.search(people, term)), term
    some = made[7][4] or "x"
    assert rows(search_index.search_indexed(people, path, "aba", some)) == rows(filters.search(people, "aba", some))


def test_only_postings_of_the_term_are_read(spark, tmp_path):
    n = F.col("id")
    people = spark.range(20_000).select(
        "id", F.concat(F.lit("name"), n).alias("first_name"), F.lit("Hot Surname").alias("last_name"), F.concat(F.hex(n * 7919), F.lit("@x.com")).alias("email"),
        F.lit("d").alias("department"), F.lit(None).cast("string").alias("job_title"),
    )
    path = str(tmp_path / "index")
    search_index.build_index(people, path)
    found = search_index.candidates(spark, path, "nAme1999 hot")
    assert found.collect() == []
    found = search_index.candidates(spark, path, "ame1999")
    ids = {r["id"] for r in found.collect()}
    assert {1999, *range(19990, 20000)} <= ids and len(ids) < 200
    metrics = scan_metrics(found)
    assert metrics["numFiles"] <= search_index.LOOKED_UP and metrics["numOutputRows"] < 50_000
    every = search_index.search_indexed(people, path, "hot sur")
    assert every.count() == 20_000


def roster_files(folder, seed, ends):
    """Two files of rows with line breaks, quotes, separators and empty lines in and between fields."""
    draw = random.Random(seed)
    pieces = ["a", "b c", ",", '""', "\n", "\r\n", "\n\n", "é", " ", "x" * 30, '"",\n""']
    for n in range(2):
        lines = ["email,firstName,department,other"]
        for k in range(300):
            fields = [f"p{k % 250}@x.com", "", "", str(k)]
            for j in (1, 2):
                text = "".join(draw.choice(pieces) for _ in range(draw.randrange(5)))
                fields[j] = f'"{text}"' if draw.random() < 0.7 or re.search('[",\n]', text) else text
            lines += [",".join(fields)] + [""] * (draw.random() < 0.1)
        (folder / f"part-{n}.csv").write_text(ends.join(lines) + ends, newline="")


@pytest.mark.parametrize(("seed", "ends"), [(1, "\n"), (2, "\r\n")])
def test_records_over_many_splits(spark, star, tmp_path, seed, ends):
    folder = tmp_path / "in"
    folder.mkdir()
    roster_files(folder, seed, ends)
    order, columns = ["place.file", "place.block", "place.row"], list(roster.HEADERS)
    whole = roster.read_roster_csv(spark, str(folder)).orderBy(*order).select(columns).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = roster.read_large_roster_csv(spark, str(folder))
        assert split_pieces(spark, str(folder)) > 20
        got = split.orderBy(*order).select(columns).collect()
        assert got == whole and len(got) == 600
        assert split.select("seq").distinct().count() == 600
        done = roster.import_roster(split, star.recipients)
        assert done.created.count() == 250
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def split_pieces(spark, path):
    return splits.pieces(spark, path, "\n").rdd.getNumPartitions()


def test_a_quote_that_is_never_closed_takes_the_rest(spark, tmp_path):
    (tmp_path / "r.csv").write_text('email,department\na@x.com,one\nb@x.com,"two\nc@x.com,three\n')
    rows_of = roster.read_large_roster_csv(spark, str(tmp_path))
    assert {r["email"] for r in rows_of.collect()} == {"a@x.com", "b@x.com"}

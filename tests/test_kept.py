"""Kept tables: sketches, roll-ups, change logs, deletions by file, layouts for look-ups."""

import datetime as dt
import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_streams import FILES, arriving, drive, rows  # noqa: F401

from __spark_entry__ import queries
from drillsight.operators import aggregates, cascade, changelog, merge, ranking, rollup, sketches
from drillsight.plans import skew
from drillsight.sources import event_store
from drillsight.streaming import clicks as streams


def files_of(folder):
    """Every data file below a folder with the hash of its bytes."""
    found = Path(str(folder).removeprefix("file:")).rglob("*.parquet")
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in found}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- sketches --------------------------------------------------------------------------


def test_a_stream_of_sketches_keeps_no_state(spark, arriving, tmp_path):  # noqa: F811
    out, small, checkpoint = (str(tmp_path / x) for x in ("out", "small", "cp"))
    drive(arriving, streams.store_visitor_sketches, out, checkpoint)
    assert not (tmp_path / "cp" / "state").exists()
    want = queries()["link_visitor_sketches"](spark, SMALL)
    assert want.filter("not within_bound").isEmpty()

    def check():
        stored = streams.visitor_sketches(streams.read_table(spark, out, small))
        merged = sketches.estimates(sketches.merge_sketches(stored, ["link_key"]))
        # These links have few visitors, which sketches list.
        assert rows(merged.select("link_key", "clicks", "unique_users")) == rows(want.select("link_key", "clicks", "unique_users"))

    check()
    for upto in (2, 5, 5, FILES - 1):
        streams.compact(spark, out, small, upto, lambda x: sketches.merge_sketches(x, ["link_key", "day"]))
        check()
    compacted = spark.read.parquet(small)
    assert compacted.count() < spark.read.parquet(out).count()


def test_merged_sketches_stay_within_their_error(spark):
    """One link with a third of all visitors; days, months and all days, merged in any order."""
    n = F.col("id")
    clicks = spark.range(600_000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("L"), n % 20)).alias("link_key"),
        F.timestamp_add("DAY", (n % 50).cast("int"), F.lit(dt.datetime(2024, 1, 10))).alias("clicked_at"),
        F.sha2((n % 90_000).cast("string"), 256).alias("ip_hash"),
    )
    stored = sketches.sketch_visitors(clicks)
    assert stored.count() == clicks.select("link_key", F.to_date("clicked_at")).distinct().count()
    exact = {r[0]: r[1] for r in clicks.groupBy("link_key").agg(F.count_distinct("ip_hash")).collect()}
    whole = sketches.estimates(sketches.merge_sketches(stored, ["link_key"])).collect()
    assert {r["link_key"]: r["clicks"] for r in whole} == {r[0]: r[1] for r in clicks.groupBy("link_key").count().collect()}
    for r in whole:
        assert abs(r["unique_users"] - exact[r["link_key"]]) <= max(1, sketches.SIGMAS * sketches.standard_error() * exact[r["link_key"]])
    months = sketches.merge_sketches(stored, ["link_key", F.substring("day", 1, 7).alias("month")])
    again = sketches.estimates(sketches.merge_sketches(months, ["link_key"])).collect()
    for a, b in zip(sorted(whole), sorted(again), strict=True):
        assert a["clicks"] == b["clicks"] and abs(a["unique_users"] - b["unique_users"]) <= 0.06 * exact[a["link_key"]]
    assert re.search(r"partial_hll_sketch_agg", plan_of(stored))


def test_sketches_of_odd_rows(spark):
    at = dt.datetime(2024, 1, 1)
    clicks = spark.createDataFrame(
        [("a", at, None), ("a", at, "x"), ("b", at, None), (None, at, "x"), ("c", None, "x"), ("c", None, "x")],
        "link_key string, clicked_at timestamp_ntz, ip_hash string",
    )
    got = sketches.estimates(sketches.sketch_visitors(clicks))
    assert rows(got) == rows(spark.createDataFrame(
        [("a", "2024-01-01", 2, 1), ("b", "2024-01-01", 1, 0), (None, "2024-01-01", 1, 1), ("c", None, 2, 1)],
        "link_key string, day string, clicks long, unique_users long"))
    assert sketches.sketch_visitors(clicks.limit(0)).count() == 0


# -- roll-up ---------------------------------------------------------------------------


REPORTS = {
    "engagement": lambda s, e: aggregates.recipient_engagement(s.recipients, s.links, s.campaigns, e),
    "summary": lambda s, e: aggregates.campaign_summary(s.campaigns, s.links, e),
    "recipients": lambda s, e: aggregates.campaign_recipients(s.links, s.recipients, e),
    "one": lambda s, e: aggregates.campaign_recipients(s.links, s.recipients, e, campaign_id=10),
    "at risk": lambda s, e: aggregates.at_risk(s.recipients, s.links, e),
    "departments": lambda s, e: aggregates.department_risk(s.recipients, s.links, e),
}


def test_rolled_up_reports_after_any_number_of_batches(spark, star, tmp_path):
    table, root = str(tmp_path / "events"), str(tmp_path / "daily")
    merges = {1, 2, 4, 5}
    for n in range(7):
        batch = star.events.filter(F.col("id") == n + 1) if n < 6 else star.events.filter("id > 6")
        rollup.append_batch(batch, table, n)
        if n in merges:
            assert rollup.merge_batches(spark, table, root) == n
        if n == 5:
            rollup.fold_parts(spark, root)
            rollup.fold_parts(spark, root)
        seen = star.events.filter(F.col("id") <= n + 1) if n < 6 else star.events
        rolled = rollup.clicks(spark, table, root)
        for report in REPORTS.values():
            assert rows(report(star, rolled)) == rows(report(star, seen))
        done = rollup.merged_upto(spark, root)
        read = {int(x) for f in rolled.inputFiles() for x in re.findall(r"/events/batch=(\d+)/", f)}
        assert read == set(range(done + 1, n + 1))


def test_rollup_by_days(spark, star, tmp_path):
    table, root = str(tmp_path / "events"), str(tmp_path / "daily")
    rollup.append_batch(star.events.filter("id < 4"), table, 0)
    rollup.merge_batches(spark, table, root)
    rollup.append_batch(star.events.filter("id >= 4"), table, 3)
    some = rollup.clicks(spark, table, root, "2024-01-02", "2024-01-04")
    want = star.events.filter("created_at >= '2024-01-02' and created_at < '2024-01-05'")
    for report in REPORTS.values():
        assert rows(report(star, some)) == rows(report(star, want))


def test_merges_that_fail_or_repeat_change_nothing(spark, star, tmp_path):
    table, root = str(tmp_path / "events"), str(tmp_path / "daily")
    with pytest.raises(ValueError, match="no batch"):
        rollup.clicks(spark, table, root)
    rollup.append_batch(star.events.filter("id < 4"), table, 0)
    rollup.append_batch(star.events.filter("id >= 4"), table, 1)
    want = rows(REPORTS["recipients"](star, star.events))
    rollup.merge_batches(spark, table, root, upto=0)
    rollup.merge_batches(spark, table, root)
    (tmp_path / "daily" / "since=0" / "upto=1" / "_SUCCESS").unlink()  # the job did not end
    assert rollup.merged_upto(spark, root) == 0
    assert rows(REPORTS["recipients"](star, rollup.clicks(spark, table, root))) == want
    assert rollup.merge_batches(spark, table, root) == rollup.merge_batches(spark, table, root) == 1
    assert rows(REPORTS["recipients"](star, rollup.clicks(spark, table, root))) == want
    # A fold that was written, and stopped before it removed what it replaces.
    rollup.fold_parts(spark, root)
    rollup.merge_batches(spark, table, str(tmp_path / "other"), upto=0)
    (tmp_path / "other" / "since=-1" / "upto=0").rename(tmp_path / "daily" / "since=-1" / "upto=0")
    assert rows(REPORTS["recipients"](star, rollup.clicks(spark, table, root))) == want
    (tmp_path / "events" / "batch=1" / "_SUCCESS").unlink()
    assert rollup.batches(spark, table) == [0]


# -- change log ------------------------------------------------------------------------


def written(root, spark):
    """Rows in each change set."""
    log = defaultdict(int)
    for p in Path(root).glob("log/seq=*/bucket=*/*.parquet"):
        log[int(p.parts[-3].split("=")[1])] += spark.read.parquet(str(p)).count()
    return dict(log)


@pytest.fixture
def people(spark, tmp_path):
    n = F.col("id")
    table = spark.range(1000).select(
        "id", F.concat(F.lit("f"), n).alias("first_name"), F.lit("l").alias("last_name"), F.concat(n, F.lit("@x")).alias("email"),
        F.lit("IT").alias("department"), F.lit("dev").alias("job_title"), (n % 2 == 0).alias("high_risk"), F.lit(None).cast("string").alias("profile_json"),
    )
    return table, changelog.create(spark, str(tmp_path / "people"), table, "id", buckets=8)


def changes_of(spark, ids, name):
    return spark.createDataFrame(
        [(k, i, name, "n", f"{name}{i}@y", "HR", "", True, None) for k, i in enumerate(ids)],
        "seq long, id long, first_name string, last_name string, email string, department string, job_title string, high_risk boolean, profile_json string",
    )


def test_ten_changes_write_ten_rows(spark, people):
    before, table = people
    base = files_of(f"{table.root}/base")
    changes = changes_of(spark, [*range(100, 110), 5000], "new")  # the last one is not there
    changelog.change(table, changes, lambda x: merge.update_recipients(x, changes))
    assert written(table.root, spark) == {1: 10}
    want = merge.update_recipients(before, changes)
    assert rows(changelog.read(table)) == rows(want)
    flips = spark.createDataFrame([(1,), (100,), (7,), (7,), (6000,)], "id long")
    changelog.change(table, flips, lambda x: merge.toggle_flag(x, flips))
    assert written(table.root, spark) == {1: 10, 2: 2}
    want = merge.toggle_flag(want, flips)
    assert rows(changelog.read(table)) == rows(want)
    assert files_of(f"{table.root}/base") == base  # nothing was rewritten
    touched = {r[0] for r in changelog._bucketed(table, spark.createDataFrame([(100,)], "id long")).select("bucket").collect()}
    paths = changelog.rows_of(table, spark.createDataFrame([(100,)], "id long")).inputFiles()
    assert {int(re.search(r"bucket=(\d+)", p)[1]) for p in paths} == touched


def test_only_touched_buckets_are_compacted(spark, people):
    before, table = people
    base = files_of(f"{table.root}/base")
    changes = changes_of(spark, [3], "new")
    changelog.change(table, changes, lambda x: merge.update_recipients(x, changes))
    assert len(changelog.compact(table)) == 1 and changelog.compact(table) == []
    after = files_of(f"{table.root}/base")
    assert {k: v for k, v in after.items() if k.startswith("v=0")} == base
    assert len({k.split("/")[1] for k in after if k.startswith("v=1")}) == 1
    changelog.clean(table)
    want = rows(merge.update_recipients(before, changes))
    assert rows(changelog.read(table)) == want
    assert len(files_of(f"{table.root}/base")) == len(base) and not files_of(f"{table.root}/log")


def test_any_sequence_of_changes(spark, people):
    """Against the functions over the whole table, with compactions at different depths between."""
    want, table = people
    draw = random.Random(4)
    for step in range(8):
        ids = [draw.randrange(1100) for _ in range(draw.choice([1, 5, 40]))]
        frame = spark.createDataFrame([(i,) for i in ids], "id long")
        kind = step % 4
        if kind == 0:
            changes = changes_of(spark, ids, f"s{step}")
            f = lambda x, c=changes: merge.update_recipients(x, c)
        elif kind == 1:
            f = lambda x, c=frame: merge.toggle_flag(x, c)
        elif kind == 2:
            changes = changes_of(spark, ids, f"u{step}").select("seq", "id", "email")
            f = lambda x, c=changes: merge.upsert(x, c, "id")
        else:
            changelog.delete(table, frame)
            want = want.join(frame, "id", "left_anti")
        if kind < 3:
            changelog.change(table, frame, f)
            want = f(want)
        want = spark.createDataFrame(want.collect(), want.schema)
        if step in (2, 5):
            changelog.compact(table, least_sets=2 if step == 2 else 1)
        if step == 6:
            changelog.clean(table)
        assert rows(changelog.read(table)) == rows(want)


def test_lost_sets_empty_tables_and_taken_names(spark, people, tmp_path):
    before, table = people
    changes = changes_of(spark, [3, 4], "new")
    changelog.change(table, changes, lambda x: merge.update_recipients(x, changes))
    (Path(table.root) / "log" / "seq=1" / "_SUCCESS").unlink()
    assert rows(changelog.read(table)) == rows(before)
    changelog.change(table, changes, lambda x: merge.update_recipients(x, changes))
    assert rows(changelog.read(table)) == rows(merge.update_recipients(before, changes))
    empty = changelog.create(spark, str(tmp_path / "empty"), before.limit(0), "id", buckets=4)
    assert changelog.read(empty).count() == 0 and changelog.read(empty).columns == before.columns
    new = changes.select("seq", "id", "email")
    changelog.change(empty, new, lambda x: merge.upsert(x, new, "id"))
    assert changelog.read(empty).count() == 2
    changelog.delete(empty, new)
    changelog.compact(empty)
    assert changelog.read(empty).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        changelog.create(spark, str(tmp_path / "no"), before.withColumn("bucket", F.lit(1)), "id")


# -- deletions by file -----------------------------------------------------------------


@pytest.fixture
def stored_events(spark, tmp_path):
    n = F.col("id")
    events = spark.range(4000).select(
        n.cast("string").alias("id"), (n % 400).alias("link_id"), F.lit("click").alias("event_type"), F.lit("1.1.1.1").alias("ip_address"),
        F.lit(None).cast("string").alias("user_agent"),
        F.timestamp_add("DAY", F.expr("cast(id % 400 div 20 as int)"), F.lit(dt.datetime(2024, 1, 10))).alias("created_at"),
    )
    path = str(tmp_path / "events")
    streams.append_events(events, path)
    return events, path


def test_other_files_stay_as_they_are(spark, stored_events):
    events, path = stored_events
    before = files_of(path)
    gone = spark.createDataFrame([(5,), (5,), (25,), (9999,)], "link_id long")
    assert cascade.delete_events(spark, path, gone) == 2
    after = files_of(path)
    assert rows(spark.read.parquet(path).select(events.columns)) == rows(events.filter("link_id not in (5, 25)"))
    changed = {k.split("/")[0] for k in before if k not in after}
    assert changed == {"period=2024-01-10", "period=2024-01-11"}
    assert all(after[k] == h for k, h in before.items() if k.split("/")[0] not in changed)
    assert cascade.delete_events(spark, path, gone) == 0
    assert files_of(path) == after


def test_in_several_rounds_and_to_the_last_row(spark, stored_events, monkeypatch):
    events, path = stored_events
    monkeypatch.setattr(cascade, "FILES_AT_ONCE", 3)
    assert cascade.delete_events(spark, path, spark.range(100, 400).withColumnRenamed("id", "link_id")) == 15
    assert rows(spark.read.parquet(path).select(events.columns)) == rows(events.filter("link_id < 100"))
    assert {k.split("/")[0] for k in files_of(path)} == {f"period=2024-01-{d}" for d in range(10, 15)}


def test_events_do_not_move_to_meet_the_removed_links(spark, stored_events, monkeypatch):
    """More links than small tables have are broadcast; beyond the bound events are joined as before."""
    events, path = stored_events
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 0)
    searched, plain = [], skew.hot_keys

    def counted(df, *args):
        searched.append(df.columns)
        return plain(df, *args)

    monkeypatch.setattr(skew, "hot_keys", counted)
    gone = spark.createDataFrame([(5,), (5,), (None,), (25,), (9999,)], "link_id long")
    assert cascade.delete_events(spark, path, gone) == 2
    assert not searched
    assert rows(spark.read.parquet(path).select(events.columns)) == rows(events.filter("link_id not in (5, 25)"))
    monkeypatch.setattr(cascade, "MOST_BROADCAST", 1)
    assert cascade.delete_events(spark, path, spark.createDataFrame([(6,), (None,), (26,)], "link_id long")) == 2
    assert searched
    assert rows(spark.read.parquet(path).select(events.columns)) == rows(events.filter("link_id not in (5, 25, 6, 26)"))


def test_stopped_deletions_are_finished_or_forgotten(spark, stored_events, monkeypatch):
    events, path = stored_events
    gone = spark.createDataFrame([(5,)], "link_id long")
    calls = []

    def stop(spark_, a, b):
        calls.append(a)
        raise OSError("stopped")

    monkeypatch.setattr(cascade, "move", stop)
    with pytest.raises(OSError, match="stopped"):
        cascade.delete_events(spark, path, gone)
    monkeypatch.undo()
    cascade.finish_deletion(spark, path)  # old files are gone, new ones were not in place
    cascade.finish_deletion(spark, path)
    want = rows(events.filter("link_id <> 5"))
    assert calls and rows(spark.read.parquet(path).select(events.columns)) == want
    spark.range(3).write.parquet(f"{path}/_deletion/rows")  # not committed
    cascade.finish_deletion(spark, path)
    assert rows(spark.read.parquet(path).select(events.columns)) == want


# -- layouts ---------------------------------------------------------------------------


def scan_metrics(df):
    """Files opened and rows read by the scans of a query that has run."""
    plan, out = df._jdf.queryExecution().executedPlan(), defaultdict(int)

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            for key in ("numFiles", "numOutputRows"):
                out[key] += node.metrics().apply(key).value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        return None

    walk(plan)
    return dict(out)


def test_one_link_opens_few_files(spark, stored_events, tmp_path):
    events, _ = stored_events
    path = str(tmp_path / "store")
    event_store.store_events(events.filter("link_id < 200"), path, width=10, period="yyyy-MM-dd")
    event_store.store_events(events.filter("link_id >= 200"), path, width=25, period="yyyy-MM")
    assert len(files_of(path)) == 28  # twenty days of one span each, and eight spans of a month
    for link in (7, 199, 200, 399):
        got = event_store.clicks_of_links(spark, path, [link])
        assert rows(got.select(events.columns)) == rows(events.filter(F.col("link_id") == link))
        assert scan_metrics(got)["numFiles"] <= 2
    both = event_store.clicks_of_links(spark, path, [7, 205, 5000], dt.date(2024, 1, 15), dt.date(2024, 1, 20))
    assert rows(both.select(events.columns)) == rows(events.filter("link_id = 205"))
    with pytest.raises(ValueError, match="no events"):
        event_store.clicks_of_links(spark, str(tmp_path / "nothing"), [1])


def test_a_tracking_id_opens_its_part_and_bloom_filters_skip_the_rest(spark, tmp_path):
    links = spark.range(60_000).select(
        "id", F.lit(1).cast("long").alias("campaign_id"), F.col("id").alias("recipient_id"),
        F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 48).alias("tracking_id"), F.lit(dt.datetime(2024, 1, 1)).alias("created_at"),
    )
    path = str(tmp_path / "links")
    event_store.store_links(links, path)
    assert len(files_of(path)) >= 256
    wanted = hashlib.sha256(b"777").hexdigest()[:48]
    got = event_store.links_of_tracking(spark, path, [wanted])
    assert [r["id"] for r in got.collect()] == [777] and scan_metrics(got)["numFiles"] == 1
    absent = wanted[:10] + "0" * 38
    none = event_store.links_of_tracking(spark, path, [absent])
    assert none.collect() == [] and scan_metrics(none) == {"numFiles": 1, "numOutputRows": 0}


# -- newest of each group --------------------------------------------------------------


def test_newest_of_each_department(spark, star):
    got = ranking.last_campaigns_by_department(star.recipients, star.campaigns, star.links, star.events, n=1)
    want = {("Sales", 20, 1, 0), ("Unknown", 20, 2, 1)}
    assert {(r["department"], r["campaign_id"], r["emails_sent"], r["total_clicks"]) for r in got.collect()} == want
    both = ranking.last_campaigns_by_department(star.recipients, star.campaigns, star.links, star.events)
    assert {(r["department"], r["campaign_id"], r["emails_sent"], r["click_rate"]) for r in both.collect()} == {
        ("Sales", 20, 1, 0), ("Sales", 10, 2, 250), ("Unknown", 20, 2, 50), ("Unknown", 10, 1, 100)}


def test_groups_are_cut_before_they_move(spark):
    n = F.col("id")
    many = spark.range(300_000).select(F.when(n % 3 == 0, 0).otherwise(n % 5000).alias("g"), n.alias("x"), (n % 1000).alias("tie"))
    first = ranking.first_of_each(many, ["g"], [F.desc("tie"), F.desc("x")], 4)
    plan = plan_of(first)
    limits = [m.start() for m in re.finditer("WindowGroupLimit", plan)]
    assert len(limits) == 2 and limits[0] < plan.index("Exchange") < limits[1]
    best = defaultdict(list)
    for x in range(300_000):
        best[0 if x % 3 == 0 else x % 5000].append((x % 1000, x))
    want = {(g, x) for g, found in best.items() for _, x in sorted(found, reverse=True)[:4]}
    assert {(r["g"], r["x"]) for r in first.collect()} == want

"""Skew-safe joins, consecutive ids, and the shape of plans."""

import io
from contextlib import redirect_stdout

import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from drillsight.catalog import queries as catalog
from drillsight.plans import ids, skew

SKEWED = 30_000


def explain(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture(scope="module")
def big(spark):
    """A third of the rows on one key, some without a key, the rest spread out."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 50 == 1, None).otherwise(n % 4000)
    return spark.range(SKEWED).select(n.alias("row"), key.cast("long").alias("k"))


@pytest.fixture(scope="module")
def small(spark):
    return spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[1000, 10**9], ids=["salted", "plain"])
def threshold(request, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", request.param)
    return request.param


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_join(big, small, how, threshold):
    columns = ["k", "row"] + (["v"] if how in ("inner", "left") else [])
    got = skew.lookup_join(big, small, "k", how, ["row"])
    assert ("_salt" in explain(got)) == (threshold == 1000)
    assert rows(got.select(columns)) == rows(big.join(small, "k", how).select(columns))


def test_lookup_join_keeps_repeated_keys_of_the_small_side(big, small, threshold):
    twice = small.unionByName(small.withColumn("v", -F.col("v")))
    got = skew.lookup_join(big, twice, "k", "inner", ["row"])
    assert rows(got.select("k", "row", "v")) == rows(big.join(twice, "k").select("k", "row", "v"))


def test_fanout_join_is_the_left_join(big, small, threshold):
    got = skew.fanout_join(small, big, "k", ["row"]).select("k", "v", "row")
    want = small.join(big, "k", "left").select("k", "v", "row")
    assert rows(got) == rows(want)


def test_fanout_join_with_few_rows_per_salt(spark, monkeypatch):
    """Fewer rows than salts: most repetitions are in vain, and none of them shows."""
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 3)
    many = spark.createDataFrame([(1, n) for n in range(5)] + [(2, 9)], "k long, row long")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "e")], "k long, v string")
    got = skew.fanout_join(one, many, "k", ["row"]).select("k", "v", "row")
    assert rows(got) == rows(one.join(many, "k", "left").select("k", "v", "row"))


def test_texts_as_keys(big, small, threshold):
    def texts(df):
        return df.withColumn("k", F.concat(F.lit("key '"), "k"))

    got = skew.lookup_join(texts(big), texts(small), "k", "left", ["row"])
    assert rows(got.select("k", "row", "v")) == rows(texts(big).join(texts(small), "k", "left").select("k", "row", "v"))


def test_hot_keys_are_found_and_spread(big):
    assert skew.hot_keys(big, "k", 1000) == [7]
    assert skew.hot_keys(big, "k", 400) == [7, None]
    assert skew.hot_keys(big.limit(0), "k", 1) == []
    salted = skew._salted(big, "k", [7], ["row"])
    share = salted.filter("k = 7").groupBy("_salt").count().agg(F.max("count"), F.count("*")).first()
    assert share[1] == skew.SALTS
    assert share[0] < SKEWED / 3 / skew.SALTS * 2
    assert salted.filter("k is null").select("_salt").distinct().count() == skew.SALTS
    assert salted.filter("k <> 7 and _salt > 0").count() == 0


@pytest.mark.parametrize("join", ["lookup", "fanout"])
def test_no_task_gets_the_hot_key_alone(spark, monkeypatch, join):
    """Rows per task behind the join, with a third of all rows on one key."""
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 1000)
    n = F.col("id")
    many = spark.range(300_000).select(n.alias("row"), F.when(n % 3 == 0, 7).otherwise(n % 50_000).cast("long").alias("k"))
    one = spark.range(50_000).select(n.alias("k"), (n * 2).alias("v"))
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        salted = skew.lookup_join(many, one, "k") if join == "lookup" else skew.fanout_join(one, many, "k")
        tasks = {}
        for name, df in {"plain": many.join(one, "k"), "salted": salted}.items():
            counts = df.groupBy(F.spark_partition_id().alias("task")).count()
            tasks[name] = counts.agg(F.max("count"), F.sum("count")).first()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert tasks["plain"][1] == tasks["salted"][1] == 300_000
    assert tasks["plain"][0] > 100_000
    assert tasks["salted"][0] < 25_000


def test_a_key_crowded_in_one_file_is_found(spark):
    """All rows of the key are in one of many partitions."""
    spread = spark.range(0, 20_000, 1, 20).select((F.col("id") + 100).alias("k"))
    lump = spark.range(0, 8_000, 1, 1).select(F.lit(7).cast("long").alias("k"))
    assert skew.hot_keys(spread.union(lump), "k", 5000) == [7]


def test_number_of_hot_keys_is_bounded(spark):
    many = spark.range(100_000).select((F.col("id") % 1000).alias("k"))
    assert len(skew.hot_keys(many, "k", 1)) == skew.LEAST_HOT


def test_a_fair_share_makes_a_key_hot(spark, monkeypatch):
    """With 400 partitions a key with 1/300 of the rows is hot, and 300 such keys are all found."""
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 10)
    even = spark.range(90_000).select((F.col("id") % 300).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        assert len(skew.hot_keys(even, "k")) == 300
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert skew.hot_keys(even, "k") == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wide_dimensions_are_not_broadcast(spark, big, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", 1000)
    wide = spark.range(20).select(F.col("id").alias("k"), F.lit("x" * 100).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in explain(skew.dimension_join(big, wide, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dimension_join_beyond_its_limit(big, small, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 1000)
    got = skew.dimension_join(big, small, "k", "left", max_rows=10)
    assert "_salt" in explain(got)
    assert rows(got.select("k", "row", "v")) == rows(big.join(small, "k", "left").select("k", "row", "v"))
    assert "BroadcastHashJoin" in explain(skew.dimension_join(big, small, "k", "left"))


def test_ids_follow_each_other(spark, monkeypatch):
    # Gaps, runs, and values far apart, as row numbers of several files are.
    seq = [0, 1, 2, 63, 64, 65, 1000, 1001, 2**33, 2**33 + 1, 2**40]
    df = spark.createDataFrame([(s,) for s in reversed(seq)], "seq long").repartition(5)
    got = {r["seq"]: r["id"] for r in ids.number_rows(df, "seq", F.lit(100)).collect()}
    assert [got[s] for s in seq] == list(range(100, 100 + len(seq)))
    dense = spark.range(10_000).withColumnRenamed("id", "seq")
    assert ids.number_rows(dense, "seq", F.lit(0)).filter("id <> seq").count() == 0


@pytest.mark.parametrize("gap", [1, 2**20])
def test_ids_of_dense_and_sparse_values_are_shared_among_tasks(spark, gap, monkeypatch):
    """No window or task sees more than its range of rows, however far the values lie apart."""
    written = []
    stage = ids.stage
    monkeypatch.setattr(ids, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    rows = spark.range(20_000).select((F.col("id") * gap).alias("seq")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ids.number_rows(rows, "seq", F.lit(1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered.filter(f"id <> seq / {gap} + 1").count() == 0
    assert "row_number" not in explain(numbered)
    tasks = written[0].groupBy(F.shiftright("_place", 33)).count()
    assert tasks.count() == 8 and tasks.agg(F.max("count")).first()[0] < 20_000 / 8 * 2


def test_next_id(spark):
    table = spark.createDataFrame([(4,), (9,)], "id long")
    assert spark.range(1).select(ids.next_id(table).alias("n")).first()["n"] == 10
    assert spark.range(1).select(ids.next_id(table.filter("id < 0")).alias("n")).first()["n"] == 1


REPORTS = ["department_risk", "campaign_summary", "at_risk", "recipient_engagement", "join_left_chain", "orphan_events"]


@pytest.mark.parametrize("name", REPORTS)
def test_plans_have_no_cross_join_and_prune_the_scans(spark, name):
    plan = explain(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_reports_read_two_columns_of_the_events(spark):
    plan = explain(queries()["department_risk"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_filters_reach_the_scan(spark):
    """The click type of the event table is a real predicate."""
    plan = explain(queries()["link_daily_clicks"](spark, SMALL))
    assert "EqualTo(event_type,click)" in plan


def test_newest_campaigns_cut_the_events_first(spark):
    """Events meet the few links before anything is counted; the links are filtered by campaign."""
    for name in ("last_n_campaigns", "click_rate_trend", "most_recent_campaign"):
        tree = explain(queries()[name](spark, SMALL), "simple")
        # The count of clicks stands above the semi join, and the scan of events below it.
        count, cut, scan = (tree.index(x) for x in ("keys=[link_id", "LeftSemi", "FileScan parquet [l_orderkey"))
        assert count < cut < scan, name


def test_link_analytics_read_the_clicks_once(spark):
    for name in ("link_summary_db", "link_breakdown_db"):
        plan = explain(queries()[name](spark, SMALL))
        assert plan.count("lineitem.parquet") == 1, name


def test_link_analytics_keep_to_shares_of_the_rows(spark):
    """Shuffles of clicks are not merged into few large tasks, and nothing is hashed before the first."""
    for name in ("link_summary", "link_breakdown", "link_summary_db", "link_breakdown_db"):
        tree = explain(queries()[name](spark, SMALL), "simple")
        assert "Expand" not in tree, name
        dealing = tree.index("hashpartitioning(_share")
        assert tree.count("REPARTITION_BY_NUM") == 3 and tree.index("REPARTITION_BY_NUM") < dealing, name
        scan = tree.index("FileScan parquet [l_orderkey", dealing)
        between = tree[dealing:scan]
        assert "HashAggregate(keys=[source" not in between and "HashAggregate(keys=[_share" not in between, name


def test_clicks_are_combined_before_the_shuffle(spark):
    plan = explain(queries()["department_risk"](spark, SMALL))
    assert "partial_count(1)" in plan and "partial_sum" in plan


def test_no_python_in_any_plan(spark):
    for name, f in catalog.all_queries().items():
        if not name.startswith("stream_"):
            plan = explain(f(spark, SMALL))
            assert "Python" not in plan and "InPandas" not in plan, name


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_results_do_not_depend_on_the_layout(spark, partitions):
    names = ["department_risk", "assign_links", "roster_import", "join_left_star", "last_agent"]
    want = {n: rows(queries()[n](spark, SMALL)) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: rows(queries()[n](spark, SMALL)) for n in names} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_same_results_without_broadcast_and_with_salts(spark, monkeypatch):
    """The plans of a large cluster: no side is small, and many keys are hot."""
    names = ["join_inner", "join_left_events", "join_left_chain", "join_left_star", "resolve_tracking",
             "source_priority", "orphan_events", "delete_cascade", "campaign_recipients", "link_detail"]
    want = {n: rows(queries()[n](spark, SMALL)) for n in names}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(skew, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 2)
    try:
        for n in names:
            df = queries()[n](spark, SMALL)
            assert "SortMergeJoin" in explain(df), n
            assert rows(df) == want[n], n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_agree_across_reports(spark):
    """Clicks over departments, recipients and campaigns are the events that have a link."""
    def total(name, column):
        return queries()[name](spark, MEDIUM).agg(F.sum(column)).first()[0]

    events = spark.read.parquet(f"{MEDIUM}/lineitem.parquet").count()
    orphans = queries()["orphan_events"](spark, MEDIUM).filter("table_name = 'link_events'").count()
    linked = events - orphans
    assert total("department_risk", "total_clicks") == linked
    assert total("recipient_engagement", "total_clicks") == linked
    assert total("campaign_summary", "total_clicks") == linked
    links = queries()["order_newest"](spark, MEDIUM).count()
    assert total("department_risk", "emails_sent") == links
    assert total("campaign_summary", "emails_sent") == links

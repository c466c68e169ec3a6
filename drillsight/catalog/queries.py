"""Every operator as a query over the sample tables: ``name -> f(spark, directory)``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.functions import agents, messages, network, people, rates, text
from drillsight.operators import (
    aggregates,
    cascade,
    changelog,
    filters,
    joins,
    merge,
    ordering,
    ranking,
    rollup,
    search_index,
    sets,
    sketches,
)
from drillsight.plans.buckets import store_bucketed
from drillsight.plans.clicks import last_agent_per_link
from drillsight.schemas import PROFILE_FIELDS
from drillsight.session import shared_dir, stage
from drillsight.sources import articles as news
from drillsight.sources import click_log, event_store, export, roster
from drillsight.streaming import clicks as streams
from drillsight.views import Views

Query = Callable[[SparkSession, str], DataFrame]

#: The day reports are asked for, and what the new links of a run are made with.
AS_OF = dt.date(2006, 1, 1)
CREATED_AT = dt.datetime(2006, 1, 1)
SALT = "sample"
#: Leading templates of texts that are removed.
TEMPLATES = ("SIMULATION - TRAINING PURPOSES ONLY - sample", "subject:")

_QUERIES: dict[str, Query] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a function of the views under its own name."""
    _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- sources and sinks ---------------------------------------------------------------


@query
def roster_scan(v: Views) -> DataFrame:
    rows = roster.scan_roster(v.recipients)
    return rows.select(
        "id", "firstName", "lastName", "email", "department", "jobTitle", "highRisk",
        *[F.col(f"profile.{f}").alias(f) for f in PROFILE_FIELDS],
    )


def _uploaded(v: Views, read: Callable[..., DataFrame] = roster.read_roster_csv) -> DataFrame:
    """The upload rows, written as CSV files and read back."""
    path = shared_dir(v.spark, "upload")
    rows = v.uploads.orderBy("seq").select(
        F.col("first_name").alias("firstName"), "last_name", "email", "department", F.col("job_title").alias("jobTitle")
    )
    (
        rows.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    # Read once and kept as a table: the import looks at the rows several times.
    return stage(read(v.spark, path), "upload-rows")


@query
def roster_import(v: Views) -> DataFrame:
    done = roster.import_roster(_uploaded(v), v.recipients)
    created = done.created.withColumn("error", F.lit(None).cast("string"))
    return created.unionByName(done.refused, allowMissingColumns=True)


@query
def roster_import_large(v: Views) -> DataFrame:
    """The same import with files divided among tasks by lines."""
    done = roster.import_roster(_uploaded(v, roster.read_large_roster_csv), v.recipients)
    created = done.created.withColumn("error", F.lit(None).cast("string"))
    return created.unionByName(done.refused, allowMissingColumns=True)


@query
def roster_import_summary(v: Views) -> DataFrame:
    return roster.import_roster(_uploaded(v), v.recipients).summary()


def _logged(v: Views) -> DataFrame:
    return v.click_log.select("link_key", "clicked_at", "ua", "ref", network.hash_ip(F.col("ip")).alias("ip_hash"))


@query
def click_log_scan(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "log")
    good = click_log.log_lines(_logged(v)).select(F.to_json(F.struct("*")).alias("value"))
    noise = v.events.filter(F.col("event_type") != "click").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("not json {"), "user_id")).otherwise("").alias("value")
    )
    good.unionByName(noise).write.text(path)
    return click_log.read_click_log(v.spark, path)


@query
def click_log_append(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "log")
    clicks = _logged(v)
    click_log.append_click_log(clicks.filter(F.col("ua").isNull()), path)
    click_log.append_click_log(clicks.filter(F.col("ua").isNotNull()), path)
    return click_log.read_click_log(v.spark, path)


@query
def click_log_of_requests(v: Views) -> DataFrame:
    """The whole way of a click: request, link of the file, line of the log, and back."""
    path = shared_dir(v.spark, "log")
    click_log.append_click_log(click_log.log_rows(_resolved(v)), path)
    return click_log.read_click_log(v.spark, path)


@query
def link_map_scan(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "links")
    entry = F.to_json(F.create_map("link_key", F.struct("url", "name")))
    v.link_map.select(entry.alias("value")).write.text(path)
    return click_log.read_link_map(v.spark, path, whole_files=False)


@query
def link_map_scan_objects(v: Views) -> DataFrame:
    """Link files of one object each, a hundred keys to a file."""
    path = shared_dir(v.spark, "links")
    part = F.call_function("div", F.substring("link_key", 2, 20).cast("long"), F.lit(100))
    entry = F.struct("link_key", F.struct("url", "name"))
    files = v.link_map.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    files.write.partitionBy("part").text(path)
    return click_log.read_link_map(v.spark, path)


def _articles(v: Views) -> DataFrame:
    """Articles of stored responses, twelve to a response."""
    path = shared_dir(v.spark, "news")
    article = F.struct(
        "title",
        F.col("link").alias("url"),
        F.col("published").alias("publishedAt"),
        F.struct(F.col("source").alias("name")).alias("source"),
        F.col("image").alias("urlToImage"),
        "description",
    )
    pages = v.articles.groupBy(F.expr("page_id div 12").alias("response"))
    pages.agg(F.collect_list(article).alias("articles")).select("articles").write.json(path)
    return news.read_articles(v.spark, path)


@query
def article_flatten(v: Views) -> DataFrame:
    return _articles(v)


@query
def engagement_csv(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "export")
    report = aggregates.recipient_engagement(v.recipients, v.links, v.campaigns, v.link_events)
    export.write_engagement_csv(report, path)
    return v.spark.read.text(path)


@query
def event_append(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "events")
    events = v.link_events
    streams.append_events(events.filter(F.col("user_agent").isNull()), path, "yyyy-MM")
    streams.append_events(events.filter(F.col("user_agent").isNotNull()), path, "yyyy-MM")
    return v.spark.read.parquet(path).withColumn("period", F.col("period").cast("string"))


@query
def conform_schema(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "old")
    v.recipients.drop("high_risk", "profile_json").write.parquet(path)
    return merge.conform(v.spark.read.parquet(path), "recipients")


@query
def conform_campaigns(v: Views) -> DataFrame:
    return merge.conform(v.campaigns, "campaigns")


# -- table changes -------------------------------------------------------------------


@query
def recipient_get_or_create(v: Views) -> DataFrame:
    return merge.get_or_create_recipients(v.recipients, v.recipient_requests)


@query
def recipient_update(v: Views) -> DataFrame:
    return merge.update_recipients(v.recipients, v.recipient_changes)


@query
def toggle_flag(v: Views) -> DataFrame:
    return merge.toggle_flag(v.recipients, v.toggles).select("id", "high_risk")


@query
def delete_cascade(v: Views) -> DataFrame:
    before = merge.Tables(v.recipients, v.links, v.link_events)
    after = merge.delete_recipients(before, v.toggles)

    def rows(table: str, ids: DataFrame) -> DataFrame:
        return ids.select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_id"))

    return (
        rows("recipients", after.recipients)
        .unionByName(rows("links", after.links))
        .unionByName(rows("link_events", after.events))
    )


@query
def department_insert_ignore(v: Views) -> DataFrame:
    asked = v.nation.select(F.concat(F.lit(" \t"), "n_name", F.lit(" \n")).alias("name"))
    blank = v.region.select(F.lit(" ").alias("name"))
    present = v.region.select(F.upper("r_name").alias("name"))
    return merge.insert_departments(v.departments, asked.unionByName(blank).unionByName(present))


@query
def upsert(v: Views) -> DataFrame:
    table = v.recipients.select("id", "first_name", "email", "department")
    changes = v.recipient_changes.select(F.expr("id * 20").alias("id"), "seq", "email", "department")
    return merge.upsert(table, changes, "id")


@query
def assign_links(v: Views) -> DataFrame:
    return merge.assign_links(v.links, v.link_requests, SALT, CREATED_AT)


@query
def campaign_add_by_email(v: Views) -> DataFrame:
    people, links = merge.add_to_campaign(v.recipients, v.links, v.campaign_requests, SALT, CREATED_AT)
    names = people.select(F.col("id").alias("recipient_id"), "email", F.col("is_new").alias("new_recipient"))
    return links.filter("is_new").drop("is_new").join(names, "recipient_id")


@query
def orphan_events(v: Views) -> DataFrame:
    return merge.orphans(v.link_events, v.links, v.campaigns, v.recipients)


@query
def link_drop_by_key(v: Views) -> DataFrame:
    asked = v.requests.filter(F.col("event_type") == "error").select("link_key")
    left, unknown = merge.drop_links(v.link_map, asked)
    return left.select("link_key", F.lit("kept").alias("status")).unionByName(
        unknown.select("link_key", F.lit("unknown").alias("status"))
    )


@query
def domain_check(v: Views) -> DataFrame:
    return merge.check_campaigns(v.campaign_drafts)


@query
def domain_check_untitled(v: Views) -> DataFrame:
    return merge.check_campaigns(v.campaign_drafts, untitled=merge.UNTITLED)


# -- projections, filters, predicates ------------------------------------------------


@query
def rename_columns(v: Views) -> DataFrame:
    return roster.with_web_names(v.recipients)


@query
def flag_to_bool(v: Views) -> DataFrame:
    tiny = v.recipients.select("id", F.nullif(F.col("high_risk").cast("int"), F.lit(0)).alias("flag"))
    return tiny.select("id", people.as_flag(F.col("flag")).alias("high_risk"))


@query
def profile_parse(v: Views) -> DataFrame:
    profile = people.parse_profile(F.col("profile_json"))
    return v.recipients.select(
        "id",
        profile["location"].alias("location"),
        profile["manager"].alias("manager"),
        people.profile_text(profile, F.col("high_risk")).alias("profile_text"),
    )


@query
def falsy_default(v: Views) -> DataFrame:
    return v.recipients.select(
        "id",
        text.or_else(F.col("first_name"), F.lit("")).alias("first_name"),
        text.or_else(F.col("email"), F.lit("N/A")).alias("email"),
        text.or_else(F.col("department"), F.lit("None")).alias("department"),
    )


@query
def display_name(v: Views) -> DataFrame:
    first, last = F.col("first_name"), F.col("last_name")
    return v.recipients.select(
        "id",
        people.display_name(first, last, F.col("email")).alias("display_name"),
        people.short_name(first, last).alias("short_name"),
        people.full_name(first, last).alias("full_name"),
    )


@query
def filter_departments(v: Views) -> DataFrame:
    return filters.in_departments(v.recipients, ["BUILDING", "MACHINERY"]).select("id", "email", "department")


@query
def filter_departments_table(v: Views) -> DataFrame:
    return filters.in_departments(v.recipients, v.departments).select("id", "email", "department")


@query
def filter_high_risk(v: Views) -> DataFrame:
    return filters.high_risk_of(v.recipients, v.toggles).select("id", "email", "high_risk")


@query
def filter_campaign(v: Views) -> DataFrame:
    return filters.of_campaign(v.links, 199803)


@query
def nonblank(v: Views) -> DataFrame:
    return v.recipients.filter(text.nonblank(F.col("department"))).select("id", "department")


@query
def roster_search(v: Views) -> DataFrame:
    return filters.search(v.recipients, term="rOLE 1", department="BUILDING").select("id", "job_title", "department")


@query
def rate_band(v: Views) -> DataFrame:
    risk = aggregates.department_risk(v.recipients, v.links, v.link_events)
    return risk.select("department", "click_rate", rates.rate_band(F.col("click_rate") / 12).alias("band"))


@query
def days_band(v: Views) -> DataFrame:
    days = F.datediff(F.lit(AS_OF), F.col("created_at").cast("date"))
    return v.links.select("id", days.cast("long").alias("days"), rates.days_band(days - 1000).alias("band"))


@query
def clicked_flag(v: Views) -> DataFrame:
    detail = aggregates.campaign_recipients(v.links, v.recipients, v.link_events)
    return detail.select("link_id", rates.clicked_flag(F.col("click_count")).alias("clicked"))


@query
def short_label(v: Views) -> DataFrame:
    return v.part.select(
        "p_partkey",
        text.short_label(F.col("p_name"), 20).alias("label_20"),
        text.short_label(F.col("p_name"), 14).alias("label_14"),
    )


@query
def articles_with_image(v: Views) -> DataFrame:
    return filters.with_image(_articles(v))


# -- joins ---------------------------------------------------------------------------


@query
def join_inner(v: Views) -> DataFrame:
    return joins.links_with_recipients(v.links, v.recipients)


@query
def join_left_events(v: Views) -> DataFrame:
    return joins.links_with_events(v.links, v.link_events)


@query
def join_left_chain(v: Views) -> DataFrame:
    return joins.recipients_to_events(v.recipients, v.links, v.campaigns, v.link_events)


@query
def join_left_star(v: Views) -> DataFrame:
    return joins.campaigns_to_events(v.campaigns, v.links, v.link_events)


@query
def resolve_tracking(v: Views) -> DataFrame:
    key = F.substring(F.sha2(F.col("link_id").cast("string"), 256), 1, network.KEY_LENGTH)
    requests = v.link_events.select("id", key.alias("tracking_id"))
    return joins.resolve_tracking(requests, v.links, v.campaigns)


@query
def source_priority(v: Views) -> DataFrame:
    clicks = v.click_log.select("event_id", "link_key")
    return joins.by_source_priority(clicks, v.link_map, v.short_links)


def _resolved(v: Views) -> DataFrame:
    clicks = v.requests.filter(F.col("event_type") == "click").drop("event_type")
    return joins.by_source_priority(clicks, v.link_map, v.short_links)


@query
def event_rows(v: Views) -> DataFrame:
    return click_log.event_rows(_resolved(v))


@query
def log_rows(v: Views) -> DataFrame:
    return click_log.log_rows(_resolved(v))


@query
def last_agent(v: Views) -> DataFrame:
    return last_agent_per_link(v.link_events)


@query
def link_detail(v: Views) -> DataFrame:
    return joins.link_detail(v.links, v.campaigns, v.recipients)


@query
def never_clicked(v: Views) -> DataFrame:
    return joins.never_clicked(v.recipients, v.links, v.link_events).select("id", "email")


@query
def unclicked_links(v: Views) -> DataFrame:
    return joins.unclicked_links(v.links, v.link_events).select("id", "campaign_id", "recipient_id")


# -- aggregations --------------------------------------------------------------------


@query
def recipient_engagement(v: Views) -> DataFrame:
    return aggregates.recipient_engagement(v.recipients, v.links, v.campaigns, v.link_events)


@query
def campaign_summary(v: Views) -> DataFrame:
    return ordering.newest_first(aggregates.campaign_summary(v.campaigns, v.links, v.link_events))


@query
def campaign_recipients(v: Views) -> DataFrame:
    return aggregates.campaign_recipients(v.links, v.recipients, v.link_events)


@query
def campaign_recipients_one(v: Views) -> DataFrame:
    return aggregates.campaign_recipients(v.links, v.recipients, v.link_events, campaign_id=199803)


@query
def campaign_detail(v: Views) -> DataFrame:
    return aggregates.campaign_detail(v.links, v.recipients, v.link_events)


@query
def at_risk(v: Views) -> DataFrame:
    return aggregates.at_risk(v.recipients, v.links, v.link_events)


@query
def department_risk(v: Views) -> DataFrame:
    return aggregates.department_risk(v.recipients, v.links, v.link_events)


@query
def department_risk_any_case(v: Views) -> DataFrame:
    spelled = F.when(F.col("high_risk"), F.lower("department")).otherwise(F.col("department"))
    recipients = v.recipients.withColumn("department", spelled)
    return aggregates.department_risk(recipients, v.links, v.link_events, collation="UTF8_LCASE")


def _hashed(v: Views) -> DataFrame:
    return v.click_log.withColumn("ip_hash", network.hash_ip(F.col("ip")))


@query
def link_daily_clicks(v: Views) -> DataFrame:
    return aggregates.link_daily_clicks(v.click_log)


@query
def link_agent_counts(v: Views) -> DataFrame:
    return aggregates.link_agent_counts(v.click_log)


@query
def link_unique_visitors(v: Views) -> DataFrame:
    return aggregates.link_unique_visitors(_hashed(v))


def _both_stores(v: Views) -> tuple[DataFrame, DataFrame]:
    """Links of the file and the database by their short keys, and the clicks of both."""
    detail = joins.link_detail(v.links, v.campaigns, v.recipients)
    db = v.short_links.join(detail, "link_id")
    clicks = aggregates.clicks_of_both(_hashed(v), v.link_events, v.link_map, v.short_links)
    return aggregates.known_links(v.link_map, db), clicks


def _database_only(v: Views) -> tuple[DataFrame, DataFrame]:
    """Every database link by its tracking id, and no link file."""
    db = joins.link_detail(v.links, v.campaigns, v.recipients).withColumnRenamed("tracking_id", "link_key")
    none = v.link_map.limit(0)
    return aggregates.known_links(none, db), aggregates.clicks_of_both(_hashed(v).limit(0), v.link_events)


@query
def link_summary(v: Views) -> DataFrame:
    return aggregates.link_summary(*_both_stores(v))


@query
def link_breakdown(v: Views) -> DataFrame:
    return aggregates.link_breakdown(*_both_stores(v))


@query
def link_summary_db(v: Views) -> DataFrame:
    return aggregates.link_summary(*_database_only(v))


@query
def link_breakdown_db(v: Views) -> DataFrame:
    return aggregates.link_breakdown(*_database_only(v))


@query
def overall_totals(v: Views) -> DataFrame:
    return aggregates.overall_totals(v.campaigns, v.links, v.link_events)


@query
def recipient_count(v: Views) -> DataFrame:
    return aggregates.recipient_count(v.recipients)


@query
def campaign_rates(v: Views) -> DataFrame:
    return aggregates.campaign_rates(v.campaigns, v.links, v.link_events)


@query
def string_agg_distinct(v: Views) -> DataFrame:
    return aggregates.names_by_recipient(v.links, v.campaigns)


@query
def conditional_agg(v: Views) -> DataFrame:
    return aggregates.clicked_names_by_recipient(v.links, v.campaigns, v.link_events)


@query
def delivery_outcome(v: Views) -> DataFrame:
    return aggregates.delivery_outcome(v.deliveries)


@query
def delivery_failures(v: Views) -> DataFrame:
    return aggregates.delivery_failures(v.deliveries)


@query
def distinct_departments(v: Views) -> DataFrame:
    return aggregates.distinct_departments(v.recipients)


# -- ranking and trend ---------------------------------------------------------------


@query
def last_n_campaigns(v: Views) -> DataFrame:
    return ranking.last_campaigns(v.campaigns, v.links, v.link_events, width=14)


@query
def click_rate_trend(v: Views) -> DataFrame:
    return ranking.click_rate_trend(v.campaigns, v.links, v.link_events)


@query
def most_recent_campaign(v: Views) -> DataFrame:
    return ranking.most_recent_campaign(v.campaigns, v.links, v.link_events)


@query
def days_since_last(v: Views) -> DataFrame:
    return ranking.days_since_last(v.campaigns, AS_OF)


@query
def risk_rank(v: Views) -> DataFrame:
    return ranking.ranked_at_risk(v.recipients, v.links, v.link_events)


# -- sort, limit, top-k --------------------------------------------------------------


@query
def order_by_name(v: Views) -> DataFrame:
    return ordering.by_name(v.recipients.select("id", "first_name", "last_name"))


@query
def order_detail_by_name(v: Views) -> DataFrame:
    detail = aggregates.campaign_recipients(v.links, v.recipients, v.link_events)
    return ordering.by_name(detail.select("link_id", "lastName", "firstName"), "lastName", "firstName", "link_id")


@query
def order_newest(v: Views) -> DataFrame:
    return ordering.newest_first(v.links.select("id", "created_at"))


@query
def top_k(v: Views) -> DataFrame:
    return ordering.top_by(aggregates.recipient_clicks(v.links, v.link_events), "total_clicks", 5)


@query
def dynamic_sort(v: Views) -> DataFrame:
    roster_rows = v.recipients.select("id", "first_name", "last_name", "department")
    return ordering.with_position(ordering.sorted_by(roster_rows, "department", descending=True))


@query
def order_by_clicks(v: Views) -> DataFrame:
    detail = aggregates.campaign_recipients(v.links, v.recipients, v.link_events)
    chosen = detail.select("link_id", "lastName", "firstName", "email", "click_count")
    return ordering.with_position(ordering.by_clicks(chosen))


@query
def take_first(v: Views) -> DataFrame:
    return ordering.take_first(filters.in_departments(v.recipients, None)).select("id", "email")


# -- set operations ------------------------------------------------------------------


@query
def department_union(v: Views) -> DataFrame:
    return sets.department_union(v.departments, v.recipients)


@query
def department_options(v: Views) -> DataFrame:
    return sets.department_options(v.departments, v.recipients)


@query
def union_sources(v: Views) -> DataFrame:
    db = joins.events_with_links(v.link_events, v.links).withColumnRenamed("tracking_id", "link_key")
    return sets.union_sources(_hashed(v), db)


# -- scalar functions ----------------------------------------------------------------


@query
def parse_user_agent(v: Views) -> DataFrame:
    return v.link_events.select("id", agents.parse_user_agent(F.col("user_agent")).alias("agent"))


@query
def client_ip(v: Views) -> DataFrame:
    return v.requests.select("event_id", network.client_ip(F.col("forwarded"), F.col("remote")).alias("ip"))


@query
def hash_ip(v: Views) -> DataFrame:
    return v.requests.select("event_id", network.hash_ip(text.empty_to_null(F.col("forwarded"))).alias("ip_hash"))


@query
def day_of(v: Views) -> DataFrame:
    return v.requests.select("event_id", network.day_of(F.col("clicked_at")).alias("day"))


@query
def normalize_email(v: Views) -> DataFrame:
    return v.recipient_requests.select("seq", text.normalize_email(F.col("email")).alias("email"))


@query
def message_headers(v: Views) -> DataFrame:
    return messages.split_messages(v.messages, "message", "desk@example.com").select("doc_id", "from", "subject", "body")


@query
def neutralize_links(v: Views) -> DataFrame:
    return v.messages.select(
        "doc_id",
        text.neutralize_links(F.col("message")).alias("message"),
        text.count_links(F.col("message")).alias("links"),
    )


@query
def neutralize_page_urls(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.neutralize_links(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("url"))


@query
def ensure_prefix(v: Views) -> DataFrame:
    return v.messages.select("doc_id", text.ensure_prefix(F.col("message")).alias("message"))


@query
def strip_prefixes(v: Views) -> DataFrame:
    return v.messages.select("doc_id", text.strip_prefixes(F.col("message"), TEMPLATES).alias("message"))


@query
def csv_escape(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.csv_quote(F.col("html")).alias("html"))


@query
def tracking_key(v: Views) -> DataFrame:
    key = network.tracking_key(F.col("campaign_id"), F.col("recipient_id"), SALT)
    return v.links.select("id", key.alias("tracking_key"))


@query
def nonempty_join(v: Views) -> DataFrame:
    joined = text.nonempty_join(" — ", F.col("job_title"), F.col("department"))
    return v.recipients.select("id", joined.alias("title"))


@query
def pp_text(v: Views) -> DataFrame:
    summary = aggregates.campaign_summary(v.campaigns, v.links, v.link_events)
    rate = rates.percent(F.col("total_clicks"), F.col("emails_sent"))
    return summary.select("id", rates.one_decimal(rate).alias("points"))


# -- streaming -----------------------------------------------------------------------


def _stream(v: Views) -> DataFrame:
    """The click requests of the event table, as a stream with the columns of a request."""
    # A pattern, which finds the table as one file and as a folder of files.
    events = streams.read_event_stream(v.spark, f"{v.sf_dir}/events.parquet*").filter(F.col("event_type") == "click")
    return events.select(
        "event_id",
        F.concat(F.lit("L"), "user_id").alias("link_key"),
        F.col("ts").alias("clicked_at"),
        network.hash_ip(F.concat(F.lit("10.1.0."), F.col("event_id") % 97)).alias("ip_hash"),
    )


def _run(v: Views, label: str, start: Callable[[DataFrame, str, str], object]) -> DataFrame:
    """Run a stream over what is there, and read the table it wrote."""
    base = shared_dir(v.spark, label)
    streams.finish(start(_stream(v), f"{base}/table", f"{base}/checkpoint"))
    return v.spark.read.parquet(f"{base}/table")


@query
def stream_clicks(v: Views) -> DataFrame:
    table = _run(v, "clicks", lambda s, out, cp: streams.store_clicks(s, v.link_map, v.short_links, out, cp))
    return table.select("event_id", "link_key", "url", "link_id", "source", "status", F.col("day").cast("string").alias("day"))


@query
def stream_daily_clicks(v: Views) -> DataFrame:
    return streams.summed_counts(_run(v, "daily", streams.store_daily_counts))


@query
def stream_daily_deltas(v: Views) -> DataFrame:
    """The same counts, read after the batches have been compacted."""
    base = shared_dir(v.spark, "deltas")
    table, compacted = f"{base}/table", f"{base}/compacted"
    streams.finish(streams.store_daily_counts(_stream(v), table, f"{base}/checkpoint"))
    streams.compact(v.spark, table, compacted, upto=0)
    return streams.summed_counts(streams.read_table(v.spark, table, compacted))


@query
def stream_unique_visitors(v: Views) -> DataFrame:
    return streams.visitor_counts(_run(v, "visitors", streams.store_visitors))


# -- kept tables: sketches, roll-ups, change logs, layouts ------------------------------


def _beside_exact(v: Views, estimated: DataFrame, by: list[str], exact: DataFrame) -> DataFrame:
    """Clicks and distinct visitors by exact count, and whether the estimate is within its bound."""
    close = sketches.within(F.col("estimate"), F.col("unique_users")).alias("within_bound")
    rows = estimated.withColumnRenamed("unique_users", "estimate").join(exact, by)
    return rows.select(*by, "clicks", "unique_users", close)


@query
def link_visitor_sketches(v: Views) -> DataFrame:
    """Visitors per link out of stored sketches by link and day."""
    stored = stage(sketches.sketch_visitors(_hashed(v)), "sketches")
    estimated = sketches.estimates(sketches.merge_sketches(stored, ["link_key"]))
    return _beside_exact(v, estimated, ["link_key"], aggregates.link_unique_visitors(_hashed(v)))


@query
def link_month_visitors(v: Views) -> DataFrame:
    """Visitors per link and month, out of the same sketches."""
    stored = stage(sketches.sketch_visitors(_hashed(v)), "sketches")
    estimated = sketches.visitors_by_span(stored, F.substring("day", 1, 7), "month")
    month = F.date_format("clicked_at", "yyyy-MM").alias("month")
    exact = _hashed(v).groupBy("link_key", month).agg(F.count_distinct("ip_hash").alias("unique_users"))
    return _beside_exact(v, estimated, ["link_key", "month"], exact)


@query
def stream_visitor_sketches(v: Views) -> DataFrame:
    """Visitors per link out of a stream that keeps no state, read after its batches were merged."""
    base = shared_dir(v.spark, "visitor-sketches")
    table, compacted = f"{base}/table", f"{base}/compacted"
    streams.finish(streams.store_visitor_sketches(_stream(v), table, f"{base}/checkpoint"))
    by_day = ["link_key", "day"]
    streams.compact(v.spark, table, compacted, 0, lambda rows: sketches.merge_sketches(rows, by_day))
    stored = streams.visitor_sketches(streams.read_table(v.spark, table, compacted))
    estimated = sketches.estimates(sketches.merge_sketches(stored, ["link_key"]))
    return _beside_exact(v, estimated, ["link_key"], aggregates.link_unique_visitors(_hashed(v)))


def _rolled(v: Views, folded: bool = False) -> DataFrame:
    """All clicks in four batches: two merged into the roll-up, one merged later, one not yet."""
    base = shared_dir(v.spark, "rollup")
    table, root = f"{base}/events", f"{base}/daily"
    batch = F.pmod(F.xxhash64("id"), F.lit(4))
    for n in range(4):
        rollup.append_batch(v.link_events.filter(batch == n), table, n)
        if n in (1, 2):
            rollup.merge_batches(v.spark, table, root)
    if folded:
        rollup.fold_parts(v.spark, root)
    return rollup.clicks(v.spark, table, root)


@query
def rollup_engagement(v: Views) -> DataFrame:
    return aggregates.recipient_engagement(v.recipients, v.links, v.campaigns, _rolled(v))


@query
def rollup_campaign_summary(v: Views) -> DataFrame:
    return aggregates.campaign_summary(v.campaigns, v.links, _rolled(v, folded=True))


@query
def rollup_campaign_recipients(v: Views) -> DataFrame:
    return aggregates.campaign_recipients(v.links, v.recipients, _rolled(v))


@query
def rollup_at_risk(v: Views) -> DataFrame:
    return aggregates.at_risk(v.recipients, v.links, _rolled(v, folded=True))


@query
def rollup_department_risk(v: Views) -> DataFrame:
    return aggregates.department_risk(v.recipients, v.links, _rolled(v))


@query
def changelog_update(v: Views) -> DataFrame:
    """Full-row updates as one change set, merged on read."""
    table = changelog.create(v.spark, shared_dir(v.spark, "people"), v.recipients, "id", buckets=16)
    changes = v.recipient_changes
    changelog.change(table, changes, lambda rows: merge.update_recipients(rows, changes))
    return changelog.read(table)


@query
def changelog_toggle(v: Views) -> DataFrame:
    """Two sets of flips with a compaction between them, then a third that undoes the second."""
    table = changelog.create(v.spark, shared_dir(v.spark, "people"), v.recipients, "id", buckets=16)

    def flip(rows: DataFrame) -> DataFrame:
        return merge.toggle_flag(rows, v.toggles)

    changelog.change(table, v.toggles, flip)
    changelog.compact(table)
    changelog.change(table, v.toggles, flip)
    changelog.change(table, v.toggles, flip)
    return changelog.read(table).select("id", "high_risk")


@query
def changelog_upsert(v: Views) -> DataFrame:
    """Inserts and overwrites as one change set, compacted."""
    people = v.recipients.select("id", "first_name", "email", "department")
    table = changelog.create(v.spark, shared_dir(v.spark, "people"), people, "id", buckets=16)
    changes = v.recipient_changes.select(F.expr("id * 20").alias("id"), "seq", "email", "department")
    changelog.change(table, changes, lambda rows: merge.upsert(rows, changes, "id"))
    changelog.compact(table)
    changelog.clean(table)
    return changelog.read(table)


@query
def changelog_delete(v: Views) -> DataFrame:
    table = changelog.create(v.spark, shared_dir(v.spark, "people"), v.recipients, "id", buckets=16)
    changelog.delete(table, v.toggles)
    return changelog.read(table)


@query
def delete_cascade_files(v: Views) -> DataFrame:
    """The cascade over events in files: only files with removed clicks are rewritten."""
    path = shared_dir(v.spark, "events")
    streams.append_events(v.link_events, path, "yyyy-MM")
    after = cascade.delete_recipients_by_file(v.spark, merge.Tables(v.recipients, v.links, v.link_events), path, v.toggles)

    def rows(table: str, ids: DataFrame) -> DataFrame:
        return ids.select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("row_id"))

    kept = rows("recipients", after.recipients).unionByName(rows("links", after.links))
    return kept.unionByName(rows("link_events", after.events))


@query
def clicks_of_link(v: Views) -> DataFrame:
    """The events of the newest link, out of a store laid out for that."""
    path = shared_dir(v.spark, "store")
    event_store.store_events(v.link_events, path, width=10_000, period="yyyy")
    newest = v.links.agg(F.max("id")).first()[0]
    return event_store.clicks_of_links(v.spark, path, [newest])


@query
def link_of_tracking(v: Views) -> DataFrame:
    """The link with the smallest tracking id, out of a store laid out for that."""
    path = shared_dir(v.spark, "links")
    event_store.store_links(v.links, path)
    return event_store.links_of_tracking(v.spark, path, [v.links.agg(F.min("tracking_id")).first()[0]])


@query
def resolve_tracking_bucketed(v: Views) -> DataFrame:
    """Requests against links kept in buckets of their tracking id."""
    key = F.substring(F.sha2(F.col("link_id").cast("string"), 256), 1, network.KEY_LENGTH)
    requests = v.link_events.select("id", key.alias("tracking_id"))
    links = store_bucketed(v.links, "tracking_id", 16, shared_dir(v.spark, "links"))
    return joins.resolve_tracking(requests, links, v.campaigns, bucketed=True)


@query
def join_left_chain_bucketed(v: Views) -> DataFrame:
    """Recipients and links kept in buckets of the recipient."""
    people = store_bucketed(v.recipients, "id", 16, shared_dir(v.spark, "people"))
    links = store_bucketed(v.links, "recipient_id", 16, shared_dir(v.spark, "links"))
    return joins.recipients_to_events(people, links, v.campaigns, v.link_events, bucketed=True)


@query
def roster_search_indexed(v: Views) -> DataFrame:
    """The search of ``roster_search`` through an index of trigrams."""
    path = shared_dir(v.spark, "index")
    search_index.build_index(v.recipients, path)
    found = search_index.search_indexed(v.recipients, path, term="rOLE 1", department="BUILDING")
    return found.select("id", "job_title", "department")


@query
def last_campaigns_by_department(v: Views) -> DataFrame:
    return ranking.last_campaigns_by_department(v.recipients, v.campaigns, v.links, v.link_events)

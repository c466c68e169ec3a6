"""Streams end where batches do, also in several steps and after a restart."""

import shutil

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from drillsight.functions import network
from drillsight.streaming import clicks as streams
from drillsight.views import Views


FILES = 8


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def arriving(spark, tmp_path):
    """Eight event files that arrive one after the other, each with rows of all days."""
    folder = tmp_path / "in"
    folder.mkdir()
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(FILES)))
    parts = []
    for n, part in enumerate((5, 0, 7, 2, 1, 6, 3, 4)):
        out = tmp_path / f"p{n}"
        events.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(out))
        parts.append(next(out.glob("*.parquet")))

    def deliver(n):
        shutil.copy(parts[n], folder / f"events-{n}.parquet")

    def stream():
        source = streams.read_event_stream(spark, f"{folder}/events-*.parquet", per_batch=1)
        return source.filter("event_type = 'click'").select(
            "event_id", F.concat(F.lit("L"), "user_id").alias("link_key"), F.col("ts").alias("clicked_at"),
            network.hash_ip(F.concat(F.lit("10.1.0."), F.col("event_id") % 97)).alias("ip_hash"),
        )

    return deliver, stream


def drive(arriving, start, out, checkpoint):
    """Deliver in two goes, with a stop between them."""
    deliver, stream = arriving
    deliver(0)
    deliver(1)
    streams.finish(start(stream(), out, checkpoint))
    for n in range(2, FILES):
        deliver(n)
    streams.finish(start(stream(), out, checkpoint))


def test_stored_clicks(spark, arriving, tmp_path):
    v = Views(spark, SMALL)
    out = str(tmp_path / "out")
    drive(arriving, lambda s, o, c: streams.store_clicks(s, v.link_map, v.short_links, o, c), out, str(tmp_path / "cp"))
    table = spark.read.parquet(out)
    assert table.select("batch").distinct().count() == FILES
    columns = ["event_id", "link_key", "url", "link_id", "source", "status"]
    want = queries()["stream_clicks"](spark, SMALL).select(columns)
    assert rows(table.select(columns)) == rows(want)


def test_daily_counts_take_every_click(spark, arriving, tmp_path):
    """Whatever the number and order of files, with the defaults."""
    out = str(tmp_path / "out")
    drive(arriving, streams.store_daily_counts, out, str(tmp_path / "cp"))
    want = queries()["link_daily_clicks"](spark, SMALL)
    assert rows(streams.summed_counts(spark.read.parquet(out))) == rows(want)


def test_compacted_batches_read_the_same(spark, arriving, tmp_path):
    out, small = str(tmp_path / "out"), str(tmp_path / "compacted")
    drive(arriving, streams.store_daily_counts, out, str(tmp_path / "cp"))
    want = rows(queries()["link_daily_clicks"](spark, SMALL))
    assert rows(streams.summed_counts(streams.read_table(spark, out, small))) == want
    for upto in (2, 5, 5, FILES - 1):  # one of them runs twice
        streams.compact(spark, out, small, upto)
        assert rows(streams.summed_counts(streams.read_table(spark, out, small))) == want
    days = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("day=")]
    assert days and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]


def test_visitors(spark, arriving, tmp_path):
    out = str(tmp_path / "out")
    drive(arriving, streams.store_visitors, out, str(tmp_path / "cp"))
    want = queries()["link_unique_visitors"](spark, SMALL)
    assert rows(streams.visitor_counts(spark.read.parquet(out))) == rows(want)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([("a", "2024-01-01", 2), ("a", "2024-01-02", 1)], "link_key string, day string, clicks long")
    streams._write_batch(batch, out, 0)
    streams._write_batch(batch, out, 0)
    streams._write_batch(batch, out, 1)
    got = rows(streams.summed_counts(spark.read.parquet(out)))
    assert got == [("a", "2024-01-01", 4), ("a", "2024-01-02", 2)]


def test_failure_is_passed_on(spark, arriving, tmp_path):
    deliver, stream = arriving
    deliver(0)

    def fail(batch, batch_id):
        raise RuntimeError("no")

    query = (
        stream().writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    with pytest.raises(Exception, match="no"):
        streams.finish(query)

"""Fixed schemas of the tables and files the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

RECIPIENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("high_risk", T.BooleanType()),
        T.StructField("profile_json", T.StringType()),
    ]
)

CAMPAIGNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("redirect_to", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("campaign_id", T.LongType()),
        T.StructField("recipient_id", T.LongType()),
        T.StructField("tracking_id", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

LINK_EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("link_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

#: One line of the click log.
CLICK_LINE = T.StructType(
    [
        T.StructField("linkId", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("ua", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("ipHash", T.StringType()),
    ]
)

#: Entries of the keyed link file.
LINK_MAP = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType())]),
)

#: The fields of a personal profile.
PROFILE_FIELDS = ("linkedin", "social", "location", "manager", "interests", "projects", "notes")
PROFILE = T.StructType([T.StructField(f, T.StringType()) for f in PROFILE_FIELDS])

#: A news response: a list of articles, each with a nested source.
ARTICLES = T.StructType(
    [
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("title", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("publishedAt", T.StringType()),
                        T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
                        T.StructField("urlToImage", T.StringType()),
                        T.StructField("description", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

#: Source table of the click stream in the test data.
STREAM_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

"""Addresses, days and keys of tracked links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drillsight.functions.text import empty_to_null, web_trim

# Fixed value: hex digits in a tracking key.
KEY_LENGTH = 48


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First address of the forwarding header, else the socket address, else empty."""
    first = web_trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(empty_to_null(forwarded).isNotNull(), first).otherwise(
        F.coalesce(remote, F.lit(""))
    )


def hash_ip(ip: Column) -> Column:
    return F.sha2(F.coalesce(ip, F.lit("")), 256)


def day_of(ts: Column) -> Column:
    """UTC day as ``YYYY-MM-DD``; works on timestamps and on ISO texts."""
    return F.substring(ts.cast("string"), 1, 10)


def tracking_key(campaign_id: Column, recipient_id: Column, salt: str) -> Column:
    """Key of a (campaign, recipient) pair: the same on every run and retry.

    The salt keeps keys of one installation from being guessed by another, so it
    should be a secret of the caller.
    """
    return F.substring(
        F.sha2(F.concat_ws("|", campaign_id, recipient_id, F.lit(salt)), 256), 1, KEY_LENGTH
    )

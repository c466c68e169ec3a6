"""Sender, subject and body of messages held in one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillsight.functions.text import (
    WEB_SPACE_CLASS,
    empty_to_null,
    neutralize_links,
    or_else,
    strict_object,
    web_ltrim,
    web_trim,
)

# The ends of a line, header lines, the label line, and the subject of a
# message without one.  A header may stand after white space, and its value may follow on
# a later line; white space is that of web clients.
_ENDS = "\n\r" + chr(0x2028) + chr(0x2029)


def _header(name: str) -> str:
    # The look behind is true at the start of a line.
    return f"(?i)(?<![^{_ENDS}]){WEB_SPACE_CLASS}*+{name}:{WEB_SPACE_CLASS}*([^{_ENDS}]+)"


FROM_LINE = _header("From")
SUBJECT_LINE = _header("Subject")
LABEL_LINE = r"(?i)\ASIMULATION[^\n]*\n*"
NO_SUBJECT = "(No Subject)"

JSON_FORM = "`from`: string, subject: string, body: string"


def _cut_first(df: DataFrame, text: str, piece: str) -> DataFrame:
    """Remove the first occurrence of ``piece`` in ``text`` and trim; unchanged where it is empty."""
    whole, part = F.col(text), F.col(piece)
    at = F.instr(whole, part)
    rest = F.concat(F.substr(whole, F.lit(1), at - 1), F.substr(whole, at + F.length(part)))
    cut = df.withColumn("_rest", F.when(part != "", rest))
    return cut.withColumn(text, F.when(part == "", whole).otherwise(web_trim(F.col("_rest")))).drop("_rest")


def _find(text: Column, name: str, pattern: str) -> Column:
    """The header line, or empty.  Most texts do not even hold the word, which is seen faster."""
    return F.when(text.rlike(f"(?i){name}:"), F.regexp_extract(text, pattern, 0)).otherwise("")


def split_headers(df: DataFrame, text: str, default_from: str | None = None) -> DataFrame:
    """Add ``from``, ``subject`` and ``body`` of a text with optional header lines.

    Done in steps, each a projection, so that no pattern is searched twice.
    """
    found = df.withColumns(
        {
            "_from": _find(F.col(text), "From", FROM_LINE),
            "_subject": _find(F.col(text), "Subject", SUBJECT_LINE),
        }
    )
    cut = _cut_first(found.withColumn("_body", F.col(text)), "_body", "_from")
    cut = _cut_first(cut, "_body", "_subject")
    no_sender = F.lit(default_from).cast("string")
    return cut.withColumns(
        {
            "from": F.when(F.col("_from") == "", no_sender).otherwise(web_trim(F.regexp_extract("_from", FROM_LINE, 1))),
            "subject": F.when(F.col("_subject") == "", NO_SUBJECT).otherwise(web_trim(F.regexp_extract("_subject", SUBJECT_LINE, 1))),
            "body": or_else(F.col("_body"), F.col(text)),
        }
    ).drop("_from", "_subject", "_body")


def split_messages(df: DataFrame, message: str, default_from: str | None = None) -> DataFrame:
    """Add ``from``, ``subject`` and ``body`` of a message in JSON form or as plain text.

    A JSON message counts as such if it has a subject or a body.  Plain texts lose their
    label line, and their links are replaced by a marker.
    """
    raw = F.coalesce(F.col(message), F.lit(""))
    form = strict_object(raw, JSON_FORM)
    has_form = F.coalesce(empty_to_null(F.col("_form.subject")), empty_to_null(F.col("_form.body")))
    unix = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    plain = df.withColumn("_form", form).withColumn("_has_form", has_form.isNotNull())
    plain = plain.withColumn("_text", F.when(F.col("_has_form"), "").otherwise(web_ltrim(unix)))
    plain = plain.withColumn("_text", F.regexp_replace("_text", LABEL_LINE, ""))
    split = split_headers(plain.withColumn("_text", web_trim(F.col("_text"))), "_text", default_from)
    by_form = {
        "from": or_else(F.col("_form.from"), F.lit(default_from).cast("string")),
        "subject": or_else(F.col("_form.subject"), F.lit(NO_SUBJECT)),
        "body": F.coalesce(F.col("_form.body"), F.lit("")),
    }
    by_text = {"from": F.col("from"), "subject": F.col("subject"), "body": neutralize_links(F.col("body"))}
    return split.withColumns(
        {c: F.when(F.col("_has_form"), by_form[c]).otherwise(by_text[c]) for c in by_form}
    ).drop("_form", "_has_form", "_text")

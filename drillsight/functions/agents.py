"""Browser and operating system names from user-agent texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, first match wins: Edge and Opera also say "Chrome/", Chrome also says
# "Safari/", Android also says "Linux", iPhones also say "Mac OS X".
BROWSERS = (
    ("Edge", ("Edg/",)),
    ("Opera", ("OPR/", "Opera")),
    ("Chrome", ("Chrome/",)),
    ("Firefox", ("Firefox/",)),
    ("Safari", ("Safari/",)),
)
SYSTEMS = (
    ("Windows", ("Windows NT",)),
    ("Android", ("Android",)),
    ("iOS", ("iPhone", "iPad")),
    ("macOS", ("Mac OS X",)),
    ("Linux", ("Linux",)),
)


def _first_match(agent: Column, table, default: str) -> Column:
    hits = [F.when(agent.contains(mark), name) for name, marks in table for mark in marks]
    return F.coalesce(*hits, F.lit(default))


def parse_user_agent(agent: Column) -> Column:
    """``Browser / OS``, or a dash where there is no agent."""
    named = F.concat_ws(
        " / ",
        _first_match(agent, BROWSERS, "Unknown Browser"),
        _first_match(agent, SYSTEMS, "Unknown OS"),
    )
    return F.when(F.nullif(agent, F.lit("")).isNull(), "—").otherwise(named)


def agent_or_unknown(agent: Column) -> Column:
    return F.coalesce(F.nullif(agent, F.lit("")), F.lit("unknown"))

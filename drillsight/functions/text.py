"""Rules for text columns: what counts as missing, trimming, joining, quoting, links.

Three notions of "missing" occur in the data and give different answers:
*null*, *empty* (null or ``''``) and *blank* (null or only spaces).
Each has its own helper here, and every operator uses these.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser's string trim removes.
WEB_SPACE = "\t\n\x0b\x0c\r " + "".join(
    map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
)
WEB_SPACE_CLASS = f"[{WEB_SPACE}]"
# The pattern of a web link and the marker that stands for one.
LINK_PATTERN = f"(?i)https?://[^{WEB_SPACE}]+"
LINK_MARKER = "[SIMULATED LINK]"
# The training label and the start by which it is recognised.
TRAINING_LABEL = (
    "SIMULATION - TRAINING PURPOSES ONLY - THIS IS JUST FOR EDUCATIONAL/PRACTICING PURPOSES"
)
TRAINING_LABEL_START = "SIMULATION - TRAINING PURPOSES ONLY"


def web_trim(c: Column) -> Column:
    """Trim all white space, as web clients do; SQL ``trim`` removes spaces only."""
    return F.trim(c, F.lit(WEB_SPACE))


def web_ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(WEB_SPACE))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_else(*choices: Column) -> Column:
    """First choice that is neither null nor empty; the last one is taken as it is."""
    *tried, last = choices
    return F.coalesce(*[empty_to_null(c) for c in tried], last)


def collated(c: Column, collation: str | None) -> Column:
    """``c`` compared by a collation, for example ``UTF8_LCASE`` to ignore case; None compares exactly."""
    return c if collation is None else F.collate(c, collation)


def nonblank(c: Column) -> Column:
    """True where something is left after trimming spaces (false for null)."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def nonempty_join(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[empty_to_null(p) for p in parts])


def short_label(c: Column, width: int = 20) -> Column:
    """Cut labels longer than ``width`` and mark the cut."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def normalize_email(c: Column) -> Column:
    return F.lower(web_trim(c))


def csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def neutralize_links(c: Column, marker: str = LINK_MARKER) -> Column:
    """Replace every web link in the text by ``marker``."""
    literal = marker.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(_may_hold_links(c), F.regexp_replace(c, LINK_PATTERN, literal)).otherwise(c)


def count_links(c: Column) -> Column:
    none = F.when(c.isNotNull(), F.lit(0))
    return F.when(_may_hold_links(c), F.regexp_count(c, F.lit(LINK_PATTERN))).otherwise(none).cast("long")


def _may_hold_links(c: Column) -> Column:
    """A plain search, much faster than the pattern, which most texts thus never meet."""
    return c.contains("://")


def ensure_prefix(c: Column, label: str = TRAINING_LABEL, known_by: str = TRAINING_LABEL_START) -> Column:
    """Put ``label`` and a blank line in front of texts that do not start with it yet."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.startswith(text, F.lit(known_by)), text).otherwise(
        F.concat(F.lit(label + "\n\n"), text)
    )


def strip_prefixes(c: Column, templates: Sequence[str]) -> Column:
    """Remove each leading template in turn, and the white space behind it."""

    def strip_one(text: Column, template: str) -> Column:
        rest = F.substr(text, F.lit(len(template) + 1))
        return F.when(F.startswith(text, F.lit(template)), web_ltrim(rest)).otherwise(text)

    return reduce(strip_one, [t for t in templates if t], F.coalesce(c, F.lit("")))


def strict_object(text: Column, schema: str) -> Column:
    """A text that is one JSON object as a struct of ``schema`` (as DDL); null for any other.

    Spark's parser stops at the end of a value and takes what follows for granted.  Inside a
    list, a tail other than ``]`` is an error, and inside an object a tail other than ``}``;
    a text that passes both has none.  Of repeated keys the last counts, as on the web.
    """
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>", options)
    held = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v struct<{schema}>", options)
    whole = (F.size(listed) == 1) & held["v"].isNotNull()
    return F.when(F.startswith(web_ltrim(text), F.lit("{")) & whole, listed[0])

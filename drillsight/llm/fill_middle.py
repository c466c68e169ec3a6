"""Fill-in-the-middle rearrangement of texts, by one regular expression match per row.

``regexp_count`` gives the number n of units of a text.  Two draws between 0 and n are the ends
of prefix and middle, and a pattern made for the row, ``(unit{a}+)(unit{b-a}+)(rest)`` with
possessive quantifiers, captures prefix, middle and suffix in one match whose replacement
writes them in their new order.  A possessive group is repeated in a loop, so texts of millions
of units need no stack, and nothing is tried twice.

Draws come from the SHA-256 of ``<seed>:<key>``, so a row that is computed again comes out the
same.  Everything is column expressions, row by row: no shuffle, no Python.

Rules: a null text is the empty text, which stays plain; a null key draws as an empty one.  A text
that holds one of the marks stays plain, since its marks could not be told from ours.  Prefix,
middle or suffix may be empty.  Repeated rows with one key give repeated results.  Other columns
are kept, and may have any name but those of the result, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import table

#: A unit of text; units cover every text.
UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are rearranged, and of those the ones with the suffix in front.
RATE, SUFFIX_FIRST = 90, 20


def _draw(key: Column, seed: int, place: int) -> Column:
    """The ``place``-th (from 0) 32-bit number of the row's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def _pattern(first: Column, second: Column) -> Column:
    """The row's pattern: ``first`` units, ``second`` units, the rest."""
    unit = F.lit(f"((?:{UNIT}){{")
    return F.concat(F.lit(r"(?s)\A"), unit, first, F.lit("}+)"), unit, second, F.lit(r"}+)(.*+)\z"))


def rearrange(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (``plain``, ``psm``, ``spm``), ``prefix_chars`` and
    ``middle_chars`` (null if plain), and ``output``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    key_column, last = F.col(key), F.col("n") + 1
    ends = [_draw(key_column, seed, place) % last for place in (0, 1)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | whole.contains(mark)
    form = (
        F.when((whole == "") | marked | (_draw(key_column, seed, 2) % 100 >= rate), "plain")
        .when(_draw(key_column, seed, 3) % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    # The match is made where a text is rearranged; a group keeps its number in either order.
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    a, b = F.least(*ends), F.greatest(*ends)
    output = F.when(F.col("form") == "plain", whole).otherwise(
        F.regexp_replace(whole, _pattern(a.cast("string"), (b - a).cast("string")), order)
    )
    made = docs.withColumns({"n": F.regexp_count(whole, F.lit(UNIT)).cast("long"), "form": form}).withColumn("output", output)
    prefix, middle, _ = parts(F.col("output"), F.col("form"))
    return made.withColumns(
        {"prefix_chars": F.char_length(prefix).cast("long"), "middle_chars": F.char_length(middle).cast("long")}
    )


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output; null for a plain one.

    Each mark stands once in it, and none can arise where two parts meet: a mark opens with the
    only ``<`` that it has.
    """
    cut = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    spm, psm = form == "spm", form == "psm"
    prefix = F.when(spm, F.get(cut, F.lit(2))).when(psm, F.get(cut, F.lit(1)))
    suffix = F.when(spm, F.get(cut, F.lit(1))).when(psm, F.get(cut, F.lit(2)))
    return prefix, F.when(spm | psm, F.get(cut, F.lit(3))), suffix


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of."""
    prefix, middle, suffix = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digest columns of all documents."""
    made = rearrange(table(spark, folder, "documents").select("doc_id", "text"))
    digest = [
        F.sha2(x.cast("binary"), 256).alias(name)
        for x, name in (
            (F.col("output"), "output_sha256"),
            (restore(F.col("output"), F.col("form")), "restored_sha256"),
        )
    ]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)

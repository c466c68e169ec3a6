"""Quality rules: frequent lines of a host, and documents that little is left of.

Each document gives its base figures and a 128-bit hash of every normalised line.  Lines are
counted by host, in distinct documents (equal texts are one document).  A line in more than
``max(LEAST, square root of the host's distinct documents)`` of them is boilerplate and removed.
A document that has too few words left, or too small a share of them, is rejected.

Rules: a null text has no words and fails.  Lines without words are never counted.  A null
host is a host of its own.  Repeated rows are judged each, and count as one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import free_name, steps, table, whole_texts
from drillsight.session import stage

#: Base rules, fixed by the contract.
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Distinct documents of a host that may share a line, however small the host.
LEAST = 20
#: Words, and share of its words, that a document has to keep.
KEEP_WORDS = 10
KEEP_SHARE = 0.4
#: Sub-keys that a line is spread over when its documents are looked up.
SALTS = 16

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(r"\d")


def normalised(line: str) -> bytes:
    """Lower case, digits as 0, single spaces."""
    return b" ".join(_DIGITS.sub("0", line.lower()).encode("utf-8", "surrogatepass").split())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    n = len(ids) - window + 1
    if len(numbers) == len(words):
        return 0
    own = np.zeros(n, np.uint64)
    for k in range(window):
        own = own * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
        own ^= own >> np.uint64(29)
    order = np.argsort(own, kind="stable")
    a, b = order[:-1], order[1:]
    same = own[a] == own[b]
    a, b = a[same], b[same]
    begins = np.zeros(n, bool)
    begins[a] = begins[b] = True
    if any((ids[a + k] != ids[b + k]).any() for k in range(window)):  # a collision: count the windows
        places: dict[tuple, list[int]] = {}
        for k in range(n):
            places.setdefault(tuple(words[k : k + window]), []).append(k)
        begins[:] = False
        begins[[k for found in places.values() if len(found) > 1 for k in found]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change) > 0).sum())


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip(_SPACE)]
    return (
        len(words),
        len(text) - len(raw) + len(raw.translate(None, _SPACE)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host, mark``, the base figures, and ``lines``: hash, number and words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 3):
            texts = whole_texts(batch.column(3))
            found = [base_figures(x) for x in texts]
            hashes, numbers, words, counts = [], [], [], []
            for text in texts:
                before = len(hashes)
                for number, line in enumerate(text.split("\n")):
                    if plain := normalised(line):
                        hashes.append(xxhash.xxh3_128_digest(plain))
                        numbers.append(number)
                        words.append(plain.count(b" ") + 1)
                counts.append(len(hashes) - before)
            lines = pa.StructArray.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(numbers, pa.int32()), pa.array(words, pa.int32())],
                ["hash", "number", "words"],
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3]]
                + [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                + [pa.ListArray.from_arrays(offsets, lines)],
                ["doc_id", "host", "mark", *_FIGURES, "lines"],
            )

    return docs.select(
        "doc_id", F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))), "text"
    ).mapInArrow(
        run,
        "doc_id long, host string, mark long, "
        + ", ".join(f"{c} long" for c in _FIGURES)
        + ", lines array<struct<hash:binary,number:int,words:int>>",
    )


def judge(
    docs: DataFrame, host: str = "source", least: int = LEAST, keep_share: float = KEEP_SHARE
) -> DataFrame:
    """A row for each document: base figures, ``removed_lines`` (their numbers, from 0),
    ``words_left``, ``base_failed`` and ``kept``."""
    own = stage(figures(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-figures")
    host_key = F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))
    lines = own.select("row", "mark", host_key.alias("host"), F.explode("lines").alias("line")).select(
        "row", "mark", "host", "line.*"
    )
    counts = lines.groupBy("host", "hash").agg(F.count_distinct("mark").alias("n")).filter(F.col("n") > least)
    sizes = own.groupBy(host_key.alias("host")).agg(F.count_distinct("mark").alias("size"))
    often = counts.join(sizes, "host").filter(F.col("n") > F.sqrt("size")).select("host", "hash")
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    removed = (
        lines.drop("mark")
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        .join(often, ["host", "hash", "salt"])
        .groupBy("row")
        .agg(F.sum("words").alias("words_removed"), F.sort_array(F.collect_list("number")).alias("removed_lines"))
    )
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    left = F.col("words_left")
    return (
        own.drop("lines")
        .join(removed, "row", "left")
        .withColumn("words_left", n - F.coalesce("words_removed", F.lit(0)))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= KEEP_WORDS) & (left >= keep_share * n))
        .drop("words_removed", "row")
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, k: ~F.array_contains(removed, k)), "\n")


def cleaned(docs: DataFrame, host: str = "source", **rules: float) -> DataFrame:
    """The kept documents, all their columns, with the frequent lines taken out of the text."""
    verdicts = judge(docs, host, **rules).filter("kept")
    # Rows of equal host and text have equal verdicts, whatever their id.
    own, mark, removed = (free_name(x, docs.columns) for x in ("_host", "_mark", "_removed"))
    chosen = verdicts.groupBy(F.col("host").alias(own), F.col("mark").alias(mark)).agg(
        F.first("removed_lines").alias(removed)
    )
    same = F.col(host).cast("string").eqNullSafe(F.col(own)) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(mark)
    )
    return (
        docs.join(chosen, same)
        .withColumn("text", without_lines(F.col("text"), F.col(removed)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return judge(table(spark, folder, "documents").select("doc_id", "text", "source")).select(
        "doc_id", *_FIGURES, "base_failed", "kept", "words_left", F.size("removed_lines").alias("lines_removed")
    )

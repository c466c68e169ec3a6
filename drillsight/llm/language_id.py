"""Language identification by compression.

For every language the text of sampled documents becomes a raw-content dictionary of
zstandard.  A text is cut into blocks, each block is compressed against every dictionary,
and the language whose dictionary gives the fewest bytes in all is chosen.  Where the best
two are close, the choice is marked as rejected.

Rules: a null text, or one without a letter, is ``und`` with score 0, rejected.  Ties go to
the language with more documents to learn from, then to the one that sorts first (and are
rejected, the margin being zero).  Digits, signs and
ASCII case do not count.  With nothing to learn from, every text is ``und``.  Repeated rows
are predicted each.  The sample is bounded: :data:`SAMPLE_DOCS` distinct texts a language, in
the order of their hash, :data:`SAMPLE_BYTES` bytes of each, from a place in the whole text that
the hash draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillsight.llm.common import fold, steps, table, with_fields

UNKNOWN = "und"
#: Documents of a language that its dictionary is made of, and bytes of each.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 500
LEVEL = 6
#: Bytes that are compressed at once; the dictionary counts for each block.
BLOCK = 1000
#: Bytes by which the second must be larger, for each byte of text.
MARGIN = 0.01
#: Bytes of margin that make the odds ``e`` to 1.
SCALE = 4.0

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case letters, with one space for everything between them; empty if no letters."""
    raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if raw and not any(97 <= b <= 122 for b in raw) and not any(map(str.isalpha, text or "")):
        return b""
    return raw


def learn(docs: DataFrame, docs_each: int = SAMPLE_DOCS, bytes_each: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent first, from ``doc_id, text, lang``; rows
    without a language don't count.

    The driver gets ``docs_each * bytes_each`` bytes a language.
    """
    usable = docs.filter("lang is not null and trim(text) <> ''").select(
        "lang", "doc_id", "text", F.xxhash64("text").alias("draw")
    )
    found = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("draw").alias("texts")).collect()
    counts = {r["lang"]: r["rows"] for r in found}
    if not counts:
        return {}
    # A few times the wanted number of distinct texts is drawn by their hash and ranked, without
    # the texts; these are fetched for the ones that are chosen.
    bars = {r["lang"]: -(1 << 63) + int(min(1.0, 4 * docs_each / r["texts"]) * ((1 << 64) - 2048)) for r in found}
    bar = F.create_map(*[F.lit(x) for pair in bars.items() for x in pair])[F.col("lang")]
    drawn = usable.select("lang", "doc_id", "draw").filter(F.col("draw") <= bar)
    drawn = drawn.groupBy("lang", "draw").agg(F.min("doc_id").alias("_id"))
    order = Window.partitionBy("lang").orderBy("draw")
    chosen = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= docs_each)
    sample = (
        usable.join(F.broadcast(chosen), ["lang", "draw"])
        .filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("lang", "place", "draw", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 3):
            cut = []
            for draw, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = plain(text)
                first = (draw * 0x9E3779B97F4A7C15 >> 32) % (max(0, len(raw) - bytes_each) + 1)
                cut.append(raw[first : first + bytes_each])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cut, pa.binary())], ["lang", "place", "part"])

    sample = sample.mapInArrow(run, "lang string, place int, part binary").dropDuplicates(["lang", "place"])
    parts: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"])):
        parts.setdefault(row["lang"], []).append(bytes(row["part"]))
    order = sorted(parts, key=lambda lang: (-counts[lang], lang))
    return {lang: b" ".join(parts[lang]) for lang in order if b"".join(parts[lang])}


class Compressors:
    """The sizes of a text under every language; of equal ones the first in order counts."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = list(dictionaries)
        self.zip = []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.zip.append(
                zstandard.ZstdCompressor(
                    dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )

    def predict(self, text: str | None, block: int, margin: float) -> tuple[str, float, float, bool]:
        """Language, score, margin for each byte, and whether it is too narrow."""
        raw = plain(text)
        if not raw or not self.langs:
            return UNKNOWN, 0.0, 0.0, True
        blocks = [raw[k : k + block] for k in range(0, len(raw), block)]
        sizes = np.array([sum(len(z(x)) for x in blocks) for z in self.zip])
        best = int(sizes.argmin())
        odds = np.exp(-(sizes - sizes[best]) / SCALE)
        lead = float(np.partition(sizes, 1)[1] - sizes[best]) / len(raw) if len(sizes) > 1 else 1.0
        return self.langs[best], float(1 / odds.sum()), lead, lead < margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], block: int = BLOCK, margin: float = MARGIN
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, margin, rejected`` added (or replaced)."""
    added = ["lang_pred", "score", "margin", "rejected"]
    kept = docs.drop(*added)
    names, place = [*kept.columns, *added], kept.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(held.value)
        for batch in steps(batches, place):
            found = [model.predict(x, block, margin) for x in batch.column(place).to_pylist()]
            columns = [
                pa.array(c, t)
                for c, t in zip(
                    zip(*found, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    kinds = zip(added, ("string", "double", "double", "boolean"), strict=True)
    return kept.mapInArrow(run, with_fields(kept.schema, *kinds))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    dictionaries = learn(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )

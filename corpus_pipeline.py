"""The corpus pipeline: documents that are good and of a known language, without near copies
and repeated passages, packed into token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  Its result is written and
read again as the next stage's documents.  All but the last return the columns of
``documents``.  Rules of the operators hold (see their docstrings); beyond them:

* quality and language leave texts as they are and drop the rows they reject;
* of a component of near duplicates the document with the smallest id stays, once;
* the text that is left by the removal of repeats is what still is whole UTF-8: bytes of a
  letter that was cut apart go with the cut; ``n_chars`` follows the text.  A document of
  which nothing is left stays, as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm import language_id, packing, quality_classifier, simhash, suffix_dedup
from drillsight.llm.common import fold, importable
from drillsight.session import remove, settle, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage_of(step: Stage) -> Stage:
    """A stage whose Python workers find the package."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return step(spark, docs, sf_dir)

    return run


@stage_of
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier passes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.kept_documents(docs.select(*COLUMNS), labels)


@stage_of
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a clear margin."""
    learned = language_id.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs.select(*COLUMNS), learned)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


@stage_of
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return simhash.representatives(docs.select(*COLUMNS))


@stage_of
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur elsewhere."""
    return suffix_dedup.cleaned(docs.select(*COLUMNS))


@stage_of
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", pack),
]

#: The stages learn, hash and tokenize, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread.

    What a stage has staged goes when its result is written, and so does that result when the
    next one is; what the last stage reads is left to the owner of the folder.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        docs = settle(spark, path, partial(step, spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

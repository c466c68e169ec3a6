"""Quality classifier by co-training of two views.

The text view sees the words and letters of a document, the page view its metadata (host,
language, size) and layout.  Both are logistic regressions fitted on labelled documents.  In
each round either view scores all unlabelled documents, and its most confident ones become
labels for the *other* view.  At last either view is calibrated on labelled documents that
were kept out of the fit, a third regression combines the calibrated views, and all
documents are scored.

Bounds: :data:`LABELLED` labelled documents that are there are used, in the order of a hash of
their id, each with one row of features (the smallest, if there are several), a quarter of them
for calibration; a view passes on :data:`CONFIDENT` distinct feature rows of each
class and round, or :data:`SHARE` of the unlabelled ones if that is more, up to
:data:`MOST_CONFIDENT`, the bound for the fit.  Those of all rounds count, each once for a view.
These, and nothing else, reach the driver.

Rules: a null text is empty, and scored like any other; null metadata is a value of its own.
Labels that are null or neither 0 nor 1 do not count, of several labels the smallest does.
Without labels (or with one class only) the score is the smoothed share of good labels, and
nothing is rejected on no evidence (a share of 0.5 passes).  Repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import steps, table, with_fields
from drillsight.llm.fitting import Logistic, fit
from drillsight.session import stage

LABELLED = 16_000
CONFIDENT = 400
SHARE = 0.01
MOST_CONFIDENT = 2_000
ROUNDS = 3
#: Probability a view must reach to pass a document on.
SURE = 0.95
#: Documents with a lower score are rejected.
PASS = 0.5
#: Hashed places for hosts and languages.
HOSTS = 16
LANGUAGES = 8

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "symbol": b"#*$%&|<>",
    "other": b"/\\@_~^=+[]{}`",
}
_TABLE = np.zeros(256, np.uint8)
for _k, _letters in enumerate(_CLASSES.values(), 1):
    _TABLE[list(_letters)] = _k
_URL = re.compile(r"https?://|www\.|@")


def text_view(text: str) -> list[float]:
    """Shares of letter classes and of repeated, odd, long and short words."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * 19
    kinds = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    most = counts.most_common(1)[0][1] if counts else 0
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    return [
        *kinds.tolist(),
        len(counts) / n,
        pairs / max(1, n - 1),
        most / n,
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths == 1).mean()),
        sum(1 for w in counts if w.isalpha()) / max(1, len(counts)),
        sum(c for w, c in counts.items() if w[-1:] in b"#*$%&|<>!") / n,
        float(np.log1p(n)),
        min(1.0, 100 * len(_URL.findall(text)) / n),
    ]


def page_view(text: str, host: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Size and layout of the page, its host and its language."""
    lines = text.split("\n")
    size = len(text)
    out = [
        float(np.log1p(max(0, n_chars or 0))),
        float(np.log1p(len(lines))),
        float(np.log1p(size / len(lines))),
        sum(1 for x in lines if not x.strip()) / len(lines),
        1 - len(set(lines)) / len(lines),
        float(n_chars is None or n_chars != size),
    ]
    for value, places in ((host, HOSTS), (lang, LANGUAGES)):
        hot = [0.0] * (places + 1)
        hot[places if value is None else zlib.crc32(value.encode("utf-8", "surrogatepass")) % places] = 1.0
        out += hot
    return out


def views(docs: DataFrame) -> DataFrame:
    """``row, doc_id, words, page``: both views of every document (``row`` is set by the writer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, *columns = (c.to_pylist() for c in batch.columns)
            words = [text_view(x or "") for x in columns[0]]
            pages = [page_view(x or "", *rest) for x, *rest in zip(*columns, strict=True)]
            lists = [pa.array(v, pa.list_(pa.float32())) for v in (words, pages)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "words", "page"])

    return docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.col("n_chars").cast("long"),
    ).mapInArrow(run, "doc_id long, words array<float>, page array<float>")


@dataclass
class CoTrained:
    """Both views, their calibration, and the regression that combines them."""

    words: Logistic
    page: Logistic
    calibrate_words: Logistic
    calibrate_page: Logistic
    combine: Logistic

    def scores(self, words: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the two views, and of both."""
        a = self.calibrate_words.logit(self.words.logit(words)[:, None])
        b = self.calibrate_page.logit(self.page.logit(page)[:, None])
        odds = np.clip(np.c_[a, b], -12, 12)
        return 1 / (1 + np.exp(-odds[:, 0])), 1 / (1 + np.exp(-odds[:, 1])), self.combine.probability(odds)


def _scored(rows: DataFrame, score, names: list[str]) -> DataFrame:
    """``rows`` with what ``score(words, page)`` gives added under ``names``."""
    held = rows.sparkSession.sparkContext.broadcast(score)
    columns = rows.columns
    at = columns.index("words"), columns.index("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack(batch.column(k).to_numpy(zero_copy_only=False)) for k in at)
                found = [pa.array(v) for v in held.value(x, y)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*columns, *names])

    return rows.mapInArrow(run, with_fields(rows.schema, *((n, "double") for n in names)))


class _Views:
    """Scores of both views by themselves, for a round."""

    def __init__(self, words: Logistic, page: Logistic) -> None:
        self.words, self.page = words, page

    def __call__(self, words: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words.probability(words), self.page.probability(page)


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.array([r["words"] for r in rows], float).reshape(len(rows), -1),
        np.array([r["page"] for r in rows], float).reshape(len(rows), -1),
    )


def train(
    seen: DataFrame,
    labels: DataFrame,
    rounds: int = ROUNDS,
    labelled: int = LABELLED,
    confident: int = CONFIDENT,
    sure: float = SURE,
) -> CoTrained:
    """Co-train on ``seen`` (see :func:`views`) and ``labels`` (``doc_id, quality``)."""
    known = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .join(seen.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(labelled)
    )
    # One row a document, however often it is there.
    one = F.min(F.struct("words", "page")).alias("one")
    rows = seen.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(one, F.min("quality").alias("quality"))
    rows = rows.select("doc_id", "one.*", "quality").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], float)
    words, page = _arrays(rows) if rows else (np.zeros((0, 19)), np.zeros((0, 8 + HOSTS + LANGUAGES)))
    aside = np.array([zlib.crc32(f"calibrate {r['doc_id']}".encode()) % 4 == 0 for r in rows], bool)
    if len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
        aside = np.zeros(len(rows), bool)
    x = {"words": words[~aside], "page": page[~aside]}
    target = {"words": y[~aside], "page": y[~aside]}
    models = {v: fit(x[v], target[v]) for v in x}
    rounds = rounds if len(np.unique(y)) == 2 else 0
    if rounds:
        unlabelled = seen.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
        unlabelled = unlabelled.select(F.xxhash64("words", "page").alias("mark"), "words", "page")
        unlabelled = stage(unlabelled.dropDuplicates(["mark"]), "quality-unlabelled")
        confident = max(confident, min(MOST_CONFIDENT, int(SHARE * unlabelled.count())))
    passed: dict[str, list] = {"words": [], "page": []}
    for _ in range(rounds):
        scored = _scored(unlabelled, _Views(models["words"], models["page"]), ["by_words", "by_page"])
        picks = []
        for teacher, column in (("words", "by_words"), ("page", "by_page")):
            marks = seen.sparkSession.createDataFrame([(r["mark"],) for r in passed[teacher]], "mark long")
            left = scored.join(F.broadcast(marks), "mark", "left_anti")
            for label, chance in ((1.0, F.col(column)), (0.0, 1 - F.col(column))):
                picks.append(
                    left.filter(chance >= sure).orderBy(chance.desc(), "mark").limit(confident)
                    .select(F.lit(teacher).alias("teacher"), F.lit(label).alias("label"), "mark", "words", "page")
                )
        chosen = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]).collect()
        for learner, teacher in (("words", "page"), ("page", "words")):
            passed[teacher] += [r for r in chosen if r["teacher"] == teacher]
            more = _arrays(passed[teacher])[0 if learner == "words" else 1] if passed[teacher] else x[learner][:0]
            told = np.array([r["label"] for r in passed[teacher]])
            models[learner] = fit(np.r_[x[learner], more], np.r_[target[learner], told])
    check = aside if aside.any() else np.ones(len(rows), bool)
    truth = y[check]
    a, b = models["words"].logit(words[check])[:, None], models["page"].logit(page[check])[:, None]
    calibrate = fit(a, truth), fit(b, truth)
    odds = np.clip(np.c_[calibrate[0].logit(a), calibrate[1].logit(b)], -12, 12)
    return CoTrained(models["words"], models["page"], *calibrate, fit(odds, truth))


def classify(docs: DataFrame, labels: DataFrame, passing: float = PASS, **training: float) -> DataFrame:
    """``doc_id, words_score, page_score, score, kept`` of every document."""
    seen = stage(views(docs), "quality-views")
    model = train(seen, labels, **training)
    scored = _scored(seen, model.scores, ["words_score", "page_score", "score"])
    return scored.drop("words", "page").withColumn("kept", F.col("score") >= passing)


def kept_documents(docs: DataFrame, labels: DataFrame, passing: float = PASS, **training: float) -> DataFrame:
    """The documents that pass, with all their columns; ``source`` and ``lang`` are texts."""
    seen = stage(views(docs), "quality-views")
    model = train(seen, labels, **training)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at[0]):
            columns = [batch.column(k).to_pylist() for k in at]
            words = np.array([text_view(x or "") for x in columns[0]], np.float32)
            pages = np.array([page_view(x or "", *r) for x, *r in zip(*columns, strict=True)], np.float32)
            good = held.value.scores(words, pages)[2] >= passing
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and verdict of every document."""
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))

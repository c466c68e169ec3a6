"""Toxicity by a learned lexicon, Levenshtein automata and the words around a hit.

The lexicon is learned from labelled rows: words, and stems that many different words share,
which come up in toxic documents and hardly in others.  It is a trie.  A word of a text is
matched by walking the trie together with the word's Levenshtein automaton (its states as
bit masks), so a misspelling within the budget is found as well.  A hit is looked at in its
window: quotation marks around it or a word of reporting before it make it a quotation.  Words of
reporting are learned as well: they stand before hits in clean documents and not in toxic ones.
Counts of abusive and of quoted hits go into a logistic score fitted on the same sample.

Terms are counted in groups of near copies (linked by :mod:`simhash`), not in rows, so a text
that is in many places teaches as much as one that is in one.

Rules: a null text is empty and scored as a text without hits.  Labels that are null or
neither 0 nor 1 do not count; a document labelled twice counts as toxic if one label says so.
Without labels the lexicon is empty and every score is 0.5 or what the labels' share says.
The sample is bounded by :data:`SAMPLE_TOXIC` and :data:`SAMPLE_OTHER` documents, in the
order of a hash of their id, of those that are there; a document that is there more than once
teaches with its smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillsight.llm import simhash
from drillsight.llm.common import fold, steps, table, with_fields
from drillsight.llm.components import components
from drillsight.llm.fitting import Logistic, fit
from drillsight.session import stage

SAMPLE_TOXIC = 4_000
SAMPLE_OTHER = 8_000
#: Toxic documents a term must come up in, however large the sample, and share of its documents
#: that are toxic.  Near copies are one document.
LEAST_DOCS = 5
LEAST_SHARE = 0.9
#: Contrast between the classes that a term needs: the log-likelihood ratio (G squared) of its
#: documents by label against those of the sample; 15.13 is one chance in 10,000.
LEAST_CONTRAST = 15.13
#: Words, and stems, that the driver holds at most; those of the strongest contrast count.
MOST_TERMS = 10_000
#: Words of clean documents near a term that are held at most.
MOST_INNOCENT = 200_000
STEM_LENGTHS = (4, 5, 6)
#: Different words that must share a stem.
STEM_WORDS = 4
#: Letters a term needs for each edit that is allowed, and what a hit counts for each edit.
LETTERS_PER_EDIT = 5
MISSPELLED = 0.7
#: The most edits for any term (one of 60 letters and more); beyond it a longer term allows no more.
MOST_EDITS = 12
#: Edits up to which words are looked up by their forms; terms that allow more, by their parts.
FORM_EDITS = 2
#: Words on either side of a hit that are looked at.
CONTEXT = 4
#: Reporting words that are held at most, the most frequent first.
MOST_REPORTING = 1_000
_QUOTES = "\"“”„«»‘’'"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—"


def edits_of(length: int) -> int:
    """Edits that a term of so many letters allows."""
    return min(length // LETTERS_PER_EDIT, MOST_EDITS)


def plain_word(word: str) -> str:
    """A lower-case word without signs around it."""
    return word.strip(_EDGE)


def shortened(word: str, most: int) -> set[str]:
    """The word, and what is left of it without up to ``most`` letters."""
    found = layer = {word}
    for _ in range(most):
        layer = {w[:k] + w[k + 1 :] for w in layer for k in range(len(w))}
        found = found | layer
    return found


class Trie:
    """The lexicon: nodes with children by letter; ``ends`` and ``stems`` mark where terms end."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.stems: list[bool] = [False]
        #: Lengths of the shortest and the longest term below a node.
        self.lengths: list[tuple[int, int]] = [(0, 0)]
        for term in words:
            self.ends[self._add(term)] = len(term)
        for stem in stems:
            self.stems[self._add(stem)] = True
        for node in range(len(self.kids) - 1, -1, -1):  # children have larger numbers
            below = [self.lengths[k] for k in self.kids[node].values() if self.lengths[k][1]]
            own = [(self.ends[node],) * 2] if self.ends[node] else []
            found = [*below, *own]
            self.lengths[node] = (min(a for a, _ in found), max(b for _, b in found)) if found else (0, 0)
        #: The edits that these lengths allow, beside them.
        self.bounds = [(a, edits_of(a), b, edits_of(b)) for a, b in self.lengths]
        self.allowed = [edits_of(n) for n in self.ends]

    def _add(self, term: str) -> int:
        node = 0
        for letter in term:
            if letter not in self.kids[node]:
                self.kids[node][letter] = len(self.kids)
                self.kids.append({})
                self.ends.append(0)
                self.stems.append(False)
                self.lengths.append((0, 0))
            node = self.kids[node][letter]
        return node

    def stem_of(self, word: str) -> bool:
        """Whether the word starts with a stem."""
        node = 0
        for letter in word:
            if (node := self.kids[node].get(letter, -1)) < 0:
                return False
            if self.stems[node]:
                return True
        return False

    def distance(self, word: str, most: int) -> int | None:
        """Edits between the word and the nearest term that allows so many, up to ``most``.

        The automaton of ``word`` has a bit mask for each number of edits: bit ``i`` says that
        ``i`` letters of the word are used up.  It moves along the trie's edges and a branch
        is left when no bit is set within the edits its longest term allows, or when its terms
        are too short or too long for theirs.
        """
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << i
        size = len(word)
        full, goal = (1 << size + 1) - 1, 1 << size
        start = [((1 << e + 1) - 1) & full for e in range(most + 1)]
        best: int | None = None
        stack = [(0, start)]
        while stack:
            node, state = stack.pop()
            if self.ends[node]:
                for edits, bits in enumerate(state):
                    if bits & goal:
                        if edits <= self.allowed[node] and (best is None or edits < best):
                            best = edits
                        break
            for letter, kid in self.kids[node].items():
                shortest, fewest, longest, allowed = self.bounds[kid]
                if allowed > most:
                    allowed = most
                if longest + allowed < size or shortest - (most if fewest > most else fewest) > size:
                    continue
                mask = masks.get(letter, 0)
                moved, below, below_old = [], 0, 0
                for bits in state[: allowed + 1]:
                    now = (bits & mask) << 1  # the letter fits
                    if moved:  # one more edit: letter of the term only, changed, letter of the word only
                        now |= below_old | below_old << 1 | below << 1
                    now &= full
                    moved.append(now)
                    below, below_old = now, bits
                if any(moved):
                    stack.append((kid, moved))
        return best


@dataclass
class Lexicon:
    """Terms, stems, and words near a term that clean documents use."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    innocent: frozenset[str] = frozenset()
    #: Words before a hit that make it a quotation.
    reporting: frozenset[str] = frozenset()


class Matcher:
    """The weight of a word as a hit, remembered for the words seen."""

    def __init__(self, lexicon: Lexicon, most_words: int = 400_000) -> None:
        self.trie, self.innocent = Trie(lexicon.words, lexicon.stems), lexicon.innocent
        self.reporting = lexicon.reporting
        # A word within e edits of a term has one of e + 1 parts of the term as it is, and the
        # two are alike in one of their forms with up to e letters left out.
        self.parts, self.long_parts = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.forms: set[str] = set()
        #: The most edits that a term of a near length allows, by the length of a word.
        self.edits: dict[int, int] = {}
        for term in lexicon.words:
            edits = edits_of(len(term))
            for length in range(len(term) - edits, len(term) + edits + 1):
                self.edits[length] = max(edits, self.edits.get(length, 0))
            if edits <= FORM_EDITS:
                self.forms |= shortened(term, edits)
            pieces = edits + 1
            for k in range(pieces):
                part = term[len(term) * k // pieces : len(term) * (k + 1) // pieces]
                self.parts.add_word(part, 1)
                if edits > FORM_EDITS:
                    self.long_parts.add_word(part, 1)
        for automaton in (self.parts, self.long_parts):
            if len(automaton):
                automaton.make_automaton()
        self.empty, self.most_words, self.known = not lexicon.words, most_words, _Known(self.weigh)

    def weigh(self, raw: str) -> float:
        word = plain_word(raw)
        if not word:
            return 0.0
        if self.trie.stem_of(word):
            return 1.0
        if self.empty or (most := self.edits.get(len(word), -1)) < 0 or next(self.parts.iter(word), None) is None:
            return 0.0
        if most <= FORM_EDITS or next(self.long_parts.iter(word), None) is None:
            if self.forms.isdisjoint(shortened(word, min(most, FORM_EDITS))):
                return 0.0
        edits = self.trie.distance(word, most)
        if edits is None or edits and word in self.innocent:
            return 0.0
        return MISSPELLED**edits

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Log of abusive and of quoted hits, hits for a hundred words, and their share abusive."""
        if len(self.known) > self.most_words:
            self.known.clear()
        words = (text or "").lower().split()
        weights = list(map(self.known.__getitem__, words))
        abuse = quoted = 0.0
        if any(weights):
            for k in np.flatnonzero(weights):
                before, after = words[max(0, k - CONTEXT) : k], words[k + 1 : k + 1 + CONTEXT]
                if self.is_quoted(before, words[k], after):
                    quoted += weights[k]
                else:
                    abuse += weights[k]
        hits = abuse + quoted
        return (
            float(np.log1p(abuse)),
            float(np.log1p(quoted)),
            float(np.log1p(100 * abuse / max(1, len(words)))),
            abuse / hits if hits else 0.0,
        )

    def before_hits(self, text: str | None) -> set[str]:
        """Words in the windows before the text's hits that are no hits themselves."""
        words = (text or "").lower().split()
        weights = list(map(self.known.__getitem__, words))
        near = {j for k in np.flatnonzero(weights).tolist() for j in range(max(0, k - CONTEXT), k)}
        return {plain_word(words[j]) for j in near if not weights[j]} - {""}

    def is_quoted(self, before: list[str], word: str, after: list[str]) -> bool:
        """Whether the words around a hit show a quotation."""
        if self.reporting and any(plain_word(w) in self.reporting for w in before):
            return True
        opened = word[:1] in _QUOTES or any(w[:1] in _QUOTES for w in before)
        closed = word.rstrip(".,;:!?")[-1:] in _QUOTES or any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in after)
        return opened and closed


class _Known(dict):
    def __init__(self, weigh) -> None:
        super().__init__()
        self.weigh = weigh

    def __missing__(self, word: str) -> float:
        found = self[word] = self.weigh(word)
        return found


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_other: int) -> DataFrame:
    """``doc_id, text, toxic`` of a bounded sample of labelled documents."""
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = (F.xxhash64("doc_id"), "doc_id")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = (
        known.filter("toxic = 1").orderBy(*order).limit(most_toxic)
        .unionByName(known.filter("toxic = 0").orderBy(*order).limit(most_other))
    )
    # One row a document, however often it is there: that of the smallest text.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def _words(sample: DataFrame) -> DataFrame:
    """``word, fp, toxic``: a row for each word of the sample's texts, their fingerprint and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, rows, marks = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = sorted({plain_word(w) for w in (text or "").lower().split()} - {""})
                words += found
                rows += [row] * len(found)
                marks.append(simhash.fingerprint(text))
            places = pa.array(rows, pa.int64())
            fp = pa.array(np.array(marks, np.uint64).view(np.int64)).take(places)
            toxic = batch.column(2).take(places).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), fp, toxic], ["word", "fp", "toxic"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "word string, fp long, toxic int").distinct()


def _found(sample: DataFrame) -> DataFrame:
    """``word, origin, toxic``: the words of each group of near copies, by label, once."""
    words = stage(_words(sample), "toxicity-words")
    nodes = stage(words.select("fp").distinct(), "toxicity-fingerprints")
    roots = components(simhash.links(nodes)).select(F.col("a").alias("fp"), F.col("b").alias("origin"))
    origins = nodes.join(roots, "fp", "left").withColumn("origin", F.coalesce("origin", "fp"))
    return stage(words.join(origins, "fp").select("word", "origin", "toxic").distinct(), "toxicity-origins")


def _counts(found: DataFrame, term: str) -> DataFrame:
    """``term`` with the groups that have it, by label: ``bad, good``."""
    return found.groupBy(term).agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    )


def _contrast(toxic: int, other: int) -> Column:
    """G squared of a term's ``bad`` and ``good`` documents, zero where toxic ones are no more
    frequent than among the sample's ``toxic`` and ``other`` documents."""
    if not toxic or not other:
        return F.lit(0.0)
    bad, good, share = F.col("bad"), F.col("good"), toxic / (toxic + other)
    parts = [F.when(n > 0, n * F.log(n / ((bad + good) * p))).otherwise(0.0) for n, p in ((bad, share), (good, 1 - share))]
    return F.when(bad * other > good * toxic, 2 * (parts[0] + parts[1])).otherwise(0.0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems of toxic documents; the driver gets at most :data:`MOST_TERMS` of each."""
    found = _found(sample)
    counts = stage(_counts(found, "word"), "toxicity-counts")
    sizes = {r["toxic"]: r["count"] for r in found.select("origin", "toxic").distinct().groupBy("toxic").count().collect()}
    contrast = _contrast(sizes.get(1, 0), sizes.get(0, 0))
    shared = F.col("bad") >= LEAST_SHARE * (F.col("bad") + F.col("good"))
    telling = (F.col("bad") >= LEAST_DOCS) & shared & (contrast >= LEAST_CONTRAST)
    strongest = (contrast.desc(), "term")
    lengths = F.explode(F.array(*map(F.lit, STEM_LENGTHS)))
    stemmed = [
        rows.withColumn("length", lengths)
        .filter(F.length("word") > F.col("length"))
        .withColumn("term", F.substring("word", 1, F.col("length")))
        for rows in (found, counts.filter("bad > 0"))
    ]
    various = stemmed[1].groupBy("term").agg(F.count("*").alias("words")).filter(F.col("words") >= STEM_WORDS)
    stems = (
        _counts(stemmed[0].select("term", "origin", "toxic").distinct(), "term")
        .filter(telling)
        .join(various, "term")
        .orderBy(*strongest)
        .limit(MOST_TERMS)
        .collect()
    )
    words = (
        counts.withColumnRenamed("word", "term")
        .filter(telling & (F.length("term") > 2))
        .orderBy(*strongest)
        .limit(MOST_TERMS)
        .collect()
    )
    stem_trie = Trie([], [r["term"] for r in stems])
    lexicon = Lexicon([r["term"] for r in words if not stem_trie.stem_of(r["term"])], [r["term"] for r in stems])
    return _with_innocent(counts, lexicon)


def _with_innocent(counts: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Adds words of clean documents that a misspelling could be taken for."""
    if not lexicon.words:
        return lexicon
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        for batch in batches:
            near = [0 < matcher.weigh(w) < 1 for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    clean = counts.filter(F.col("good") > 0).select("word", "good")
    near = clean.mapInArrow(run, clean.schema).orderBy(F.desc("good"), "word").limit(MOST_INNOCENT).collect()
    return replace(lexicon, innocent=frozenset(r["word"] for r in near))


def _with_reporting(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Adds the words that stand before hits in clean documents rather than in toxic ones, in any
    language: those report a hit instead of meaning it."""
    if not lexicon.words and not lexicon.stems:
        return lexicon
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        for batch in steps(batches):
            words, marks, rows = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = matcher.before_hits(text)
                words += sorted(found)
                rows += [row] * len(found)
                marks += [simhash.fingerprint(text)] * len(found) if found else []
            fp = pa.array(np.array(marks, np.uint64).view(np.int64))
            toxic = batch.column(2).take(pa.array(rows, pa.int64())).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), fp, toxic], ["word", "origin", "toxic"])

    found = sample.select("doc_id", "text", "toxic").mapInArrow(run, "word string, origin long, toxic int")
    found = stage(found.distinct(), "toxicity-before-hits")
    sizes = {r["toxic"]: r["count"] for r in found.select("origin", "toxic").distinct().groupBy("toxic").count().collect()}
    # The contrast of a term, with the classes changed over.
    swapped = _counts(found, "word").select("word", F.col("good").alias("bad"), F.col("bad").alias("good"))
    telling = (F.col("bad") >= LEAST_DOCS) & (_contrast(sizes.get(0, 0), sizes.get(1, 0)) >= LEAST_CONTRAST)
    chosen = swapped.filter(telling).orderBy(F.desc("bad"), "word").limit(MOST_REPORTING).collect()
    return replace(lexicon, reporting=frozenset(r["word"] for r in chosen))


def _featured(docs: DataFrame, lexicon: Lexicon, model: Logistic | None = None) -> DataFrame:
    """``docs`` (``doc_id, text`` and others) with ``features``, or with ``score``, for ``text``."""
    held = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    others = [c for c in docs.columns if c != "text"]
    docs = docs.select("text", *[F.col(f"`{c}`") for c in others])
    added = ("features", "array<double>") if model is None else ("score", "double")
    schema = with_fields(T.StructType(docs.schema.fields[1:]), added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = held.value
        matcher = Matcher(lexicon)
        for batch in steps(batches, 0):
            found = [matcher.features(x) for x in batch.column(0).to_pylist()]
            values = pa.array(found, pa.list_(pa.float64())) if model is None else pa.array(model.probability(np.array(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], [*others, added[0]])

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    logistic: Logistic


def learn(
    docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_other: int = SAMPLE_OTHER
) -> Model:
    """Lexicon and score from labelled documents (a bounded sample of them)."""
    sample = _sample(docs, labels, most_toxic, most_other)
    lexicon = _with_reporting(sample, learn_lexicon(sample))
    rows = _featured(sample, lexicon).select("toxic", "features").collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, 4)
    return Model(lexicon, fit(x, np.array([r["toxic"] for r in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with its toxicity from 0 to 1 as ``score``."""
    return _featured(docs.drop("score"), model.lexicon, model.logistic)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from four fifths of the labelled rows."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = learn(docs, table(spark, folder, "labels").filter(~held_out).select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

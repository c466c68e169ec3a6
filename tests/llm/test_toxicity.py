import math
import random
import zlib

import numpy as np
import pytest
from llm_data import documents  # noqa: F401
from pyspark.sql import functions as F

from drillsight.llm import toxicity
from drillsight.llm.toxicity import Lexicon, Matcher, Trie


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    draw = random.Random(1)
    terms = ["abcde", "abcdefghij", "bbbbb", "edcba", "aaaaabbbbb", "abc"]
    trie = Trie(terms, [])
    for _ in range(3000):
        word = list(draw.choice(terms))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "a", "z"])
        word = "".join(word)
        near = [edits(word, t) for t in terms if edits(word, t) <= min(2, len(t) // toxicity.LETTERS_PER_EDIT)]
        assert trie.distance(word, 2) == (min(near) if near else None), word


def test_hits():
    matcher = Matcher(Lexicon(["idiot", "moron", "scum"], ["vequ"], frozenset({"oron"})))
    weights = {"idiot": 1, "IDIOT".lower(): 1, "idiot,": 1, "id1ot": 0.7, "idot": 0.7, "iddiot": 0.7, "idio": 0.7, "scum": 1, "scam": 0, "oron": 0, "moronn": 0.7, "vequxyz": 1, "veq": 0, "": 0, "...": 0, "ixxot": 0}
    for word, weight in weights.items():
        assert matcher.weigh(word) == pytest.approx(weight), word


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("you idiot go away", False), ('he said idiot to me', True), ('the "idiot" again', True), ('"what an idiot he is," she told', True),
        ("idiot", False), ("«idiot»", True), ("she wrote that the idiot had left", True),
    ],
)
def test_quotation(text, quoted):
    abuse, cited, _, share = Matcher(Lexicon(["idiot"], reporting=frozenset({"said", "wrote"}))).features(text)
    assert (abuse == 0, cited > 0, share == 0) == (quoted, quoted, quoted)


def made(n=400, seed=3):
    """Documents, every fourth toxic by one of two words, one of four stems, or a misspelling."""
    draw = random.Random(seed)
    plain = ["the", "house", "stands", "moronic", "river", "veto", "blue", "green", "walks", "oron", "idea"]
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(plain) for _ in range(30)]
        if toxic := k % 4 == 0:
            bad = ["grobbler", "snarkle", *("zorq" + draw.choice(["a", "be", "ci", "du", "ex", "fo"]) for _ in range(2))]
            words[5] = draw.choice(bad)
            words[20] = draw.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):  # noqa: F811
    rows, labels = made()
    odd = [(900, None), (901, ""), (902, "you grobblr of a house"), (None, "the river"), (903, 'he said "grobbler" twice'), (903, 'he said "grobbler" twice')]
    docs = documents(rows + odd)
    told = spark.createDataFrame([*labels, (5, None), (6, 7), (None, 1), (900, 0)], "doc_id long, toxic int").withColumn("text", F.lit(1))
    train = told.filter("doc_id % 5 <> 0 or doc_id is null")
    model = toxicity.learn(docs, train)
    assert set(model.lexicon.words) == {"grobbler", "snarkle"} and "zorq" in model.lexicon.stems
    got = {}
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    right = [(got[k][0] >= 0.5) == bool(y) for k, y in labels if k % 5 == 0]
    assert sum(right) / len(right) >= 0.98
    assert got[902][0] > got[900][0] == got[901][0] and len(got[903]) == 2
    assert all(0 <= s <= 1 for scores in got.values() for s in scores)


def test_without_labels(spark, documents):  # noqa: F811
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert model.lexicon == Lexicon()
    assert [r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()] == [0.5, 0.5]
    assert toxicity.score(documents([]).select("doc_id", "text"), model).count() == 0


def test_fold_is_crc32_of_the_id():
    assert zlib.crc32(b"17") % 5 == zlib.crc32(str(17).encode()) % 5


def letters(k, n=8):
    """A word of its own for each ``k``, far from the others."""
    draw = random.Random(k)
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def varied(insults=100, each=8, clean=1600):
    """Toxic documents with one of many insults each, and clean ones."""
    draw = random.Random(5)
    plain = [letters(-k - 1, 6) for k in range(300)]
    rows = []
    for k in range(insults * each + clean):
        words = [draw.choice(plain) for _ in range(30)]
        if toxic := k < insults * each:
            words[draw.randrange(30)] = letters(k % insults)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_insults_of_small_reach(spark):
    """Each of a hundred insults is in one of a hundred toxic documents."""
    sample = spark.createDataFrame(varied(), "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(sample)
    assert set(lexicon.words) == {letters(k) for k in range(100)}
    matcher = Matcher(lexicon)
    assert all(matcher.weigh(letters(k)[:3] + "9" + letters(k)[4:]) == pytest.approx(0.7) for k in range(100))


def test_copies_of_one_text_teach_once(spark):
    """A third of the toxic rows are copies and near copies of one long text."""
    rows = varied(insults=50, clean=1200)
    long = [letters(-k - 5000) for k in range(600)]
    for k in range(200):
        near = list(long)
        if k % 2:
            near[k] = letters(-k - 9000)
        rows.append((100_000 + k, " ".join(near), 1))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert set(lexicon.words) == {letters(k) for k in range(50)} and lexicon.stems == []


def test_edits_follow_the_length_of_the_term():
    matcher = Matcher(Lexicon(["disgusting", "goodfornothings"]))
    weights = {"d1sgust1ng": 0.49, "disgstin": 0.49, "d1sgu5t1ng": 0, "g00df0rnothings": 0.343, "g00df0rn0things": 0}
    for word, weight in weights.items():
        assert matcher.weigh(word) == pytest.approx(weight), word


def test_filters_lose_no_hit():
    draw = random.Random(2)
    terms = ["".join(draw.choice("abc") for _ in range(n)) for n in range(3, 23) for _ in range(2)]
    matcher = Matcher(Lexicon(terms))
    for _ in range(2000):
        word = list(draw.choice(terms))
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "a", "z"])
        word = "".join(word)
        near = [edits(word, t) for t in terms if edits(word, t) <= len(t) // toxicity.LETTERS_PER_EDIT]
        assert matcher.weigh(word) == pytest.approx(0.7 ** min(near) if near else 0), word


def test_reporting_words_are_learned(spark):
    """In two invented languages, words that stand before hits in clean documents alone."""
    draw = random.Random(8)
    plain = [letters(-k - 1, 6) for k in range(100)]
    rows = []
    for k in range(600):
        words = [draw.choice(plain) for _ in range(20)]
        if k % 3 == 0:
            words[10] = draw.choice(["grobbler", "snarkle"])
        elif k % 15 == 1:
            words[8:11] = [draw.choice(["dixit", "sagte"]), draw.choice(plain), draw.choice(["grobbler", "snarkle"])]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity._with_reporting(sample, Lexicon(["grobbler", "snarkle"]))
    assert lexicon.reporting == {"dixit", "sagte"}
    assert toxicity._with_reporting(sample, Lexicon()).reporting == frozenset()


def test_the_sample_is_bounded_in_rows(spark, documents):  # noqa: F811
    """A document that is there thousands of times, and labels without documents."""
    docs = documents([(k, f"text {k}") for k in range(100)] + [(3, "hot"), (3, None)] * 3000)
    labels = spark.createDataFrame([(k, k % 2) for k in range(2000)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 20, 30).collect()
    assert len(rows) == 50 and len({r["doc_id"] for r in rows}) == 50
    all_rows = {r["doc_id"]: r["text"] for r in toxicity._sample(docs, labels, 500, 500).collect()}
    assert len(all_rows) == 100 and all_rows[3] == ""


def test_long_words_are_learned(spark):
    word = letters(1, 30) * 4
    rows = [(k, f"{letters(k, 6)} {word if k < 40 else letters(-k, 9)}", int(k < 40)) for k in range(200)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert word in lexicon.words
    matcher = Matcher(Lexicon([word]))
    assert matcher.weigh(word[:50] + "0" + word[51:]) == pytest.approx(0.7) and matcher.weigh(word[:60]) == 0


def plainly(rows, labels):
    """The lexicon, features and scores of the operator with plain loops, for texts without near copies."""
    texts = {}
    for k, text in rows:
        if k is not None:
            texts[k] = min(texts.get(k, text or ""), text or "")
    told = {k: max(y for j, y in labels if j == k) for k in dict(labels) if k in texts}
    words = {k: {toxicity.plain_word(w) for w in texts[k].lower().split()} - {""} for k in told}
    sizes = [sum(y == c for y in told.values()) for c in (0, 1)]

    def telling(having):
        bad, good = (sum(told[k] == c for k in having) for c in (1, 0))
        if bad < toxicity.LEAST_DOCS or bad < toxicity.LEAST_SHARE * (bad + good) or bad * sizes[0] <= good * sizes[1]:
            return False
        share = sizes[1] / sum(sizes)
        g = sum(n * math.log(n / ((bad + good) * p)) for n, p in ((bad, share), (good, 1 - share)) if n)
        return 2 * g >= toxicity.LEAST_CONTRAST

    every = {w for x in words.values() for w in x}
    stems = set()
    for n in toxicity.STEM_LENGTHS:
        for stem in {w[:n] for w in every if len(w) > n}:
            having = [k for k in told if any(len(w) > n and w.startswith(stem) for w in words[k])]
            kinds = {w for k in told if told[k] for w in words[k] if len(w) > n and w.startswith(stem)}
            if len(kinds) >= toxicity.STEM_WORDS and telling(having):
                stems.add(stem)
    terms = {w for w in every if len(w) > 2 and telling([k for k in told if w in words[k]])}
    terms = {w for w in terms if not any(w.startswith(s) for s in stems)}

    def weight(word):
        word = toxicity.plain_word(word)
        if any(word.startswith(s) for s in stems):
            return 1.0
        near = [edits(word, t) for t in terms if edits(word, t) <= toxicity.edits_of(len(t))] if word else []
        if not near or min(near) and any(word in words[k] for k in told if not told[k]):
            return 0.0
        return toxicity.MISSPELLED ** min(near)

    return stems, terms, weight


def test_equal_to_plain_loops(spark, documents):  # noqa: F811
    rows, labels = made(160)
    rows += [(900, "you grobblr of a house"), (901, None), (3, "zz")]
    docs = documents(rows)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, told)
    stems, terms, weight = plainly(rows, labels)
    assert (set(model.lexicon.stems), set(model.lexicon.words)) == (stems, terms)
    matcher = Matcher(model.lexicon)
    for word in {w for _, text in rows for w in (text or "").split()}:
        assert matcher.weigh(word) == pytest.approx(weight(word)), word
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        texts = [t or "" for k, t in rows if k == r["doc_id"]]
        hits = [[weight(w) for w in t.lower().split()] for t in texts]
        wanted = [
            float(model.logistic.probability(np.array([[np.log1p(sum(h)), 0.0, np.log1p(100 * sum(h) / max(1, len(h))), float(any(h))]]))[0])
            for h in hits
        ]
        assert any(r["score"] == pytest.approx(w) for w in wanted)

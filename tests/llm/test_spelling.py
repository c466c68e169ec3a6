import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_data import SMALL, documents  # noqa: F401

from drillsight.llm import spelling

LETTERS = "abcdeéÿ"


def near(a, b):
    """One letter inserted, deleted or replaced, letter by letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def by_hand(counts, ratio=10):
    out = {}
    for word, n in counts.items():
        close = [(x, m) for x, m in counts.items() if near(word, x)]
        form = min(close, key=lambda x: (-x[1], x[0]), default=None)
        form = form if form and form[1] >= ratio * n else None
        out[word] = [n, form and form[0], None, len(close), form and form[1]]
    for word, row in out.items():
        end = word
        while out[end][1]:
            end = out[end][1]
        row[2] = end
    return {w: tuple(r) for w, r in out.items()}


def found(df):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()}


def texts_by_hand(rows):
    """Counts of the query's words, with its misspellings."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def vocabulary(seed, size):
    draw, counts = random.Random(seed), {}
    while len(counts) < size:
        word = "".join(draw.choice(LETTERS) for _ in range(draw.randrange(7, 12)))
        for _ in range(draw.randrange(1, 5)):
            counts[word] = draw.choice([2, 3, 20, 30, 300, 4000])
            at = draw.randrange(len(word))
            kind = draw.randrange(3)
            word = word[:at] + (draw.choice(LETTERS) if kind else "") + word[at + (kind != 2) :]
            if len(word) < 7:
                break
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    counts = vocabulary(seed, 900)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == by_hand(counts)


def test_every_single_edit_shares_a_key(spark):
    """Edits at each place of words of each length, repeated letters included."""
    counts = {}
    for word in ("aaaaaaa", "abababab", "abcdefghi", "mississippi", "éÿéÿéÿéÿ"):
        counts[word] = 1000
        for at in range(len(word) + 1):
            counts.setdefault(word[:at] + "z" + word[at:], 2)
            counts.setdefault(word[:at] + word[at + 1 :], 2) if len(word) > 7 else None
            counts.setdefault(word[:at] + "q" + word[at + 1 :], 2)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == by_hand(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaaab": 2, "aaaaaabb": 20, "aaaaabbb": 200, "aaaabbbb": 2000, "aaabbbbb": 20000}
    counts |= {"tietiex": 2, "tietiea": 20, "tietieb": 20}
    counts |= {f"chainch{'n' * k}": 10**k * 3 for k in range(1, 14)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = found(spelling.variants(words))
    assert rows == by_hand(counts)
    assert rows["aaaaaaab"][2] == "aaabbbbb" and rows["tietiex"][1] == "tietiea"


def test_texts(spark, documents):
    rows = [(k, "Reading readinG reeding, rEADINGS réading ÀÉÎreading ABCDEFG. " * (k % 3)) for k in range(200)]
    rows += [(None, "reading nullkey nullkey"), (1, None), (2, ""), (3, "short wor ds"), (5, "copies copied " * 3), (5, "copies copied " * 3)]
    rows += [(900, "x" * 300_000 + " reading " * 50_000)]
    words = spelling.counted(spelling.misspelt(spelling.runs(documents(rows))))
    want = texts_by_hand(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert found(spelling.variants(words)) == by_hand(want)


def test_empty(spark, documents):
    words = spelling.counted(spelling.misspelt(spelling.runs(documents([]))))
    assert spelling.variants(words).collect() == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    counts = texts_by_hand(docs)
    # All pairs by hand through words with one place blanked or left out, which near words share.
    blanks = defaultdict(set)
    for word in counts:
        for k in range(len(word) + 1):
            blanks[word[:k] + "*" + word[k + 1 :]].add(word)
            blanks[word[:k] + "*" + word[k:]].add(word)
    close = defaultdict(set)
    for group in blanks.values():
        for a in group:
            close[a] |= {b for b in group if near(a, b)}
    rows = found(spelling.query(spark, SMALL))
    assert {w: (r[0], r[3]) for w, r in rows.items()} == {w: (n, len(close[w])) for w, n in counts.items()}
    for word, (n, form, root, _, form_n) in rows.items():
        best = min(((-counts[x], x) for x in close[word]), default=None)
        want = (best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None)
        assert (form, form_n) == want and root == (rows[form][2] if form else word)

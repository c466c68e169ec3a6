import random

import numpy as np
import pytest

from llm_data import documents  # noqa: F401

from drillsight.llm import suffix_dedup
from drillsight.llm.suffix_dedup import Hashes, Suffixes


def removed(texts, span):
    """Brute force: covered flags of every text."""
    seen = {}
    for k, x in enumerate(texts):
        for p in range(len(x) - span + 1):
            seen.setdefault(x[p : p + span], []).append((k, p))
    flags = [bytearray(len(x)) for x in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                flags[k][p : p + span] = b"\1" * span
    return flags


def made(seed=5, n=60):
    draw = random.Random(seed)
    words = ["ab", "c", "dé", "xyz", "q"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randrange(80))) for _ in range(n // 2)]
    out = list(base)
    for x in base:
        at = draw.randrange(len(x) + 1)
        out.append(x[:at] + draw.choice(["", "Z", "longer insert"]) + x[at:])
    return out + ["aaaa" * 30, "aaaa" * 20, "abab" * 30, "", "short", base[0], "日本" * 40, "日本" * 35 + "x"]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_like_brute_force(spark, documents, crowd):
    texts = made()
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, "twice " * 9), (501, "twice " * 9), (None, "no id " * 9)]
    raw = [(t or "").encode() for _, t in rows]
    got = {}
    for r in suffix_dedup.remove_repeats(documents(rows), span=24, gram=7, crowd=crowd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for (doc, _), x, f in zip(rows, raw, removed(raw, 24), strict=True):
        kept = bytes(b for b, hit in zip(x, f, strict=True) if not hit)
        spans = sum(1 for k in range(len(x)) if f[k] and (k == 0 or not f[k - 1]))
        for r in got[doc]:
            assert (r["n_bytes"], r["kept"], len(r["spans"])) == (len(x), kept, spans), doc
            assert sum(s["length"] for s in r["spans"]) == sum(f)
    assert len(got[501]) == 2


def test_empty_table_and_cleaned_texts(spark, documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0
    same = "passage of some length in common"
    docs = documents([(1, "a " + same + " b", "en", "s"), (2, "c " + same + "é", "en", "s"), (3, None)])
    done = suffix_dedup.cleaned(docs, span=20, gram=6)
    assert done.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["lang"]) for r in done.select("doc_id", "text", "n_chars", "lang").collect())[:2] == [
        (1, "a b", 3, "en"), (2, "cé", 2, "en"),
    ]


def _suffixes(texts, hashes, span=12):
    lengths = np.array([len(t) for t in texts])
    places = (lengths - span + 1).astype(np.int64)
    return Suffixes(texts, np.zeros(len(texts), np.int64), places, hashes, span)


def test_order_is_that_of_the_bytes():
    draw = random.Random(6)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(12, 40))) for _ in range(40)]
    s = _suffixes(texts, Hashes(1))
    s.group[:] = 0
    order = s.sorted(np.arange(len(s.at)))
    windows = [s.raw[a : a + 12].tobytes() for a in s.at[order]]
    assert windows == sorted(windows)
    pairs = np.array([(i, j) for i in range(0, len(s.at), 7) for j in range(0, len(s.at), 5)])
    common = s.extension(s.at[pairs[:, 0]], s.at[pairs[:, 1]])
    for (i, j), n in zip(pairs, common, strict=True):
        a, b = (s.raw[s.at[k] : s.at[k] + 12].tobytes() for k in (i, j))
        assert n == next((k for k in range(12) if a[k] != b[k]), 12)


def test_collisions_are_verified():
    """With a hash that is the same for all bytes, only the verification tells windows apart."""
    hashes = Hashes(1)
    hashes.code[:] = 1
    texts = [b"abcdefghijklm", b"abcdefghijklX", b"nopqrstuvwxyz"]
    s = _suffixes(texts, hashes)
    s.group[:] = 0
    assert s.repeated().tolist() == [True, False, True, False, False, False]

import random
import re

import numpy as np
import pytest
import xxhash

from llm_data import SMALL, documents  # noqa: F401

from drillsight.llm import simhash


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, bits):
    """Brute force: the smallest member of each value's component."""
    values = sorted(set(values))
    up = {v: v for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def clustered(seed, n=400):
    draw = random.Random(seed)
    out = []
    for _ in range(n // 20):
        centre = draw.getrandbits(64)
        for _ in range(20):
            v = centre
            for _ in range(draw.randrange(7)):
                v ^= 1 << draw.randrange(64)
            out.append(v)
    return [*out, 0, 1, 2**64 - 1, 2**63]


TEXTS = ["", None, " \t\n", "One", "one two", "One Two THREE four", "ÉÀ b c d é", "a b a b a b a b a b", "x\x1cy z w q"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive(text)


def test_trie_join_is_the_join():
    values = clustered(1)
    want = classes(values, 4)
    join, trie = simhash.Join(4), simhash.Trie(sorted(set(values)))
    join.within(trie)
    assert {v: min(x for x in want if join.top(x) == join.top(v)) for v in want} == want
    left, right = simhash.Trie(sorted(set(values[::2]))), simhash.Trie(sorted(set(values[1::2])))
    both = simhash.Join(4)
    both.within(left)
    both.within(right)
    both.across(left, left.root, right, right.root)
    assert len({both.top(v) for v in want}) == len(set(want.values()))


def test_masks_find_every_pair():
    for nodes in (10, 10**9):
        masks = simhash.schemes(4, nodes)
        draw = random.Random(2)
        for _ in range(300):
            a, b = draw.getrandbits(64), 0
            b = a
            for bit in draw.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_connect_what_brute_force_does(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values = sorted(set(clustered(3)))
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    roots = {r["a"]: r["b"] for r in simhash.components(simhash.links(nodes)).collect()}
    want = classes(values, 4)
    got = {v: roots.get(simhash._signed(v), simhash._signed(v)) for v in values}
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(got[v])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set(got.values())) == len(groups)


def test_documents(spark, documents):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(5, base), (3, base), (9, base + " end"), (9, base + " end"), (1, "other words stand here now"), (None, "only null ids"), (7, None), (8, "")]
    rows += [(None, base)]
    docs = documents(rows)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (9, 3), (1, 1), (None, None), (7, 7), (8, 7), (None, 3)], key=repr)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 1, None, 7], key=repr)
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.representatives(documents([])).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {d: naive(t) for d, t in texts.items()}
    want = classes(prints.values(), 4)
    least = {}
    for d in sorted(texts):
        least.setdefault(want[prints[d]], d)
    for r in simhash.query(spark, SMALL).collect():
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == least[want[prints[r["doc_id"]]]]


def test_large_components(spark):
    """A chain, a star and a pair: the labels settle whatever the shape."""
    edges = [(k, k - 1) for k in range(1, 60)] + [(k, 100) for k in range(101, 160)] + [(201, 200)]
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r["a"]: r["b"] for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 60), 0), **dict.fromkeys(range(101, 160), 100), 201: 200}
    assert np.all(np.array(list(got)) > np.array(list(got.values())))


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_few_bits(spark, bits):
    values = clustered(bits, 200)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in set(values)], "fp long")
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(nodes, bits).collect()}
    want = classes(values, bits)
    up = {v: {v} for v in want}
    for a, b in found:
        both = up[a] | up[b]
        for v in both:
            up[v] = both
    assert {v: min(s) for v, s in up.items()} == want


def test_a_very_long_text(spark, documents):  # noqa: F811
    text = " ".join(f"w{k % 9973}" for k in range(200_000)) + " " + "x" * 500_000
    rows = simhash.near_duplicates(documents([(1, text), (2, text), (3, "other words stand here now")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (3, 3)}
    assert rows[0]["fp"] % 2**64 in {simhash.fingerprint(text), simhash.fingerprint("other words stand here now")}

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_data import SMALL, documents  # noqa: F401

from drillsight.llm import packing
from drillsight.llm.chunks import ChunkEncoder, cut_dropping_spaces

PATH = public_tokenizers.path("word_bpe_49k.json")


def padding(sequences, size):
    return sum(size - n for n in sequences.values() if n & (n - 1))


def check(rows, docs, size):
    """Every id once, sequences without gaps; gives the lengths of the sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, texts in docs.items():
        want = sorted(
            [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts
        )
        total = sorted(len(x) for x in want)
        assert sum(r["length"] for r in pieces[doc]) == sum(total)
        if len(want) == 1:
            found = []
            for r in sorted(pieces[doc], key=lambda r: r["start"]):
                assert r["start"] == len(found) and r["doc_tokens"] == len(want[0])
                found += np.frombuffer(r["ids"], "<u4").tolist()
            assert found == want[0]
    lengths = {}
    for key, rows_of in sequences.items():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        lengths[key] = at
    return lengths


def test_plain_words_get_the_same_ids():
    """Chunks with signs, marks, numbers, special tokens and letters that change in lower case."""
    draw = random.Random(9)
    odd = ["İx", "ß", "é", "a\u0301,", "Å.", "x\u0338=", "don't", "'s", "l'eau!", "a,b", "%%%", "a%%%", "ab***", "word.\u0301", "ﬁn", "ǅ", "א", "日本語。", "<|endoftext|>", "a<|endoftext|>.", "<|startoftext|>x", "9,9", "", "\u00a0", "a\u00a0b", "×a÷.", "ſ", "K", "\x00", "a\x00,"]
    letters = "abcXYZéÀßÿ.,;:!?%$#*&'|<>\u0301\u0130 9"
    chunks = odd + ["".join(draw.choice(letters.replace(" ", "")) for _ in range(draw.randrange(1, 9))) for _ in range(30_000)]
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.WordEncoder(file.read())
    want = [x.ids for x in tokenizer.encode_batch(chunks, add_special_tokens=False)]
    assert encoder(chunks) == want
    for bound in (1 << 30, 100_000):  # with parts of chunks, and starting anew now and then
        whole = ChunkEncoder(cut_dropping_spaces, encoder, packing.SIGN.split, bound)
        for first in range(0, len(chunks), 700):
            ids, counts = whole(chunks[first : first + 700])
            split = np.split(ids, np.cumsum(counts)[:-1])
            assert [x.tolist() for x in split] == want[first : first + 700]


def test_bounded_and_without_padding():
    draw = random.Random(3)
    packer, closed, total = packing.Packer(64, 4), [], 0
    for doc in range(500):
        n = draw.choice([1, 5, 20, 63, 64, 65, 200])
        total += n
        for window in packer.add((doc, 0, np.arange(n), n)):
            closed.append(sum(len(p[2]) for p in window))
        assert len(packer.windows) <= 4
    assert set(closed) == {64}
    rest = [sum(len(p[2]) for p in w) for w in packer.rest()]
    assert sum(closed) + sum(rest) == total and all(n & (n - 1) == 0 for n in rest)


def test_best_fit():
    packer = packing.Packer(10, 3)
    for doc, n in enumerate((6, 8, 5)):
        assert list(packer.add((doc, 0, np.arange(n), n))) == []
    assert [[p[0] for p in w] for w in packer.add((3, 0, np.arange(2), 2))] == [[1, 3]]


def test_documents(spark, documents):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["ab", "the", "Ünder", "x9!", "<|endoftext|>"]) for _ in range(draw.randrange(60))) for _ in range(80)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(100, None), (101, ""), (102, "w " * 900), (103, "same"), (103, "same"), (None, "no id")]
    docs = defaultdict(list)
    for doc, text in rows:
        docs[doc].append(text)
    done = packing.pack(documents(rows).repartition(7), PATH, size=64, open_windows=3, fan=2).collect()
    assert padding(check(done, docs, 64), 64) == 0
    assert packing.pack(documents([]), PATH).count() == 0


def test_query_checksums(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in packing.query(spark, SMALL, PATH).collect():
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids)

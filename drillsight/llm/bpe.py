"""Byte-pair encoding with a contiguous array of ranks, and decoding.

A short word is a row of part ids with the rank of every neighbouring pair beside it.
The smallest rank of the row is searched (the leftmost, if equal), the boundary between
its two parts is deleted, and the ranks of the new part with its two neighbours are looked
up again, until no pair has a rank.  Rows of many words are worked on together.  A word too
long for scans (over :data:`SHORT` bytes) keeps its pairs in a heap; the order of merges,
and so the result, is the same.

Rules: a null text is the empty text and gives an empty list.  Strings of special tokens
in a text become their ids, as the tokenizers library does by default.  A null list of ids
decodes to the empty text, ids outside of the vocabulary are an error.  Other columns are
not touched by :func:`encode` and :func:`decode`; they work row by row, so repeated rows
give repeated results.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillsight.llm.chunks import ChunkEncoder, cut_keeping_spaces
from drillsight.llm.common import list_array, steps, table, whole_texts

#: Words of up to so many bytes are scanned, longer ones use a heap.
SHORT = 48

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """Bytes by the letter that stands for them in the vocabulary file: printable bytes
    stand for themselves, the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The merge table of a byte-level BPE file, as arrays that fit into a closure."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        order = np.argsort(left << np.uint64(32) | right, kind="stable")
        self.pairs = (left << np.uint64(32) | right)[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.pieces = pa.array(self.tokens, pa.large_binary())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NONE`` for pairs that do not merge."""
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE)


def texts_of(ids: pa.ListArray, vocab: Vocabulary) -> list[str]:
    """The text of each list of ids: the bytes of all tokens are put side by side at once."""
    taken = vocab.pieces.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id is null")
    if not len(taken):
        return [""] * len(ids)
    offsets, data = taken.buffers()[1:]
    raw = memoryview(data or b"")
    rows = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    ends = np.frombuffer(offsets, np.int64, len(taken) + 1)[rows].tolist()
    return [str(raw[a:b], "utf-8", "replace") for a, b in zip([0, *ends], ends)]


def merge_rows(parts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of one length: a row of part ids each.  Gives the ids, left-aligned,
    and how many of each row are in use."""
    n, width = parts.shape
    parts = parts.copy()
    used = np.full(n, width)
    final, counts = np.zeros_like(parts), np.zeros(n, np.int64)
    rows = np.arange(n)
    ranks = np.full((n, width), _NONE, np.int32)
    if width > 1:
        ranks[:, :-1] = vocab.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, -1)
    columns = np.arange(width)
    while len(rows):
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(rows)), at]
        if (done := least == _NONE).any():
            final[rows[done]], counts[rows[done]] = parts[done], used[done]
            keep = ~done
            rows, parts, ranks, used = rows[keep], parts[keep], ranks[keep], used[keep]
            at, least = at[keep], least[keep]
            if not len(rows):
                break
        here = np.arange(len(rows))
        parts[here, at] = vocab.merged[least]
        # Delete the boundary: what stands behind moves one place to the left.
        moved = columns[None, :-1] > at[:, None]
        parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
        moved_ranks = columns[None, :-1] >= at[:, None]
        ranks[:, :-1] = np.where(moved_ranks, ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = _NONE
        used -= 1
        behind = np.flatnonzero(at + 1 < used)
        ranks[here, at] = _NONE
        ranks[behind, at[behind]] = vocab.rank(parts[behind, at[behind]], parts[behind, at[behind] + 1])
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = vocab.rank(parts[before, at[before] - 1], parts[before, at[before]])
    return final, counts


def merge_long(parts: list[int], vocab: Vocabulary) -> list[int]:
    """The same merges for one long word, with the pairs in a heap."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    first = vocab.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist() if n > 1 else []
    heap = [(r, k, parts[k], parts[k + 1]) for k, r in enumerate(first) if r != _NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def offer(k: int) -> None:
        pair = (parts[k], parts[after[k]])
        if pair not in known:
            known[pair] = int(vocab.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
        if known[pair] != _NONE:
            heapq.heappush(heap, (known[pair], k, *pair))

    while heap:
        r, k, left, right = heapq.heappop(heap)
        j = after[k]
        if not alive[k] or parts[k] != left or j >= n or parts[j] != right:
            continue
        parts[k], alive[j] = int(vocab.merged[r]), False
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [p for p, here in zip(parts, alive, strict=True) if here]


class Encoder:
    """Ids of chunks of text, for :class:`ChunkEncoder`."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.pre = regex.compile(PRE_TOKENS)
        names = sorted(vocab.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def split(self, chunk: str) -> list[str]:
        """The words and special tokens of a chunk; each of them alone is cut no further."""
        for name in self.vocab.special:
            if name in chunk:
                break
        else:
            return self.pre.findall(chunk)
        out: list[str] = []
        for k, part in enumerate(self.special.split(chunk)):
            out += [part] if k % 2 else self.pre.findall(part)
        return out

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of words, in their order."""
        of_byte = self.vocab.of_byte
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        for k, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                out[k] = merge_long(of_byte[np.frombuffer(raw, np.uint8)].tolist(), self.vocab)
                continue
            places, raws = by_length.setdefault(len(raw), ([], []))
            places.append(k)
            raws.append(raw)
        for length, (places, raws) in by_length.items():
            raw = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, length)
            ids, counts = merge_rows(of_byte[raw], self.vocab)
            for k, row, n in zip(places, ids.tolist(), counts.tolist(), strict=True):
                out[k] = row[:n]
        return out

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        return dict(zip(words, self.merged(words), strict=True))

    def parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of words and special tokens as :meth:`split` gives them."""
        special = self.vocab.special
        ids = iter(self.merged([x for x in parts if x not in special]))
        return [[special[x]] if x in special else next(ids) for x in parts]

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        cut = [self.split(x) for x in chunks]
        known = list(dict.fromkeys(w for x in cut for w in x))
        ids = dict(zip(known, self.parts(known), strict=True))
        return [[i for w in x for i in ids[w]] for x in cut]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, ids``: every whole text with its ids as an array of int.

    ``path`` names the vocabulary file; the driver reads it, tasks get its tables (a few MB).
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Encoder(vocab.value)
        encoder = ChunkEncoder(cut_keeping_spaces, words.parts, words.split)
        for batch in steps(batches):
            ids, counts = encoder(whole_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, list_array(ids, counts, pa.int32())], [key, text, "ids"]
            )

    plain = docs.select(key, text)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` without ``text``, with the text of the ids added as ``out``."""
    vocab = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kept = rows.select(*[c for c in rows.columns if c not in ("text", out)])
    names, place = [*kept.columns, out], kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for first in range(0, big.num_rows, 256):
                batch = big.slice(first, 256)
                texts = texts_of(batch.column(place), vocab.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names
                )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def query(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Digest columns of the round trip of all documents."""
    done = decode(encode(table(spark, folder, "documents"), path), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

"""Bounded-space online packing of documents into token sequences of one size.

Each partition keeps a fixed number of open windows.  A document's ids come in pieces: full
windows at once, and the rest goes into the open window it fills best.  When none has room
and all windows are in use, the fullest is emitted; its small gap takes the head of the
waiting piece, so an emitted window has no padding.  What stays open at the end of a
partition is merged: groups of partitions go through the same procedure, round after round,
until one group is left.  Its remainder is cut into sequences of a power of two, which need
no padding either.

Rules: a null text is empty; an empty text is its end id alone.  Repeated rows are packed
each.  Every id lies in exactly one piece.  An empty table gives no piece.  Sequence ids are
unique, not consecutive: round, group, and count within the group.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.bpe import byte_letters
from drillsight.llm.chunks import ChunkEncoder, cut_dropping_spaces
from drillsight.llm.common import STEP_BYTES, steps, table, whole_texts
from drillsight.session import stage

SIZE = 2048
OPEN_WINDOWS = 64
#: Partitions, or groups, whose open windows are merged by one task.
FAN = 64

#: Words that the tokenizer's normal form only puts in lower case: each is one pre-token.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Between such a letter and one of these signs a pre-token ends.
SIGN = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?%$#*&])")

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, open boolean, part long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("open", pa.bool_()),
        ("part", pa.int64()),
    ]
)

#: A piece: document, its start there, its ids, the document's number of ids.
Piece = tuple[int | None, int, np.ndarray, int]


class WordEncoder:
    """Ids of chunks, for tokenizers that drop white space, lower the case and work on bytes.

    A plain word is one pre-token, so it goes straight to the merges, its bytes as the letters
    that stand for them.  Other chunks take the tokenizer's whole way.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.merge = self.tokenizer.model.tokenize
        letter = {byte: x for x, byte in byte_letters().items()}
        self.letters = {n: "".join(letter[b] for b in chr(n).encode()) for n in range(0xC0, 0x100)}

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        merge, letters = self.merge, self.letters
        found = {
            x: [t.id for t in merge(x.lower() if x.isascii() else x.lower().translate(letters))]
            for x in chunks
            if _WORD.fullmatch(x)
        }
        others = [x for x in dict.fromkeys(chunks) if x not in found]
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        found.update((x, e.ids) for x, e in zip(others, encoded, strict=True))
        return [found[x] for x in chunks]


class Packer:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.windows: list[list[Piece]] = []
        self.used: list[int] = []

    def _put(self, window: int, piece: Piece) -> Iterator[list[Piece]]:
        self.windows[window].append(piece)
        self.used[window] += len(piece[2])
        if self.used[window] == self.size:
            yield self._take(window)

    def _take(self, window: int) -> list[Piece]:
        self.used.pop(window)
        return self.windows.pop(window)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece; gives the windows that are emitted for it."""
        doc, start, ids, total = piece
        while len(ids) >= self.size:
            yield [(doc, start, ids[: self.size], total)]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        room = [k for k, used in enumerate(self.used) if used + len(ids) <= self.size]
        if room:
            yield from self._put(max(room, key=self.used.__getitem__), (doc, start, ids, total))
            return
        if len(self.windows) == self.most:
            fullest = max(range(self.most), key=self.used.__getitem__)
            gap = self.size - self.used[fullest]
            yield from self._put(fullest, (doc, start, ids[:gap], total))
            start, ids = start + gap, ids[gap:]
        self.windows.append([])
        self.used.append(0)
        yield from self._put(len(self.windows) - 1, (doc, start, ids, total))

    def rest(self) -> Iterator[list[Piece]]:
        """Cut what is still open into sequences of a power of two."""
        queue = [p for w in self.windows for p in w]
        left = sum(len(p[2]) for p in queue)
        while left:
            want = min(self.size, 1 << (left.bit_length() - 1))
            left -= want
            out: list[Piece] = []
            while want:
                doc, start, ids, total = queue.pop(0)
                out.append((doc, start, ids[:want], total))
                if len(ids) > want:
                    queue.insert(0, (doc, start + want, ids[want:], total))
                want -= len(out[-1][2])
            yield out


class _Rows:
    """Collects windows as rows of an Arrow batch."""

    def __init__(self, round_no: int, part: int, out_part: int) -> None:
        self.base, self.count, self.part = (round_no << 58) | (part << 30), 0, out_part
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, window: list[Piece], still_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            self.rows.append(
                (doc, start, len(ids), raw, total, self.base + self.count, at, still_open, self.part)
            )
            self.size += len(raw)
            at += len(ids)
        self.count += 1

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(_ARROW)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def pack(
    docs: DataFrame,
    path: str,
    size: int = SIZE,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = 1,
    fan: int = FAN,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` as
    little-endian unsigned 32-bit numbers.  ``path`` is the tokenizer file, broadcast as text.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(cut_dropping_spaces, WordEncoder(spec.value), SIGN.split)
        part = TaskContext.get().partitionId()
        packer, rows = Packer(size, open_windows), _Rows(0, part, part)
        for batch in steps(batches):
            ids, counts = encoder(whole_texts(batch.column(1)))
            at = 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id)
                at += n
                for window in packer.add((doc, 0, own, n + 1)):
                    rows.add(window)
            if rows.size >= STEP_BYTES:
                yield rows.take()
        for window in packer.windows:
            rows.add(window, still_open=True)
        yield rows.take()

    def merged(round_no: int, group: int, last: bool, rows_in: Iterator[pa.RecordBatch]):
        packer, rows = Packer(size, open_windows), _Rows(round_no, group, group)
        for batch in rows_in:
            names = batch.schema.names
            for row in zip(*[batch.column(names.index(c)).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True):
                for window in packer.add((row[0], row[1], np.frombuffer(row[2], "<u4"), row[3])):
                    rows.add(window)
            if rows.size >= STEP_BYTES:
                yield rows.take()
        for window in packer.rest() if last else packer.windows:
            rows.add(window, still_open=not last)
        yield rows.take()

    packed = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, SCHEMA), "packed")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    done, still_open, round_no = packed.filter("not open"), packed.filter("open"), 0
    while True:
        round_no += 1
        groups = -(-parts // fan)
        last = groups == 1

        def merge(batches: Iterator[pa.RecordBatch], number=round_no, end=last) -> Iterator[pa.RecordBatch]:
            # Sorted by group: one packer after the other, so memory stays that of a group.
            current, waiting = None, []
            for batch in batches:
                labels = batch.column("part").to_numpy() // fan
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if current is not None and labels[a] != current:
                        yield from merged(number, current, end, iter(waiting))
                        waiting = []
                    current = int(labels[a])
                    waiting.append(batch.slice(a, b - a))
            if current is not None:
                yield from merged(number, current, end, iter(waiting))

        regrouped = still_open.repartition(groups, F.floor(F.col("part") / fan)).sortWithinPartitions(
            "part", "sequence_id", "offset"
        )
        after = stage(regrouped.mapInArrow(merge, SCHEMA), f"packed-{round_no}")
        done = done.unionByName(after.filter("not open"))
        if last:
            return done.drop("open", "part")
        still_open, parts = after.filter("open"), groups


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Every piece of all documents, with the checksum of its ids instead of them."""
    return pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The pieces of all documents."""
    return pieces(table(spark, folder, "documents"), path)

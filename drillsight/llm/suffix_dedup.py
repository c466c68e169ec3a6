"""Removal of long repeated byte strings, by a distributed hash-compared suffix sort.

A suffix matters here by its first :data:`SPAN` bytes, its *window*.  Equal windows have to
meet, so each is dealt out by its *anchor*: the 40-byte string inside the window whose hash
is smallest (the leftmost of them, if equal).  Equal windows have equal anchors at equal
places.  Windows that follow each other and share an anchor form a *segment*, which is one
small row; most of the work is on these rows, without text:

1. Count the segments of each anchor.  An anchor seen once has no repeated window.
2. Segments of equal anchor and equal content (two hashes, 128 bits) repeat as a whole.
3. Where an anchor has segments of different content, one of each content is cut out of its
   text and sent to the anchor's task.  The task sorts the suffixes: prefix polynomial
   hashes and a binary search give the common extension of two suffixes, so a comparison
   takes a logarithmic number of steps; a mergesort (all merges of one width at once, as
   array operations) orders them; neighbours whose common extension reaches the window are
   verified byte by byte.  Suffixes whose window hash is unique in the task are left out
   beforehand, as they have no equal neighbour.

An anchor with more than :data:`CROWD` contents would fill a task.  Its windows become rows
with two independent hashes (128 bits) that are counted by Spark: exact but for a collision
of both.

Rules: texts are UTF-8 bytes, a null text is empty.  A window never reaches over the end of
a text.  All copies of a repeated string are removed, the first included, judged on the
input.  Repeated rows are repeated texts.  Texts shorter than a window lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillsight.llm.common import ranges, steps, table, with_fields
from drillsight.session import stage

#: Bytes of a string that counts as repeated.
SPAN = 200
#: Bytes of an anchor.
GRAM = 40
#: Segments of different content of one anchor that one task sorts.
CROWD = 20_000
#: Windows of a long text that are hashed at once, and segment bytes that are sorted at once.
_BLOCK = 1 << 19
_SORT_BYTES = 1 << 20

_U = np.uint64
_LOW = _U(255)


class Hashes:
    """Prefix polynomial hashes modulo 2^64 over randomly chosen codes of the bytes."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.code = draw.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(draw.integers(0, 1 << 62)) * 4 + 3
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, _BLOCK + 4 * SPAN)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, base % (1 << 64), np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def prefixes(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes, the empty one first."""
        self._powers(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the ``length`` bytes from ``at`` on, wherever they stand."""
        return (prefixes[at + length] - prefixes[at]) * self.down[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _segments(raw: np.ndarray, hashes: Hashes, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """``start, windows, anchor place, anchor hash, content hash`` of the segments of a block."""
    prefixes = hashes.prefixes(raw)
    grams = len(raw) - gram + 1
    own = _mixed((prefixes[gram:] - prefixes[:-gram]) * hashes.down[:grams])
    # The low byte carries how far the smallest hash is from the window's start.
    least, width, wide = own & ~_LOW, 1, span - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:] + _U(width))
        width *= 2
    if rest := wide - width:
        least = np.minimum(least[:-rest], least[rest:] + _U(rest))
    anchor = np.arange(len(least)) + (least & _LOW).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    count = np.diff(np.append(start, len(anchor)))
    anchor = anchor[start]
    content = hashes.of(prefixes, start, count + span - 1)
    content = _mixed(content ^ _mixed(count.astype(np.uint64) << _U(8) | (anchor - start).astype(np.uint64)))
    return start, count, anchor - start, own[anchor], content


def _keyed(docs: DataFrame, others: list[str]) -> DataFrame:
    """The texts as bytes, with the two parts of the key by which a text is found again,
    and the ``others`` of its columns as they are."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.xxhash64(text, doc_id).alias("mark"),
        text.cast("binary").alias("raw"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"),
    )


def _zipped(keyed: DataFrame) -> DataFrame:
    """The texts compressed, for their way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=3)
        for batch in steps(batches, 2):
            zipped = pa.array([zipper.compress(x) for x in batch.column(2).to_pylist()], pa.binary())
            columns = [batch.column(0), batch.column(1), zipped, batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "zipped", "rest"])

    schema = with_fields(T.StructType(), ("id", "long"), ("mark", "long"), ("zipped", "binary"))
    return keyed.mapInArrow(run, schema.add(keyed.schema["rest"]))


def segments(keyed: DataFrame, span: int, gram: int, seed: int) -> DataFrame:
    """``id, mark, anchor, content, place``; ``place`` packs start, anchor place and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(seed)
        for batch in steps(batches, 2):
            rows, found = [], []
            for row, raw in enumerate(batch.column(2)):
                text = np.frombuffer(raw.as_buffer(), np.uint8)
                for first in range(0, len(text) - span + 1, _BLOCK):
                    start, count, off, anchor, content = _segments(
                        text[first : first + _BLOCK + span - 1], hashes, span, gram
                    )
                    place = (start + first) << 16 | off << 8 | count
                    rows.append(np.full(len(start), row))
                    found.append((anchor.view(np.int64), content.view(np.int64), place))
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at)]
                + [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)],
                ["id", "mark", "anchor", "content", "place"],
            )

    return keyed.mapInArrow(run, "id long, mark long, anchor long, content long, place long")


class Suffixes:
    """The windows of some segments, laid one after the other, and their order."""

    def __init__(self, texts: list[bytes], anchors: np.ndarray, places: np.ndarray, hashes: Hashes, span: int):
        self.span, self.hashes = span, hashes
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.prefixes = hashes.prefixes(raw)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(lengths) - lengths
        self.count = places & 255
        self.segment = np.repeat(np.arange(len(texts)), self.count)
        self.at = ranges(self.first, self.count)
        inside = self.at - self.first[self.segment]
        # Equal windows have their anchor at the same place: only such are compared.
        self.group = anchors[self.segment] * 512 + ((places >> 8 & 255)[self.segment] - inside)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(len(raw), np.uint64)
        for k in range(8):
            self.word = self.word << _U(8) | padded[k : k + len(raw)]
        self.raw = raw

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes, up to the span, by binary search over hashes."""
        of, prefixes = self.hashes.of, self.prefixes
        low = np.where(of(prefixes, a, self.span) == of(prefixes, b, self.span), self.span, 0)
        todo = np.flatnonzero(low < self.span)
        lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.span - 1)
        x, y = a[todo], b[todo]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = of(prefixes, x, mid) == of(prefixes, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[todo] = lo
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes at ``a`` and ``b``."""
        x, y = self.word[a], self.word[b]
        out = (x > y).astype(np.int8) - (x < y)
        tie = np.flatnonzero(out == 0)
        if len(tie):
            a, b = a[tie], b[tie]
            common = self.extension(a, b)
            last = np.minimum(common, self.span - 1)
            out[tie] = np.where(
                common == self.span, 0, np.sign(self.raw[a + last].astype(np.int16) - self.raw[b + last])
            )
        return out

    def sorted(self, windows: np.ndarray) -> np.ndarray:
        """The windows by group, in each group by suffix: a mergesort of growing runs."""
        order = windows[np.argsort(self.group[windows], kind="stable")]
        group = self.group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.append(starts, len(order)))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while (own := np.flatnonzero(size > width)).size:
            rank = own - base[own]
            left = rank // (2 * width) * (2 * width)
            in_left = rank - left < width
            middle = np.minimum(left + width, size[own])
            end = np.minimum(left + 2 * width, size[own])
            lo = base[own] + np.where(in_left, middle, left)
            other = lo.copy()
            hi = base[own] + np.where(in_left, end, middle)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                sign = self.compare(self.at[order[mid]], self.at[order[own[open_]]])
                before = (sign < 0) | (~in_left[open_] & (sign == 0))
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            place = base[own] + left + (rank - np.where(in_left, left, middle)) + (lo - other)
            order[place] = order[own]
            width *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two windows are equal byte by byte."""
        same = np.ones(len(a), bool)
        for k in [*range(0, self.span - 7, 8), self.span - 8]:
            same &= self.word[a + k] == self.word[b + k]
        return same

    def repeated(self) -> np.ndarray:
        """Which windows occur more than once."""
        out = np.zeros(len(self.at), bool)
        own = self.hashes.of(self.prefixes, self.at, self.span)
        by_hash = np.argsort(own, kind="stable")
        same = own[by_hash[1:]] == own[by_hash[:-1]]
        order = self.sorted(by_hash[np.r_[same, False] | np.r_[False, same]])
        a, b = order[:-1], order[1:]
        near = self.group[a] == self.group[b]
        a, b = a[near], b[near]
        long_enough = self.extension(self.at[a], self.at[b]) == self.span
        a, b = a[long_enough], b[long_enough]
        verified = self.equal(self.at[a], self.at[b])
        out[a[verified]] = out[b[verified]] = True
        if not verified.all():  # a collision hides who is equal to whom: compare the bytes
            for group in np.unique(self.group[a[~verified]]):
                seen: dict[bytes, int] = {}
                for w in order[self.group[order] == group]:
                    window = self.raw[self.at[w] : self.at[w] + self.span].tobytes()
                    if (first := seen.setdefault(window, w)) != w:
                        out[first] = out[w] = True
        return out

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of flagged windows: segment, first window inside it, number."""
        edge = np.r_[True, self.segment[1:] != self.segment[:-1]]
        begin = np.flatnonzero(flags & (edge | ~np.r_[False, flags[:-1]]))
        end = np.flatnonzero(flags & (np.r_[edge[1:], True] | ~np.r_[flags[1:], False]))
        segment = self.segment[begin]
        return segment, self.at[begin] - self.first[segment], end - begin + 1


_CUT = "id long, mark long, anchor long, single boolean, place long, bytes binary"


def _cut_out(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of segments: ``wanted`` has ``id, mark, anchor, single, place``."""
    by_text = wanted.groupBy("id", "mark").agg(
        F.collect_list(F.struct("anchor", "single", "place")).alias("wanted")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        names = ["id", "mark", "anchor", "single", "place", "bytes"]
        for batch in steps(batches, 2):
            wanted = batch.column(3)
            counts = np.diff(wanted.offsets.to_numpy())
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            anchor, single, place = wanted.flatten().flatten()
            raws, at, out = batch.column(2).to_pylist(), 0, []
            starts, windows = (place.to_numpy() >> 16).tolist(), (place.to_numpy() & 255).tolist()
            for raw, n in zip(raws, counts.tolist(), strict=True):
                text = unzip.decompress(raw)
                for k in range(at, at + n):
                    out.append(text[starts[k] : starts[k] + windows[k] + span - 1])
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), anchor, single, place, pa.array(out, pa.binary())],
                names,
            )

    joined = texts.join(by_text, ["id", "mark"]).select("id", "mark", "zipped", "wanted")
    return joined.mapInArrow(run, _CUT)


def _sorted_runs(cut: DataFrame, parts: int, span: int, seed: int) -> DataFrame:
    """``id, mark, place``: runs of repeated windows, found by the suffix sort of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(seed)

        def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks()
            keys = [whole.column(c).to_numpy() for c in ("anchor", "id", "mark", "place")]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]  # a repeated row is cut twice
            whole = whole.filter(pa.array(new))
            anchor, ids, marks, place = (k[new] for k in keys)
            anchors = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])
            windows = Suffixes(whole.column("bytes").to_pylist(), anchors, place, hashes, span)
            flags = windows.repeated() & whole.column("single").to_numpy()[windows.segment]
            segment, inside, count = windows.runs(flags)
            found = ((place[segment] >> 16) + inside) << 16 | count
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[segment]), pa.array(marks[segment]), pa.array(found)], ["id", "mark", "place"]
            )

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if size >= _SORT_BYTES and waiting[-1].column(2)[-1].as_py() != int(anchor[a]):
                    yield solved(waiting)
                    waiting, size = [], 0
                waiting.append(batch.slice(a, b - a))
                size += 300 * (b - a)
        if waiting:
            yield solved(waiting)

    return (
        cut.repartition(parts, "anchor")
        .sortWithinPartitions("anchor", "id", "mark", "place")
        .mapInArrow(run, "id long, mark long, place long")
    )


def _counted_runs(cut: DataFrame, span: int, seed: int) -> DataFrame:
    """The same for crowded anchors, by counting windows under two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Hashes(seed), Hashes(seed + 1)
        for batch in steps(batches, 5, _SORT_BYTES):
            place = batch.column(4).to_numpy()
            windows = Suffixes(batch.column(5).to_pylist(), np.arange(len(place)), place, both[0], span)
            at, segment = windows.at, windows.segment
            first = both[0].of(windows.prefixes, at, span)
            second = both[1].of(both[1].prefixes(windows.raw), at, span)
            start = (place[segment] >> 16) + at - windows.first[segment]
            rows = pa.array(segment)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(start << 16 | 1),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                ],
                ["id", "mark", "place", "h1", "h2"],
            )

    schema = "id long, mark long, place long, h1 long, h2 long"
    windows = stage(cut.mapInArrow(run, schema).dropDuplicates(["id", "mark", "place"]), "windows")
    often = windows.groupBy("h1", "h2").count().filter("count > 1").drop("count")
    return windows.join(often, ["h1", "h2"]).select("id", "mark", "place")


def _removed(texts: DataFrame, marks: DataFrame, span: int, as_text: bool) -> DataFrame:
    """Apply the marks: ``kind`` 0 repeats, 1 is taken back, 2 repeats as the sort found."""
    out = with_fields(
        T.StructType([texts.schema["rest"]]),
        ("n_bytes", "long"),
        ("spans", "array<struct<start:long,length:long>>"),
        ("kept", "string" if as_text else "binary"),
    )
    by_text = marks.groupBy("id", "mark").agg(F.collect_set(F.struct("kind", "place")).alias("marks"))

    def spans(kind: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = place[kind == 0]
        whole = whole[~np.isin(whole, place[kind == 1])]
        start = np.concatenate([whole >> 16, place[kind == 2] >> 16])
        end = start + np.concatenate([whole & 255, place[kind == 2] & 65535]) + span - 1
        if not len(start):
            return start, end
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        head = np.r_[True, start[1:] > end[:-1]]
        return start[head], end[np.r_[head[1:], True]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rest", "n_bytes", "spans", "kept"]
        for batch in steps(batches, 1):
            raws, marks, sizes, kept, counts, starts, lengths = batch.column(1).to_pylist(), batch.column(2), [], [], [], [], []
            unzip = zstandard.ZstdDecompressor()
            kinds, places = (x.to_numpy() for x in marks.flatten().flatten())
            at = 0
            for raw, n in zip(raws, np.asarray(marks.value_lengths().fill_null(0)), strict=True):
                text = unzip.decompress(raw)
                start, end = spans(kinds[at : at + n], places[at : at + n]) if n else (np.zeros(0, int),) * 2
                at += n
                edges = zip(np.r_[0, end].tolist(), np.r_[start, len(text)].tolist(), strict=True)
                kept.append(b"".join(text[a:b] for a, b in edges))
                sizes.append(len(text))
                counts.append(len(start))
                starts.append(start)
                lengths.append(end - start)
            cut = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (starts, lengths)], ["start", "length"]
            )
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), cut),
                    pa.array([x.decode("utf-8", "ignore") for x in kept] if as_text else kept, kind),
                ],
                names,
            )

    kind = pa.string() if as_text else pa.binary()
    joined = texts.join(by_text, ["id", "mark"], "left").select("rest", "zipped", "marks")
    return joined.mapInArrow(run, out)


def _repeats(
    docs: DataFrame,
    others: list[str],
    as_text: bool,
    span: int = SPAN,
    gram: int = GRAM,
    crowd: int = CROWD,
    seed: int = 2026,
) -> DataFrame:
    """``rest, n_bytes, spans, kept``, with the ``others`` in ``rest``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, others)
    rows = segments(keyed.drop("rest"), span, gram, seed)
    shared = (
        rows.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .filter("n > 1")
        .select("anchor", (F.col("lo") != F.col("hi")).alias("varied"))
    )
    # Written first, so that adaptive execution can split a crowded anchor in this join.
    hits = stage(rows.join(stage(shared, "repeats-anchors"), "anchor"), "repeats")
    contents = (
        hits.filter("varied")
        .groupBy("anchor", "content")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "place")).alias("one"))
        .select("anchor", (F.col("n") == 1).alias("single"), "one.*")
    )
    # An anchor whose contents all repeat is settled; what is left has a content seen once.
    contents = stage(contents, "repeats-contents")
    sizes = contents.groupBy("anchor").agg(F.count("*").alias("n"), F.max("single").alias("open"))
    wanted = contents.join(sizes.filter("open").drop("open"), "anchor").withColumn("crowded", F.col("n") > crowd)
    texts = _zipped(keyed)
    cut = _cut_out(texts, wanted.filter("not crowded"), span)
    found = stage(_sorted_runs(cut, parts, span, seed), "repeats-sorted")
    marks = (
        hits.select("id", "mark", F.lit(0).alias("kind"), "place")
        .unionByName(contents.filter("single").select("id", "mark", F.lit(1).alias("kind"), "place"))
        .unionByName(found.select("id", "mark", F.lit(2).alias("kind"), "place"))
    )
    if wanted.filter("crowded").limit(1).count():
        more = _counted_runs(_cut_out(texts, wanted.filter("crowded"), span), span, seed)
        marks = marks.unionByName(more.select("id", "mark", F.lit(2).alias("kind"), "place"))
    return _removed(texts, marks, span, as_text)


def remove_repeats(docs: DataFrame, **rules: int) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the runs of bytes removed, and the bytes that stay.

    ``rules``: ``span``, ``gram``, ``crowd`` and ``seed``, see the constants above.
    """
    return _repeats(docs, ["doc_id"], False, **rules).select("rest.doc_id", "n_bytes", "spans", "kept")


def cleaned(docs: DataFrame, **rules: int) -> DataFrame:
    """All rows and columns, with the repeats taken out of ``text`` and ``n_chars`` to match.

    Bytes of a letter that was cut apart are left out.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = _repeats(docs, others, True, **rules).select("rest.*", F.col("kept").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """What is removed of every document, and a digest of the rest."""
    done = remove_repeats(table(spark, folder, "documents"))
    length = F.transform("spans", lambda s: s["length"])
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate(length, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

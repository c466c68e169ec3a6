"""SimHash near-duplicates: fingerprints, and a self-join of a binary trie of them.

Distinct fingerprints are dealt out by blocks of their bits: two that differ in at most
``bits`` bits agree in all but ``bits`` blocks, so they meet in one group at least.  In a
group the fingerprints form a binary trie.  The join walks pairs of nodes, compares the bits
that both have fixed, and leaves a pair as soon as they differ in more than ``bits``.  What
is linked already is not visited again, so a crowd of near copies costs few visits, and a
group gives one link for each member at most.  Groups beyond :data:`CHUNK` fingerprints are
cut into chunks that meet pair by pair, so no task holds more than two chunks.

Rules: a null text has no words; a text without words has fingerprint zero, linked like any
other.  Equal texts have equal fingerprints.  ``component_id`` is the smallest non-null
``doc_id`` that can be reached (null if there is none).  Repeated rows stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import free_name, steps, table
from drillsight.llm.components import components
from drillsight.session import stage

SHINGLE = 4
BITS = 4
#: The seed of XXH64, a fixed value.
SEED = 42
#: Fingerprints of a group that are joined in one piece.
CHUNK = 4096
#: Mean size of a group up to which coarser keys are used.
GROUP = 48
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), _AT_ONCE):
        part = np.array(hashes[first : first + _AT_ONCE], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp``: a hash of the text, and the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            found = np.array([fingerprint(x, shingle) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"]
            )

    plain = docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), "text")
    return plain.mapInArrow(run, "doc_id long, mark long, fp long")


class Trie:
    """A binary trie over sorted distinct numbers of 64 bits; chains of one child are one edge.

    Nodes are numbered: ``value`` has the bits all below it share, ``depth`` says how many of
    them (64 for a leaf), ``kids`` the two children.
    """

    def __init__(self, values: list[int]) -> None:
        self.value: list[int] = []
        self.depth: list[int] = []
        self.kids: list[tuple[int, int] | None] = []
        self.whole: list[bool] = []
        self.root = self._build(values, 0, len(values)) if values else -1

    def _build(self, values: list[int], lo: int, hi: int) -> int:
        first, last = values[lo], values[hi - 1]
        kids = None
        depth = 64 - (first ^ last).bit_length()
        if depth < 64:
            pivot = (last >> (63 - depth)) << (63 - depth)
            a, b = lo, hi
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if values[mid] < pivot else (a, mid)
            kids = (self._build(values, lo, a), self._build(values, a, hi))
        self.value.append(first)
        self.depth.append(depth)
        self.kids.append(kids)
        self.whole.append(kids is None)  # all below are known to be linked
        return len(self.value) - 1


class Join:
    """Joins tries with themselves and with each other; ``up`` holds who is linked to whom."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def within(self, trie: Trie) -> None:
        # Children have smaller numbers than their parents, so this is bottom up.
        for node, kids in enumerate(trie.kids):
            if kids:
                self.across(trie, kids[0], trie, kids[1])
                trie.whole[node] = (
                    trie.whole[kids[0]]
                    and trie.whole[kids[1]]
                    and self.top(trie.value[kids[0]]) == self.top(trie.value[kids[1]])
                )

    def across(self, s: Trie, a: int, t: Trie, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            depth_a, depth_b = s.depth[a], t.depth[b]
            x, y = s.value[a], t.value[b]
            if ((x ^ y) >> (64 - min(depth_a, depth_b))).bit_count() > self.bits:
                continue
            if s.whole[a] and t.whole[b]:
                x, y = self.top(x), self.top(y)
                if x == y:
                    continue
                if depth_a == depth_b == 64:
                    self.up[max(x, y)] = min(x, y)
                    continue
            if depth_a <= depth_b:
                left, right = s.kids[a]
                stack += ((right, b), (left, b))
            else:
                left, right = t.kids[b]
                stack += ((a, right), (a, left))

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.top(x)) for x in list(self.up) if self.top(x) != x]


def schemes(bits: int, nodes: int, group: int = GROUP) -> list[int]:
    """Masks of the key bits: as coarse as groups of about ``group`` members allow.

    With ``n`` blocks, two fingerprints within ``bits`` agree in ``n - bits`` of them, so each
    choice of so many blocks is a key.  More blocks make longer keys, and more of them.  Two
    blocks a key (15 keys of 21 bits for 4 bits) serve up to some 50 million fingerprints.
    """
    if not bits:
        return [(1 << 64) - 1]
    for blocks in range(min(bits + 2, 2 * bits), 2 * bits + 1):
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(c) for c in itertools.combinations(block, blocks - bits)]
        if nodes <= group << min(m.bit_count() for m in masks):
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: links that connect what the distinct ``fp`` of ``nodes`` within ``bits`` connect."""
    spark = nodes.sparkSession
    masks = schemes(bits, nodes.count())
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("scheme"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
        for k, m in enumerate(masks)
    ])).alias("key")).select("fp", "key.*")
    crowded = keyed.groupBy("scheme", "part").count().filter(F.col("count") > CHUNK)
    crowded = crowded.withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(crowded, ["scheme", "part"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("scheme", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[bool, list[int], list[int]]]:
            current, first, second = None, [], []
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for scheme, part, lo, hi, mine, fp in zip(*columns, strict=True):
                    if (key := (scheme, part, lo, hi)) != current:
                        if current is not None:
                            yield current[2] == current[3], first, second
                        current, first, second = key, [], []
                    (first if mine == lo else second).append(fp & (1 << 64) - 1)
            if current is not None:
                yield current[2] == current[3], first, second

        found: list[tuple[int, int]] = []
        for alone, first, second in groups():
            if len(first) + len(second) < 2:
                continue
            join, trie = Join(bits), Trie(sorted(first))
            join.within(trie)
            if not alone:  # what either side links by itself shortens the walk across
                other = Trie(sorted(second))
                join.within(other)
                if trie.root >= 0 and other.root >= 0:
                    join.across(trie, trie.root, other, other.root)
            found += join.links()
            if len(found) > 10_000:
                yield _batch(found)
                found = []
        yield _batch(found)

    def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array([(_signed(x), _signed(y)) for x, y in found], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"]
        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "scheme", "part", "lo", "hi")
        .sortWithinPartitions("scheme", "part", "lo", "hi")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id, mark, fp, component_id, root``: ``root`` is the component's smallest ``fp``,
    ``mark`` a hash of the text by which a row can be found again."""
    own = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints-distinct")
    roots = components(links(nodes, bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select(
        "doc_id", "mark", "fp", "component_id", "root"
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest ``doc_id``.

    Several texts of that id are ordered by a hash; a component without ids keeps one row.
    """
    found = near_duplicates(docs, shingle, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, mark, root = (free_name(x, docs.columns) for x in ("_id", "_mark", "_root"))
    chosen = found.groupBy(F.col("root").alias(root)).agg(F.first("doc_id").alias(key), F.min("mark").alias(mark))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (_mark() == F.col(mark))
    # Rows of one id and one text are the same document twice.
    return docs.join(chosen, same).dropDuplicates([key, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Nearest neighbours by inner product: inverted lists scanned dimension block by block.

Largest inner product becomes smallest distance by one more coordinate
(``sqrt(M^2 - |x|^2)`` with the largest norm ``M``; 0 for queries).  A random rotation then
spreads the distance evenly over the coordinates, so a part of them tells about the whole.
K-means centroids of a sample make the lists, and every vector goes to the list of its
nearest centroid.  A query probes its nearest lists.  In a list, vectors lie in column
blocks: the scan adds up partial distances block by block, and after each a hypothesis test
gives up the candidates that are too far with near certainty, given the ``k``-th best so
far.  What survives is scored exactly: the inner product of the original vectors in double
precision.

Equal vectors are one candidate with the smallest ids of the group, and equal queries search
once.  Lists are cut into blocks of vectors and chunks of queries, so a list that holds a
third of all is many tasks.

Bounds: :data:`SAMPLE` vectors, in the order of a hash of their id, are fitted on the driver;
there are :data:`MOST_LISTS` lists at most.  Every vector is indexed.  How many lists are
probed follows from the sample: the least number that finds :data:`RECALL` of its true
neighbours.

Rules: vectors that are null, empty, zero or have null or non-finite components take no part,
nor do those whose length is not the most frequent one (the smaller, if tied).  Rows of a
null id take no part; of several rows of an id the smallest vector counts.  Fewer candidates
than ``k`` give fewer rows.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillsight.llm.common import table
from drillsight.session import stage

NEAREST = 20
SAMPLE = 8_192
#: Vectors of the sample that give each query a first bound.
BOUND_SAMPLE = 1_024
#: Mean vectors of a list, least and most lists.
LIST_SIZE = 2_048
LEAST_LISTS = 16
MOST_LISTS = 4_096
RECALL = 0.97
#: Candidates beyond the nearest that the first bound of a query lets pass.
SPARE = 12
#: Vectors and queries that meet in one task step.
BLOCK = 4_096
QUERIES = 1_024
#: Dimensions that are added between two tests, and the test's strictness.
COLUMNS = 16
STRICT = 2.1
_SEED = 7


@dataclass
class Index:
    """What tasks need: rotation, the largest norm, centroids and how many are probed."""

    rotation: np.ndarray
    largest: float
    centroids: np.ndarray
    bound: np.ndarray
    bound_ids: np.ndarray
    bound_lists: np.ndarray
    probes: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Candidates with their extra coordinate, rotated."""
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))
        return np.c_[x, rest] @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        """Queries with their extra coordinate, rotated."""
        return np.c_[q, np.zeros(len(q))] @ self.rotation


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (q @ x.T), 0)


def _means(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """K-means from evenly drawn starts; an empty list keeps its place."""
    draw = np.random.default_rng(_SEED)
    centroids = x[draw.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = [_distances(x[k : k + 1024], centroids).argmin(axis=1) for k in range(0, len(x), 1024)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fit(vectors: np.ndarray, ids: np.ndarray, largest: float, total: int, nearest: int) -> Index:
    """The index for ``total`` vectors, from a sample of them."""
    width = vectors.shape[1] + 1
    draw = np.random.default_rng(_SEED)
    rotation, _ = np.linalg.qr(draw.standard_normal((width, width)))
    index = Index(rotation, largest, np.zeros((0, width)), np.zeros((0, width)), ids[:0], ids[:0], 1)
    x = index.lift(vectors)
    lists = min(max(LEAST_LISTS, total // LIST_SIZE), MOST_LISTS, len(x))
    index.centroids = _means(x, lists)
    own, trial = _nearest(x, index.centroids), vectors[: min(256, len(x))]
    index.bound, index.bound_ids, index.bound_lists = x[:BOUND_SAMPLE], ids[:BOUND_SAMPLE], own[:BOUND_SAMPLE]
    q = index.turn(trial)
    order = np.argsort(np.argsort(_distances(q, index.centroids), axis=1), axis=1)
    far = _distances(q, x)
    far[np.arange(len(q)), np.arange(len(q))] = np.inf
    wanted = np.argsort(far, axis=1)[:, : min(nearest, max(1, len(x) - 1))]
    # How many lists must be probed to reach each true neighbour.
    needed = np.sort(np.take_along_axis(order, own[wanted], axis=1).ravel() + 1)
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])
    return index


def scan(
    q: np.ndarray, limit: np.ndarray, x: np.ndarray, nearest: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated vectors that may be among the ``nearest`` of a query.

    ``limit`` holds each query's squared distance bound and is tightened on the way.
    """
    width = x.shape[1]
    rows, found = [], []
    for first in range(0, len(x), 512):
        part = x[first : first + 512]
        so_far = _distances(q[:, :COLUMNS], part[:, :COLUMNS])
        done = min(COLUMNS, width)
        a, b = np.nonzero(so_far <= _allowed(limit, done, width)[:, None])
        sums = so_far[a, b]
        while done < width and len(a):
            block = slice(done, min(done + COLUMNS, width))
            gap = q[a, block] - part[b, block]
            sums = sums + np.einsum("ij,ij->i", gap, gap)
            done = block.stop
            alive = sums <= _allowed(limit, done, width)[a]
            a, b, sums = a[alive], b[alive], sums[alive]
        rows.append(a)
        found.append(b + first)
        # The k-th best of what this part has shown bounds the rest.
        order = np.lexsort((sums, a))
        a, sums = a[order], sums[order]
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        many = begins + nearest <= np.r_[begins[1:], len(a)]
        at = begins[many] + nearest - 1
        limit[a[at]] = np.minimum(limit[a[at]], sums[at] * (1 + 1e-9) + 1e-12)
    return np.concatenate(rows), np.concatenate(found)


def _allowed(limit: np.ndarray, done: int, width: int) -> np.ndarray:
    """The partial distance over ``done`` dimensions up to which a candidate stays."""
    if done == width:
        return limit
    return limit * (done / width) * (1 + STRICT / np.sqrt(done)) ** 2


def _clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: usable vectors in double precision, one for each id."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & (F.size("v") > 0))
        .filter(finite)
        .filter(F.exists("v", lambda x: x != 0))
    )
    return usable.groupBy("id").agg(F.min("v").alias("v"))


def search(
    rows: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ids in ``queries`` (column ``key``, of ``rows``)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = stage(_clean(rows, key, vector), "vectors")
    widths = usable.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 1
    usable = usable.filter(F.size("v") == width)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, largest = usable.agg(F.count("*"), F.max(norm)).first()
    place = Window.partitionBy("v").orderBy("id")
    # One more than wanted, as a query leaves itself out.
    groups = (
        usable.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= nearest + 1)
        .groupBy("v")
        .agg(F.min("id").alias("head"), F.sort_array(F.collect_list("id")).alias("ids"))
    )
    groups = stage(groups, "vectors-distinct")
    sample = groups.orderBy(F.xxhash64("head"), "head").limit(SAMPLE).collect()
    ids = np.array([r["head"] for r in sample], np.int64)
    index = fit(np.array([r["v"] for r in sample]).reshape(-1, width), ids, largest, total, nearest) if sample else None
    held = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), width)
                own = _nearest(held.value.lift(v), held.value.centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), batch.column(1)], ["head", "list", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                v, head = _matrix(piece.column(1), width), piece.column(0).to_numpy()
                q = index.turn(v)
                near = np.argsort(_distances(q, index.centroids), axis=1, kind="stable")[:, : index.probes]
                known = _distances(q, index.bound)
                known[head[:, None] == index.bound_ids] = np.inf
                # Only what lies in a probed list will be found.
                probed = np.zeros((len(q), len(index.centroids)), bool)
                np.put_along_axis(probed, near, True, axis=1)
                known[~probed[:, index.bound_lists]] = np.inf
                # The bound leaves room for the query itself and for candidates given up by mistake.
                limit, room = np.full(len(q), np.inf), nearest + SPARE
                if known.shape[1] > room:
                    limit = np.partition(known, room, axis=1)[:, room] * (1 + 1e-9) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(limit), pa.array(list(near.astype(np.int32)))],
                    ["head", "v", "limit", "lists"],
                )

    listed = stage(groups.select("head", "v").mapInArrow(assign, "head long, list long, v array<double>"), "vectors-listed")
    asked = usable.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id")
    asked = stage(asked.join(groups.select("v", "head"), "v").select("id", "head", "v"), "queries")
    heads = asked.dropDuplicates(["head"]).select("head", "v")
    probed = stage(
        heads.mapInArrow(probe, "head long, v array<double>, limit double, lists array<int>")
        .select("head", "v", "limit", F.explode(F.col("lists").cast("array<long>")).alias("list")),
        "queries-probed",
    )
    # Each list is cut into blocks of vectors and chunks of queries; every block meets every chunk.
    blocks = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cuts = blocks.join(probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("chunks")), "list")
    data = (
        listed.join(F.broadcast(cuts), "list")
        .withColumn("block", F.pmod(F.xxhash64("head"), "blocks"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("list", "block", "chunk", F.lit(True).alias("stored"), "head", F.lit(0.0).alias("limit"), "v")
    )
    ask = (
        probed.join(F.broadcast(cuts), "list")
        .withColumn("chunk", F.pmod(F.xxhash64("head"), "chunks"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("list", "block", "chunk", F.lit(False).alias("stored"), "head", "limit", "v")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces = None, []
        for batch in batches:
            keys = np.c_[batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()]
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if current is not None and tuple(keys[a]) != current:
                    yield from _met(pieces, held.value, width, nearest)
                    pieces = []
                current = tuple(keys[a])
                pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from _met(pieces, held.value, width, nearest)

    by = ("list", "block", "chunk")
    met = (
        data.unionByName(ask)
        .repartition(parts, *by)
        .sortWithinPartitions(*by, "stored", "head")
        .mapInArrow(meet, "query long, head long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "head")
    short = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= nearest + 1)
    members = short.join(groups.select("head", "ids"), "head").select("query", "score", "ids")
    lists = members.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    pairs = (
        asked.select(F.col("id").alias("query_id"), F.col("head").alias("query"))
        .join(lists, "query")
        .select("query_id", F.explode("found").alias("one"))
        .select("query_id", F.explode("one.ids").alias("vec_id"), F.col("one.score").alias("score"))
        .filter("query_id <> vec_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, width)


def _met(pieces: list[pa.RecordBatch], index: Index, width: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """A block of vectors and a chunk of queries."""
    whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
    stored = whole.column(3).to_numpy(zero_copy_only=False)
    v, head = _matrix(whole.column(6), width), whole.column(4).to_numpy()
    if stored.all() or not stored.any():
        return
    x, q = v[stored], v[~stored]
    limit = whole.column(5).to_numpy()[~stored].copy()
    # A query's own group may take a place: one more than wanted.
    a, b = scan(index.turn(q), limit, index.lift(x), nearest + 1)
    # The same product for the same pair, whatever else is in the block.
    score = np.einsum("ij,ij->i", q[a], x[b])
    order = np.lexsort((head[stored][b], -score, a))
    a, b, score = a[order], b[order], score[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    few = place <= nearest
    yield pa.RecordBatch.from_arrays(
        [pa.array(head[~stored][a[few]]), pa.array(head[stored][b[few]]), pa.array(score[few])],
        ["query", "head", "score"],
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter("vec_id % 20 = 0"))

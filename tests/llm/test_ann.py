import numpy as np
import pytest
from llm_data import SMALL
from pyspark.sql import functions as F

from drillsight.llm import ann


def brute(ids, vectors, query, nearest):
    own = vectors[list(ids).index(query)]
    scores = [(-float(v @ own), i) for i, v in zip(ids, vectors, strict=True) if i != query]
    return [(i, -s) for s, i in sorted(scores)[:nearest]]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((12, 24))
    vectors = (centres[draw.integers(0, 12, 3000)] + 0.4 * draw.standard_normal((3000, 24))).astype(np.float32).astype(float)
    rows = table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)])
    got = by_query(ann.search(rows, rows.filter("vec_id % 100 = 0"), nearest=10))
    assert len(got) == 30
    hits = 0
    for q, found in got.items():
        want = brute(range(3000), vectors, q, 10)
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        for _, i, s in found:
            assert s == pytest.approx(vectors[q] @ vectors[i], abs=1e-12)
    assert hits / 300 >= 0.9


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = table(spark, [(k, draw.standard_normal(8).tolist()) for k in range(400)])
    queries = rows.filter("vec_id % 5 = 0")
    want = by_query(ann.search(rows, queries, nearest=5))
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert by_query(ann.search(rows, queries, nearest=5)) == want


def test_odd_vectors_copies_and_ties(spark):
    same = [1.0, 0.0]
    rows = [(k, same) for k in range(40)] + [(50, [0.5, 0.5]), (51, [-1.0, 0.0])]
    odd = [(60, None), (61, []), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, [None, 1.0]), (66, [1.0, 2.0, 3.0]), (None, same)]
    df = table(spark, rows + odd + [(50, [0.5, 0.5])])
    got = by_query(ann.search(df, df, nearest=20))
    assert sorted(got) == [*range(40), 50, 51]
    assert [i for _, i, _ in got[0]] == list(range(1, 21))
    assert [i for _, i, _ in got[39]] == list(range(20))
    assert [i for _, i, _ in got[50]] == list(range(20))


def test_few_candidates_and_empty_tables(spark):
    few = table(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])])
    assert by_query(ann.search(few, few.filter("vec_id = 0"))) == {0: [(1, 1, 2.0), (2, 2, -1.0)]}
    one = table(spark, [(0, [1.0])])
    assert ann.search(one, one).count() == 0
    assert ann.search(few.limit(0), few).count() == 0
    assert ann.search(few, few.limit(0)).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = by_query(ann.query(spark, SMALL))
    hits = total = 0
    for q, found in got.items():
        assert q % 20 == 0 and len(found) == 20
        hits += len({i for i, _ in brute(ids, vectors, q, 20)} & {i for _, i, _ in found})
        total += 20
    assert len(got) == sum(i % 20 == 0 for i in ids) and hits / total >= 0.9

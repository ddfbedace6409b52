"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixframe.llm import multiindex, queries
from helixframe.llm.common import Scratch
from helixframe.llm.multiindex import Index, nearest_vectors, ranked

SCHEMA = "vec_id long, embedding array<double>, vector long, key string, cell string"


def search(spark, rows, every=2, k=20, **options):
    table = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    with Scratch(spark) as scratch:
        found = nearest_vectors(table, F.col("id") % every == 0, scratch, k=k, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def brute(rows, every=2, k=20):
    score = lambda a, b: float((np.array(a, float) * np.array(b, float)).sum())
    return {i: sorted(((j, score(v, u)) for j, u in rows if j != i), key=lambda x: (-x[1], x[0]))[:k] for i, v in rows if i % every == 0}


def test_all_when_everything_is_in_reach(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) * (i % 3 + 1) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, rows[8][1]) for i in range(25)]
    assert search(spark, rows, recall=1.0) == brute(rows)


def test_defined_cases(spark):
    nan, inf = math.nan, math.inf
    bad = [(2, None), (4, []), (6, [0.0, 0.0]), (8, [1.0, None]), (10, [nan, 1.0]), (12, [inf, 1.0]), (14, [1.0]), (None, [1.0, 1.0])]
    good = [(16, [1.0, 0.0]), (17, [1.0, -0.0]), (18, [0.0, 1.0]), (19, [-1.0, 0.0])]
    assert search(spark, bad + good + [(19, [-0.5, 0.0])], k=2) == {16: [(17, 1.0), (18, 0.0)], 18: [(16, 0.0), (17, 0.0)]}
    assert search(spark, bad) == {} and search(spark, good[:1]) == {} and search(spark, good[1:2] + good[3:]) == {}
    ties = [(i, [1.0, float(i == 3)]) for i in range(100)]
    assert [x for x, _ in search(spark, ties, every=50, k=5)[50]] == [0, 1, 2, 3, 4]
    orthogonal = [(i, np.eye(40)[i].tolist()) for i in range(40)]
    assert search(spark, orthogonal, every=10, k=3, recall=1.0) == brute(orthogonal, 10, 3)


@pytest.mark.parametrize("units", [(4096, 8192), (16, 8)])
def test_work_dealt_out_in_units(spark, monkeypatch, units):
    monkeypatch.setattr(multiindex, "VECTORS_A_UNIT", units[0])
    monkeypatch.setattr(multiindex, "QUERIES_A_UNIT", units[1])
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=(150, 7)), 1 + 1e-3 * rnd.normal(size=(150, 7))])  # a half close together
    rows = list(enumerate(x.tolist()))
    assert search(spark, rows, k=10, recall=1.0) == brute(rows, k=10)


def test_reach_goes_by_distance():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(500, 6))
    index = Index(x, (x * x).sum(1).max(), 8)
    cells, counts = np.unique(index.cells(x), return_counts=True)
    index.counted(cells, counts)
    low, high = index.from_query(x[:1])
    far, at = index.reach(low[0], high[0], 200)
    whole = (low[0][:, None] + high[0]).ravel()
    assert sorted(at) == sorted(c for c in cells if whole[c] <= far) and index.counts[at].sum() >= 200
    assert index.counts[at[:-1]].sum() < 200 and (np.diff(whole[at]) >= 0).all()
    assert ranked(np.array([0, 0, 1, 0]), np.array([1.0, 1.0, 0.0, 2.0]), np.array([9, 3, 1, 7]), 2).tolist() == [3, 1, 2]


def test_grouped_vectors_need_few_cells(spark):
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(50, 16))
    x = middle[rnd.integers(0, 50, 3000)] + 0.05 * rnd.normal(size=(3000, 16))
    reads = []
    real = multiindex.reached_by
    multiindex.reached_by = lambda index, queries, enough: reads.append(enough) or real(index, queries, enough)
    try:
        rows = list(enumerate(x.tolist()))
        got, want = search(spark, rows, every=20), brute(rows, every=20)
    finally:
        multiindex.reached_by = real
    assert reads[0] < 600
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_recall_of_the_query(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, x = np.array(table.column("vec_id")), np.stack(table.column("embedding").to_numpy()).astype(float)
    got = {}
    for r in queries.QUERIES["op11_multi_index"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(ids[ids % 20 == 0].tolist())
    shares = []
    for q, found in got.items():
        score = (x * x[ids == q]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(s - score[ids == v][0]) < 1e-12 for _, v, s in found)
        shares.append(len({v for _, v, _ in found} & set(best.tolist())) / 20)
    assert np.mean(shares) >= 0.9

"""Permutation index (operator 12): recall, exact scores, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from lumisweep.llm import permutation as P
from lumisweep.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n string, v int, shard int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def _score(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def _brute(vectors, query_ids, k):
    out = {}
    for q in query_ids:
        found = sorted(((-_score(v, vectors[q]), i) for i, v in vectors.items() if i != q))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_footrule_from_files():
    rng = np.random.default_rng(0)
    order = np.array([rng.permutation(12)[:5] for _ in range(40)])
    lines = P.opened(*P.inverted_files(order, 12), 40, 5)
    place = np.full((40, 12), 5)
    np.put_along_axis(place, order, np.arange(5)[None, :], 1)
    for i in range(40):
        footrule = np.abs(place - place[i]).sum(1)
        assert (30 - 2 * P.shared_ranks(order[i], lines, P.rank_caps(5, lines)).astype(int) == footrule).all()


def test_near_copies_do_not_take_all_pivots():
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8) + 0.01 * rng.normal(size=(50, 8))
    x = np.concatenate([hot, rng.normal(size=(30, 8))])
    chosen = P.apart(x, 10)
    assert len(chosen) == 10 and (chosen < 50).sum() == 1
    assert len(P.apart(hot, 10)) == 10


def test_query_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    rows = QUERIES["op12_permutation_index"](spark, sf_dir).collect()
    want = _brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = {q: [] for q in want}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == _score(vectors[i], vectors[q]) for i, s in near)


def test_index_of_several_shards_and_lengths_of_vectors(spark, monkeypatch):
    """Vectors of many lengths: the added component makes long ones near."""
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=6) * (1 + i % 7)).tolist() for i in range(600)}
    monkeypatch.setattr(P, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(P, "QUERY_BYTES", 800)
    table = P.whole_vectors(_table(spark, vectors.items()), "embedding")
    index = P.build_index(table, pivots=64, prefix=32)
    assert index.count() > 1
    rows = P.search(index, table.where("vec_id % 10 = 0"), 5, share=0.2, least=10).collect()
    want = _brute(vectors, range(0, 600, 10), 5)
    assert len(rows) == 300
    hits = sum((r["vec_id"], r["score"]) in want[r["query_id"]] for r in rows)
    assert hits >= 270


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]),
            (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]),
            (None, [9.0, 9.0]), (9, [-1.0, 0.0]), (10, [2.0, 0.5])]
    table = _table(spark, rows)
    found = P.nearest(table, table.where("vec_id in (0, 2, 8)"), 3).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 10, 2.0)]
    huge = _table(spark, [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [1.0, 0.0]),
                          (4, [1e-300, 0.0])])
    found = P.nearest(huge, huge.where("vec_id = 1"), 3).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(2, inf), (3, 1e300), (4, 1.0)]


def test_empty(spark):
    table = _table(spark, [])
    assert P.nearest(table, table.where(F.col("vec_id") > 0), 3).collect() == []

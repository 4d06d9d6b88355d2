import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisweep.llm import chat, mixing, topk


def brute_top(rows, queries, k):
    out = []
    for qid, q in {i: v for i, v in reversed(queries)}.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows
                        if i != qid and len(v) == len(q))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 5000])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)] + [(5, rows[7][1])]
    odd = [(500, None), (501, []), (502, [None] + [1.0] * 5), (503, [float("nan")] + [1.0] * 5),
           (504, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (550, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd],
                                  "vec_id long, embedding array<double>, score string")
    vectors = topk.integer_vectors(table, "embedding", 256)
    found = topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in [*rows, odd[-1]]]
    asked = [(i, v) for i, v in whole if i % 50 == 0]
    assert sorted(map(tuple, found.drop("depth").collect())) == brute_top(whole, asked, 5)
    assert found.where("depth <= 0 or depth > 1").count() == 0
    none = vectors.limit(0)
    assert topk.exact_top_k(none, none, 5).count() == 0


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """Each block of candidates gets all queries: many times what a size estimate sees."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    table = spark.range(200).select(F.col("id").alias("vec_id"), F.array(
        F.col("id") % 7, F.col("id") % 11).cast("array<double>").alias("embedding"))
    vectors = topk.integer_vectors(table, "embedding", 256)
    found = topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 5)
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    assert "Broadcast" not in plan.toString() and "MapInPandas" in plan.toString()


def test_bounds_stop_before_the_end_and_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (3000, 8))
    ids = rng.permutation(3000)
    for q, scale in ((x[:7], 1), (x[:3], 1 << 20)):
        found = list(topk.top_of_block(x * scale, ids, q * scale, ids[:len(q)], 5))
        for (own, best, scores, _), row in zip(found, q):
            exact = [(int(-(v.astype(object) @ row.astype(object))) * scale * scale, int(i))
                     for v, i in zip(x, ids) if i != own]
            assert [(-int(s), int(i)) for i, s in zip(best, scores)] == sorted(exact)[:5]


def test_reading_stops_early_where_bounds_exclude_the_others():
    """Few large components decide: their lists need not be read far."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (2000, 6))
    x[:10, 0] += 10_000
    (_, best, _, depth), = topk.top_of_block(x, np.arange(2000), np.array([[9, 1, 1, 1, 1, 1]]),
                                             np.array([-1]), 5)
    assert set(best) <= set(range(10)) and depth < 1
    flat = rng.integers(-200, 200, (2000, 64))
    assert [d for *_, d in topk.top_of_block(flat, np.arange(2000), flat[:2], np.arange(2), 5)
            ] == [1.0, 1.0]


def test_huge_components_saturate(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]),
                                   (3, [2.0, 2.0]), (4, [0.0, 0.5])],
                                  "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(table, "embedding", 256)
    found = topk.exact_top_k(vectors, vectors.where("vec_id = 0"), 5).collect()
    most = 2 ** 63 - 1
    assert [(r["vec_id"], r["score"]) for r in found] == [
        (1, most), (3, most), (4, 256 * 128), (2, -most - 1)]


ROLES = ["user", "assistant", "system", "tool\nbox", "a\\nb", "<|im_start|>", ""]


def test_format_round_trip():
    rng = random.Random(0)
    parts = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|", "\\", "<", "|", "\n", "é", "ok"]
    for _ in range(300):
        turns = [(rng.choice(ROLES), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))))
                 for _ in range(rng.randint(1, 6))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert text.count(chat.START) == text.count(chat.END) == len(turns)
        assert [chat.unescape(text[a:b]) for a, b in spans] == [
            t for r, t in turns if r == "assistant"]


def brute_best(nodes):
    by_conv = defaultdict(dict)
    for conv, node, parent, *_, score in nodes:
        by_conv[conv][node] = (parent, score)
    out = {}
    for conv, tree in by_conv.items():
        parents = {p for p, _ in tree.values()}
        paths = []
        for leaf in tree:
            path, at = [], leaf
            while at in tree and at not in path:
                path.append(at)
                at = tree[at][0]
            if leaf not in parents and at not in path:
                paths.append((-sum(tree[n][1] for n in path), leaf, path[::-1]))
        out[conv] = [p for *_, p in sorted(paths)]
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_best_paths_match_brute_force(spark, branches):
    rng = random.Random(2)
    nodes = []
    for conv in range(12):
        for node in range(rng.randint(1, 25)):
            parent = rng.choice([None, *range(node)]) if node else None
            nodes.append((conv, node, parent, "user", f"{conv}/{node}", float(rng.randint(0, 4))))
    nodes += [(50, i, i - 1, "user", f"50/{i}", 1.0) for i in range(1, 70)]
    nodes += [(60, 1, 2, "user", "60/1", 1.0), (60, 2, 1, "user", "60/2", 1.0)]
    table = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, "
                                         "text string, score double")
    found = defaultdict(list)
    for r in chat.best_paths(table, branches).collect():
        found[r["conv_id"], r["branch"]].append((-r["step"], int(r["text"].split("/")[1])))
    want = {(c, i + 1): p for c, paths in brute_best(nodes).items()
            for i, p in enumerate(paths[:branches])}
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == want


def test_linear_conversations_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, 5, None, "x"),
            (None, 0, "assistant", "<|im_end|>"), (3, 0, "assistant", "long " * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_paths(chat.best_paths(chat.linear_tree(table)))
    turns = {r["conv_id"]: chat.parse(r["formatted"]) for r in done.collect()}
    assert turns == {1: [("user", ""), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")],
                     None: [("assistant", "<|im_end|>")], 3: [("assistant", "long " * 50_000)]}
    digests = {r["conv_id"]: r for r in chat.digests(done).collect()}
    assert digests[1]["loss_chars"] == 2 and digests[2]["loss_chars"] == 0
    empty = chat.linear_tree(table.limit(0))
    assert chat.digests(chat.format_paths(chat.best_paths(empty))).count() == 0


def fair_targets(sizes, weights):
    """Shares by weight with the excess over three times the size given to the others."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [3 * s if i in capped else rest * weights[i] / open_weight
               for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(out) if i not in capped and t > 3 * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mixing(spark):
    rng = random.Random(0)
    rows, number = [], 0
    for source, docs in (("é", 5), ("Z", 3), (None, 60), ("a", 90), ("b", 4), ("c", 1)):
        for _ in range(docs):
            rows.append((number, "w " * rng.randint(0, 30), source, 7))
            number += 1
    rows += [(1, "again and again", "b", 7)] * 2 + [(None, "no id", "a", 7), (900, None, "zz", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mixed = mixing.mix_sources(table)
    found = mixed.collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, fair_targets([sizes[s] for s in order],
                                           [i % 3 + 1 for i in range(len(order))])))
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(targets[s] + 1e-9) for s in order)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix_sources(table).collect()))
    copies = mixing.training_order(mixed).collect()
    assert sum(r["copy_words"] for r in copies) == sum(taken.values())
    assert all(0 <= r["position"] <= 1 for r in copies)
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies)
    assert mixing.mix_sources(table.limit(0)).count() == 0
    blank = mixing.mix_sources(table.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {r["taken"] for r in blank} == {0}


@pytest.mark.parametrize("start, end", mixing.RAMPS)
def test_position_inverts_the_schedule(spark, start, end):
    used = [i / 50 for i in range(51)]
    table = spark.createDataFrame([(u, 0) for u in used], "used double, nth int")
    found = [r[0] for r in table.select(
        mixing.time_of(F.col("used"), F.col("nth"), [(start, end)])).collect()]
    assert np.allclose([start * t + (end - start) * t * t / 2 for t in found], used)

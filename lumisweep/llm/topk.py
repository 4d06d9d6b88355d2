"""Exact top-k inner products (operator 10): sorted lists without random access.

Vectors become integers, floor(``scale`` * x).  Each component has a sorted list of the
candidates' values.  A query reads the list of component d from the top where its own
component is positive and from the bottom where it is negative, all lists in step, in
batches to the growing depths ``DEPTHS``.  From what is read every candidate has a lower bound
(unread components at the far end of their list) and an upper bound (unread components at
the value read last).  A candidate whose upper bound is below the k-th best lower bound
cannot qualify and is read no further; a query stops when no more than k candidates are left,
or at the end of the lists, where both bounds are the score.  The scores of those left are
then resolved by reading on in their rows of the lists only.  ``depth`` is the share of the
lists that was read to exclude the others, the largest of all blocks.

Candidates and queries are dealt into blocks of bounded size by a hash of the id.  A task
takes a block of candidates and then all blocks of queries, one after the other.  The lists of
a block are its own, so each task reads on its own and returns its k best per query; a last
ranking merges the blocks.  The bounds of all
queries at one depth are two matrix products over float64, exact below 2**53; where a score
can be larger, over Python's integers.

Components outside the range of a long, and scores outside it, count as the nearest end of
the range.  Vectors that are null, empty, or hold null or non-finite components take no part; a
vector of another length than a query's is no candidate for it.  All rows with the query's
own id are left out.  Repeated rows of a candidate are separate results; repeated query rows
give one result.  Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisweep.llm.common import bound_batches

FOUND = "query_id long, vec_id long, score long, depth double"
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
DEPTHS = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)
_LONG = np.iinfo(np.int64)


def top_of_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                 k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Per query id its ``k`` best ``(ids, scores)`` among ``vectors`` and the depth read."""
    most = (float(np.abs(vectors.astype(float)).max(initial=0))
            * float(np.abs(queries.astype(float)).max(initial=0)) * vectors.shape[1])
    number = np.float64 if most < 2 ** 52 else object
    x, q = vectors.astype(number), queries.astype(number)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    ordered = np.sort(x, axis=0)
    # A row per query: its candidates lie side by side.
    alive = query_ids[:, None] != ids[None, :]
    depths = np.ones(len(query_ids))
    reading = np.arange(len(query_ids))
    for depth in DEPTHS:
        last = max(0, int(np.ceil(depth * len(ids))) - 1)
        from_top, from_bottom = ordered[len(ids) - 1 - last], ordered[last]
        # Read from the top: x; unread: at most the value read last, at least the low end.
        lower = (up[reading] @ np.where(x >= from_top, x, ordered[0]).T
                 + down[reading] @ np.where(x <= from_bottom, x, ordered[-1]).T)
        upper = (up[reading] @ np.maximum(x, from_top).T
                 + down[reading] @ np.minimum(x, from_bottom).T)
        for row, j in enumerate(reading):
            left = np.flatnonzero(alive[j])
            if len(left) > k:
                floor = np.partition(lower[row, left], -k)[-k]
                alive[j, left] = upper[row, left] >= floor
        done = alive[reading].sum(axis=1) <= k
        depths[reading[done]] = depth
        reading = reading[~done]
        if not len(reading):
            break
    for j, own in enumerate(query_ids):
        left = np.flatnonzero(alive[j])
        exact = x[left] @ q[j]
        order = sorted(range(len(left)), key=lambda i: (-exact[i], ids[left[i]]))[:k]
        scores = [min(max(int(exact[i]), _LONG.min), _LONG.max) for i in order]
        yield int(own), ids[left[order]], np.array(scores, np.int64), float(depths[j])


def integer_vectors(table: DataFrame, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: rows whose vectors are whole, as integers."""
    number = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.size(vector).cast("int") > 0
    whole = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) < F.lit(float("inf"))))
    return (table.where(F.col("vec_id").isNotNull() & F.coalesce(fine & whole, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(number, lambda x: F.floor(x * scale)).alias("v")))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score, depth``: the ``k`` best of ``vectors`` for each of ``queries``.

    Both have ``vec_id`` and an integer array ``v``.
    """
    per_length = vectors.withColumn("n", F.size("v")).groupBy("n").count().collect()
    # One number of blocks for all vectors; lengths are few and each is blocked on its own.
    blocks = max(1, math.ceil(sum(r["count"] for r in per_length) / BLOCK_ROWS))
    asked = queries.dropDuplicates(["vec_id"]).withColumn("n", F.size("v"))
    query_blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))

    # Candidates travel once; a block of queries follows them to each of their blocks.  A join
    # would copy either side for the other, and its size estimate does not see an ``explode``.
    packed = F.collect_list(F.struct("vec_id", "v")).alias("vectors")
    candidates = (vectors.withColumn("n", F.size("v")).groupBy("n", block_of(blocks).alias("b"))
                  .agg(packed).select("n", "b", F.lit(-1).alias("q"), "vectors"))
    wanted = (asked.groupBy("n", block_of(query_blocks).alias("q")).agg(packed)
              .select("n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "q",
                      "vectors"))
    bound_batches(vectors.sparkSession)
    met = (candidates.unionByName(wanted).repartition(blocks, "n", "b")
           .sortWithinPartitions("n", "b", "q"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, x = None, None, None
        for frame in frames:
            for n, b, q, rows in zip(frame["n"], frame["b"], frame["q"], frame["vectors"]):
                if q < 0:
                    at, (ids, x) = (n, b), _unpack(rows)
                elif at == (n, b):         # else no candidate has this length in this block
                    query_ids, asked_for = _unpack(rows)
                    found = list(top_of_block(x, ids, asked_for, query_ids, k))
                    yield pd.DataFrame({
                        "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                        "vec_id": np.concatenate([f[1] for f in found]),
                        "score": np.concatenate([f[2] for f in found]).astype(np.int64),
                        "depth": np.repeat([f[3] for f in found], [len(f[1]) for f in found])})

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (met.mapInPandas(search, FOUND)
            .withColumn("depth", F.max("depth").over(Window.partitionBy("query_id")))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "depth"))


def _unpack(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([r["vec_id"] for r in rows], np.int64),
            np.array([r["v"] for r in rows], np.int64))

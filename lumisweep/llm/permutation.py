"""Approximate nearest neighbours (operator 12): a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order of nearness.  The
vectors are dealt into shards of bounded bytes by a hash of the id; a shard holds one
inverted file per pivot, which posts the shard's vectors that have the pivot among their
nearest ones, with its rank.  A query reads the files of its own nearest pivots.  With
``p`` pivots in a prefix and ranks from 0, the footrule distance of two prefixes, an
absent pivot having rank ``p``, is ``p * (p + 1)`` minus twice the sum of
``p - max(rank, rank)`` over the shared pivots, so reading the files adds up exactly the
distance of every vector posted in them.

Of each shard the ``share`` of least footrule distance, at least ``LEAST`` vectors, is
reranked by the inner product of the original vectors, and besides these every vector
whose distance is below ``CLOSE`` of the greatest possible one, however many these are: a
large group of near copies is reranked whole.  The best of all shards are ranked together.

Nearness is the largest inner product.  To make it one with nearness of direction, vectors
are brought to one length by one added component (zero for queries), after division by
the largest component of the table; equal lengths need no such component.  Scores are
sums of products of the original components from the first to the last, in double
precision; a sum that overflows is infinite, one that is undefined comes last as NaN.

Pivots are chosen from a bounded sample (``SPARE`` times as many distinct vectors of one
length, least hash first, out of about ``SAMPLE_ROWS`` rows): those come first that are
not near an earlier one, so that a group of near copies does not take most of them.  Every
vector is indexed.  Vectors that are
null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id; a vector of another length than a query's is no candidate for it.  All rows with the
query's own id are left out.  Repeated rows of a candidate are separate results; of
repeated query rows the least vector asks.  Ties go to the smaller id.  Columns other
than the id and the vector are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, record_batch, settle

PIVOTS, PREFIX, SHARE, LEAST, CLOSE = 256, 128, 0.08, 512, 0.25
SAMPLE_ROWS = 1 << 16
SPARE, NEAR = 8, 0.7
SHARD_BYTES = 4 << 20
QUERY_BYTES = 2 << 20

INDEX = ("n int, shard int, pivots binary, ids binary, vectors binary, starts binary, "
         "posted binary, ranks binary, scale double, longest double")
FOUND = "query_id long, vec_id long, score double"


def whole_vectors(table: DataFrame, vector: str) -> DataFrame:
    """``vec_id, v, n``: rows whose vectors are finite and not zero, in double precision."""
    number = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = (F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(number, lambda x: x != 0))
    return (table.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("v"),
                    F.size(vector).alias("n")))


def lengths(vectors: DataFrame) -> DataFrame:
    """``n, rows, scale, longest``: per vector length, for shards and the added component."""
    scaled = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("scale")) ** 2)
    sizes = vectors.groupBy("n").agg(
        F.count("*").alias("rows"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale"))
    return (vectors.join(sizes, "n").groupBy("n", "rows", "scale")
            .agg(F.sqrt(F.max(scaled)).alias("longest")))


def _level(x: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """``x`` over ``scale`` with a last component that brings it to the length ``longest``."""
    x = x / scale
    short = np.maximum(longest ** 2 - (x * x).sum(1), 0)
    # What rounding leaves of equal lengths must not look like a direction.
    return np.column_stack([x, np.sqrt(np.where(short < 1e-6 * longest ** 2, 0, short))])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` pivots nearest in direction, nearest first, ties in order."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def inverted_files(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pivot the vectors that hold it and its ranks: starts of the files, rows, ranks."""
    rows, prefix = order.shape
    by_pivot = np.argsort(order.ravel(), kind="stable")
    starts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
    return starts, by_pivot // prefix, by_pivot % prefix


def opened(starts: np.ndarray, posted: np.ndarray, ranks: np.ndarray, rows: int, prefix: int
           ) -> np.ndarray:
    """The files unpacked: per pivot a line with ``p - rank`` of its vectors, 0 for others."""
    # The sum over a whole prefix fits the type too.
    small = prefix * (prefix + 1) // 2 < 1 << 16
    lines = np.zeros((len(starts) - 1, rows), np.uint16 if small else np.uint32)
    lines[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), posted] = prefix - ranks
    return lines


def rank_caps(prefix: int, lines: np.ndarray) -> np.ndarray:
    """Per rank of a query's pivot the most that a vector can share by it, as whole lines."""
    caps = np.arange(prefix, 0, -1, dtype=lines.dtype)
    return np.repeat(caps[:, None], lines.shape[1], axis=1)


def shared_ranks(asked: np.ndarray, lines: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Sum of ``p - max(rank, rank)`` over shared pivots: large where footrule is small."""
    gain = np.zeros(lines.shape[1], lines.dtype)
    part = np.empty_like(gain)
    for pivot, cap in zip(asked, caps):
        np.minimum(lines[pivot], cap, out=part)
        np.add(gain, part, out=gain)
    return gain


def inner_products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products summed from the first component to the last, as a loop over them would."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.zeros(len(x))
        for column, component in zip(np.ascontiguousarray(x.T), query):
            total += column * component
    return total


def candidates(gain: np.ndarray, prefix: int, share: float, least: int) -> np.ndarray:
    """Rows to rerank: the best ``share``, at least ``least``, and all that are close."""
    take = max(least, int(np.ceil(share * len(gain))))
    most = prefix * (prefix + 1) // 2
    if take >= len(gain):
        return np.arange(len(gain))
    limit = np.partition(gain, len(gain) - take)[len(gain) - take]
    return np.flatnonzero(gain >= min(limit, np.ceil((1 - CLOSE) * most)))


def sample_pivots(vectors: DataFrame, sizes: DataFrame, pivots: int) -> DataFrame:
    """``n, pivots``: per length an array of at most ``pivots`` distinct vectors."""
    marked = (vectors.join(sizes.select("n", "rows"), "n")
              .withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64("h", F.lit("sample")))
              .where(F.pmod("g", F.greatest(F.lit(1), F.expr(f"rows div {SAMPLE_ROWS}"))) == 0))
    distinct = marked.groupBy("n", "h").agg(F.max("v").alias("v"))
    first = distinct.withColumn("nth", F.row_number().over(
        Window.partitionBy("n").orderBy("h"))).where(F.col("nth") <= SPARE * pivots)
    sample = first.groupBy("n").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("h", "v"))), lambda p: p["v"]).alias("pivots"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(pivots=[
                [rows[i] for i in apart(np.stack(list(rows)), pivots)]
                for rows in frame["pivots"]])

    return sample.mapInPandas(choose, "n int, pivots array<array<double>>")


def apart(x: np.ndarray, most: int) -> np.ndarray:
    """Numbers of at most ``most`` rows; rows near an earlier chosen one come last."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = np.zeros(len(x), bool)
    chosen = []
    for i in range(len(x)):
        if not near[i] and len(chosen) < most:
            chosen.append(i)
            near |= x @ x[i] >= NEAR
    rest = np.setdiff1d(np.arange(len(x)), chosen)
    return np.concatenate([chosen, rest[:most - len(chosen)]]).astype(np.int64)


def dealt(rows: DataFrame, deals: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), deals).cast("int")


def _matrix(column: pa.ListArray, at: int, n: int) -> np.ndarray:
    """The vectors of row ``at`` of a column of arrays of arrays."""
    inner = column.slice(at, 1).flatten()
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _packed_rows(column: pa.ListArray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = column.slice(at, 1).flatten()
    ids, vectors = rows.flatten()
    return (ids.to_numpy(zero_copy_only=False),
            vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, n))


def build_index(vectors: DataFrame, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """One row per shard: its ids, vectors and inverted files, and the pivots."""
    sizes = settle(lengths(vectors))
    chosen = settle(sample_pivots(vectors, sizes, pivots))
    shards = F.ceil(F.col("rows") * F.col("n") * 8 / SHARD_BYTES)
    shard = vectors.join(sizes.select("n", shards.alias("shards")), "n")
    packed = (shard.groupBy("n", dealt(shard, F.col("shards")).alias("shard"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")))
    whole = (packed.join(chosen, "n").join(sizes.select("n", "scale", "longest"), "n")
             .select("n", "shard", "rows", "pivots", "scale", "longest"))
    schema = arrow_schema(INDEX)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, shard, scale, longest = (batch.column(c)[i].as_py() for c in (0, 1, 4, 5))
                ids, x = _packed_rows(batch.column(2), i, n)
                points = _level(_matrix(batch.column(3), i, n), scale, longest)
                order = nearest_pivots(_level(x, scale, longest), points, prefix)
                starts, posted, ranks = inverted_files(order, len(points))
                yield record_batch([[v] for v in (
                    n, shard, points.tobytes(), ids.astype(np.int64).tobytes(), x.tobytes(),
                    starts.astype(np.int64).tobytes(), posted.astype(np.int32).tobytes(),
                    ranks.astype(np.int16).tobytes(), scale, longest)], schema)

    return whole.mapInArrow(post, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int, share: float = SHARE,
           least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query id.

    ``queries`` has ``vec_id, v, n``.  Blocks of queries meet all shards of their length.
    """
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("v", "n")).alias("q")).select(
        "vec_id", "q.v", "q.n")
    blocks = asked.groupBy("n").agg(
        F.ceil(F.count("*") * F.col("n") * 8 / QUERY_BYTES).cast("int").alias("blocks"))
    block = asked.join(blocks, "n")
    shards = index.groupBy("n").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    wanted = (block.groupBy("n", dealt(block, F.col("blocks")).alias("block"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")).join(shards, "n")
              .withColumn("shard", F.explode("shards")).drop("shards"))
    files = index.join(blocks, "n").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = [name.split()[0] for name in INDEX.split(", ")]
    pairs = files.join(wanted, ["n", "shard", "block"]).select(*names, "queries")
    schema = arrow_schema(FOUND)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = dict(zip(names, (batch.column(c)[i].as_py() for c in range(len(names)))))
                query_ids, q = _packed_rows(batch.column(len(names)), i, row["n"])
                found = list(look_up(row, query_ids, q, k, share, least))
                yield record_batch([np.concatenate(c) for c in zip(*found)], schema)

    order = [F.isnan("score"), F.col("score").desc(), F.col("vec_id")]
    return (pairs.mapInArrow(look, FOUND)
            .withColumn("rank", F.row_number().over(
                Window.partitionBy("query_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def look_up(row: dict, query_ids: np.ndarray, q: np.ndarray, k: int, share: float, least: int
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the ids and scores of the ``k`` best of one shard."""
    x = np.frombuffer(row["vectors"]).reshape(-1, row["n"])
    ids = np.frombuffer(row["ids"], np.int64)
    points = np.frombuffer(row["pivots"]).reshape(-1, row["n"] + 1)
    starts = np.frombuffer(row["starts"], np.int64)
    posted = np.frombuffer(row["posted"], np.int32)
    prefix = len(posted) // len(ids)
    lines = opened(starts, posted, np.frombuffer(row["ranks"], np.int16), len(ids), prefix)
    caps = rank_caps(prefix, lines)
    flat = np.column_stack([q / row["scale"], np.zeros(len(q))])
    for own, query, asked in zip(query_ids, q, nearest_pivots(flat, points, prefix)):
        gain = shared_ranks(asked, lines, caps)
        left = candidates(gain, prefix, share, least)
        left = left[ids[left] != own]
        scores = inner_products(x[left], query)
        best = np.lexsort((ids[left], -np.where(np.isnan(scores), -np.inf, scores),
                           np.isnan(scores)))[:k]
        yield np.full(len(best), own), ids[left][best], scores[best]


def nearest(table: DataFrame, queries: DataFrame, k: int, vector: str = "embedding"
            ) -> DataFrame:
    """The ``k`` nearest found in ``table`` for each row of ``queries``, by a settled index."""
    index = settle(build_index(settle(whole_vectors(table, vector))))
    return search(index, whole_vectors(queries, vector), k)

"""MinHash near-duplicates (operator 1): a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of five lower-cased words.  Its signature has
``SYMBOLS`` MinHash values cut to 16 bits.  Signatures are split into chunks of four
symbols.  Two signatures that differ in at most ``RADIUS`` symbols differ in at most one
symbol of some chunk (pigeonhole), so every chunk is indexed four times, each time with
another symbol left out: the allowed errors of a chunk are enumerated by position, and all
pairs within ``RADIUS`` share a key.  Pairs beyond it that meet all the same are tried too,
up to ``FARTHEST``, beyond which a similarity of 0.75 is out of the question.  Links are then
confirmed on the full sets.

A pair of similarity 0.75 differs in 12 symbols of 48 on average; the chance that it
shares no key is 1e-7, and smaller for closer pairs.

Documents with the same set form one class and only its smallest id is joined.  Keys held
by thousands of documents do not give all pairs: each key is compared with one hub first
(the member that shares its keys with the most documents), found links are joined into
components, and only members of different components are compared pair by pair after
that.  Links inside a component cannot change the result.  Before it, the shingles of these
members are counted: what only one of them holds is in no intersection, which rules out
most pairs of one large group of copies that differ from each other too much.  Then each is
compared with the centre of its key, the member with the fewest shingles of its own: two
members share no more than the smaller part inside the centre and the smaller part outside.

A null or empty text has an empty set and is linked with nothing.  Rows with the same
``doc_id`` are one node, linked by any of their texts.  A row with a null ``doc_id`` keeps a
null ``component_id`` and is kept.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, bound_batches, record_batch, settle
from lumisweep.llm.components import components
from lumisweep.llm.words import fold, mix, shingle_set, text_blocks

WORDS = 5
SYMBOLS, CHUNK = 48, 4
RADIUS, FARTHEST = 2 * SYMBOLS // CHUNK - 1, 30
_ODD = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_SLICE = 1 << 16

OVERLAP = "a long, b long, common long, linked boolean"
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest shingle under each of ``SYMBOLS`` multiplications."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        part = shingles[at:at + _SLICE]
        for i in range(SYMBOLS):
            low[i] = min(low[i], (part * _ODD[i]).min())
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SIGNED)
    for batch in batches:
        size, first, second, signs = [], [], [], []
        for block in text_blocks(batch.column(1), lower=True):
            for j in range(len(block.rows)):
                found = shingle_set(block.hashes[block.offsets[j]:block.offsets[j + 1]], WORDS)
                size.append(len(found))
                first.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                signs.append(signature(found).tobytes() if len(found) else None)
        yield record_batch([batch.column(0), size, first, second, signs], schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key per chunk and left-out symbol."""
    schema = arrow_schema("key long, id long")
    per = SYMBOLS // CHUNK * CHUNK
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2")
        signs = signs.reshape(-1, SYMBOLS).astype(np.uint64)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(ids), 4096):
            part = signs[at:at + 4096]
            keys = []
            for chunk in range(0, SYMBOLS, CHUNK):
                for left_out in range(CHUNK):
                    used = [part[:, chunk + i] for i in range(CHUNK) if i != left_out]
                    place = np.full(len(part), chunk * CHUNK + left_out + 1, np.uint64)
                    keys.append(mix(fold([place, *used])))
            yield record_batch([np.stack(keys, 1).ravel().view(np.int64),
                                np.repeat(ids[at:at + 4096], per)], schema)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most ``FARTHEST`` symbols."""
    schema = arrow_schema("a long, b long")
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2")
                       .reshape(-1, SYMBOLS) for i in (2, 3))
        near = pa.array((left != right).sum(1) <= FARTHEST)
        yield record_batch([batch.column(i).filter(near) for i in (0, 1)], schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("id long, shingles binary")
    for batch in batches:
        at = 0
        ids = batch.column(0).to_pylist()
        for block in text_blocks(batch.column(1), lower=True):
            found = [shingle_set(block.hashes[block.offsets[j]:block.offsets[j + 1]],
                                 WORDS).tobytes() for j in range(len(block.rows))]
            yield record_batch([ids[at:at + len(found)], found], schema)
            at += len(found)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each pair, and whether 100 * intersection >= 75 * union."""
    schema = arrow_schema(OVERLAP)
    for batch in batches:
        common, linked = [], []
        for left, right in zip(batch.column(2), batch.column(3)):
            x = np.frombuffer(left.as_buffer(), np.uint64)
            y = np.frombuffer(right.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            common.append(shared)
            linked.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        yield record_batch([batch.column(0), batch.column(1), common, linked], schema)


def _beside(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The pairs ``a, b`` with a value of either side."""
    x = values.select(F.col("id").alias("a"), F.col(column).alias("_x"))
    y = values.select(F.col("id").alias("b"), F.col(column).alias("_y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "_x", "_y")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _beside(pairs, sets, "shingles").mapInArrow(_overlap, OVERLAP)


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are links: by signature distance, then by full sets."""
    near = _beside(pairs, classes, "signature").mapInArrow(_distances, "a long, b long")
    return _overlaps(near, sets).where("linked").select("a", "b")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("id long, shingle long")
    for batch in batches:
        for owner, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.frombuffer(data.as_buffer(), np.int64)
            for at in range(0, len(found), _SLICE):
                part = found[at:at + _SLICE]
                yield record_batch([np.full(len(part), owner), part], schema)


def _bounds(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """``id, size, shared``: of a set's shingles, how many some other of these sets holds too.

    No intersection is larger than ``shared``, so a link between two of these sets needs
    7 * the smaller ``shared`` >= 3 * the sum of the sizes.
    """
    each = sets.join(ids, "id").mapInArrow(_shingles, "id long, shingle long")
    return (each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
            .where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
            .join(sets.selectExpr("id", "length(shingles) div 8 size").join(ids, "id"), "id",
                  "right")
            .selectExpr("id", "size", "size - coalesce(own, 0) shared"))


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component so far; one without links is its own."""
    return (members.join(found, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def _mixed(members: DataFrame) -> DataFrame:
    """The members of keys that hold more than one component."""
    ends = members.groupBy("key").agg(F.min("component").alias("_low"),
                                      F.max("component").alias("_high"))
    return members.join(ends.where("_low <> _high").select("key"), "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``."""
    bound_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    signed = settle(rows.mapInArrow(_sign, SIGNED))
    named = signed.where("doc_id is not null and n_shingles > 0")
    by_set = ["set_a", "set_b", "n_shingles"]
    classes = settle(named.groupBy(*by_set).agg(F.min("doc_id").alias("id"),
                                                F.min("signature").alias("signature")))
    twins = named.join(classes.drop("signature"), by_set).selectExpr("doc_id a", "id b")

    # Keys that only one class holds pair nothing; they are counted before any join.
    keys = classes.select("id", "signature").mapInArrow(_keys, "key long, id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = settle(keys.join(shared, "key"))
    weight = held.groupBy("id").agg(F.sum("n").alias("weight"))
    held = settle(held.join(weight, "id").select("key", "id", "weight"))
    sets = settle(rows.join(weight.select(F.col("id").alias("doc_id")), "doc_id")
                  .mapInArrow(_sets, "id long, shingles binary"))

    hubs = held.groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("_hub"))
    to_hub = (held.join(hubs.selectExpr("key", "-_hub.col2 hub"), "key").where("id <> hub")
              .selectExpr("least(id, hub) a", "greatest(id, hub) b").distinct())
    tried = settle(to_hub)
    links = settle(_linked(tried, classes, sets))

    # What different components share is compared: with the centre of a key, then in pairs.
    open_keys = settle(_mixed(_labelled(held.select("key", "id"), components(links))))
    bounded = open_keys.join(_bounds(open_keys.select("id").distinct(), sets), "id")
    # A member that cannot reach even the smallest set of its key has no link there.
    smallest = bounded.groupBy("key").agg(F.min("size").alias("_least"))
    able = settle(_mixed(bounded.join(smallest, "key")
                         .where("7 * shared >= 3 * (size + _least)").drop("_least")))
    # The centre holds the fewest shingles that nobody shares.
    centres = able.groupBy("key").agg(F.max(F.struct(
        (F.col("shared") / F.col("size")).alias("part"), (-F.col("id")).alias("id")))
        .alias("_c")).selectExpr("key", "-_c.id hub")
    beside = settle(able.join(centres, "key").selectExpr(
        "id", "size", "shared", "hub", "least(id, hub) a", "greatest(id, hub) b").distinct())
    to_centre = settle(_overlaps(beside.where("id <> hub").select("a", "b").distinct(), sets))
    links = settle(links.unionByName(to_centre.where("linked").select("a", "b")))
    # What two members share lies inside the centre or outside of it.  Keys with the same
    # centre are one group from here on, so a pair is met once and not for each key.
    seen = to_centre.groupBy("a", "b").agg(F.max("common").alias("common"))
    able = (beside.join(seen, ["a", "b"], "left")
            .selectExpr("hub key", "id", "size", "if(id = hub, size, common) inside",
                        "shared - if(id = hub, size, common) outside"))
    able = settle(_mixed(_labelled(able, components(links))))
    left = able.selectExpr("key", "id a", "component ca", "size na", "inside ia", "outside oa")
    right = able.selectExpr("key", "id b", "component cb", "size nb", "inside ib", "outside ob")
    rest = (left.join(right, "key").where(
        "a < b and ca <> cb and 7 * (least(ia, ib) + least(oa, ob)) >= 3 * (na + nb)")
        .select("a", "b").distinct()
        .join(tried.unionByName(to_centre.select("a", "b")), ["a", "b"], "left_anti"))
    # The bounds leave few pairs that signatures could tell apart, so the sets decide at once.
    more = _overlaps(settle(rest), sets).where("linked").select("a", "b")

    nodes = components(links.unionByName(more).unionByName(twins))
    return (signed.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))

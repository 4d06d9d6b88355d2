"""Substring dedup (operator 7): suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document; a word is removed if some window over
it also starts earlier, in a smaller ``doc_id`` or earlier in the same document.

The reference of a document is all text before it, which no task can hold.  It is dealt
into shards by anchors: the anchor of a window is its run of five words with the smallest
hash, so equal windows have equal anchors at equal places.  Neighbouring windows with the
same anchor form a range of at most 35 words.  Anchors that occur once in the corpus are
done with.  Ranges that are equal as a whole are counted together, and only the first of
them stays in the reference.  What is left are anchors with several different ranges:
each is a reference shard.  Its ranges come in the order of the corpus; each is streamed
through the automaton of the earlier ones for its matching statistics, windows whose match
is as long as a window are removed, and the range is added.  The reference grows with the
corpus, so the automata are not broadcast: each is built in the task to which its shard
is dealt, and holds at most ``SHARD_RANGES`` ranges.

An anchor with more different ranges than that, as at the edge of a passage that very many
documents share, is split further into single windows, whose first places are found by a
combined minimum.  Both ways remove the same words.

Ranges are found equal by 64-bit hashes, words in an automaton by themselves.

A null or empty text has no words.  Rows with equal ``doc_id`` and text are the same place, so
neither is earlier than the other; different texts under one ``doc_id`` share their places.  A
row with a null ``doc_id`` takes no part and keeps its text.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.automaton import SuffixAutomaton
from lumisweep.llm.common import arrow_schema, bound_batches, record_batch, settle
from lumisweep.llm.words import TextBlock, grams, prefix_sums, run_hash, text_blocks

WINDOW, ANCHOR = 20, 5
SHARD_RANGES = 2000
RANGES = "anchor long, span long, doc_id long, start int, windows int"


def window_anchors(block: TextBlock) -> tuple[np.ndarray, ...]:
    """Start, text number and anchor place of each window, and the hashes of all anchors."""
    hashes = block.hashes
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    anchors = grams(hashes, ANCHOR)
    text = np.repeat(np.arange(len(block.rows)), np.diff(block.offsets))
    starts = np.flatnonzero(text[:len(hashes) - WINDOW + 1] == text[WINDOW - 1:])
    reach = WINDOW - ANCHOR + 1
    low = np.lib.stride_tricks.sliding_window_view(anchors, reach).argmin(axis=1)
    return starts, text[starts], starts + low[starts], anchors


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(RANGES)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column(1), lower=False):
            starts, text, place, anchors = window_anchors(block)
            if len(starts) == 0:
                continue
            first = np.flatnonzero(np.concatenate((
                [True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
            windows = np.diff(np.append(first, len(starts)))
            begin, of = starts[first], text[first]
            span = run_hash(prefix_sums(block.hashes), begin, begin + windows + WINDOW - 1)
            yield record_batch([
                anchors[place[first]].view(np.int64), span.view(np.int64),
                ids[block.rows.start + of], (begin - block.offsets[of]).astype(np.int32),
                windows.astype(np.int32)], schema)


def _asked_ranges(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per text of a batch: its id, number, block, and its asked ranges with their first words.

    A text under whose id another row asked does not have the words there: by their hash.
    """
    ids, asked, at = batch.column(0).to_pylist(), batch.column(2), 0
    for block in text_blocks(batch.column(1), lower=False):
        sums = prefix_sums(block.hashes)
        for j in range(len(block.rows)):
            ranges = asked[at].as_py()
            starts = np.array([x["start"] for x in ranges]) + block.offsets[j]
            ends = starts + np.array([x["windows"] for x in ranges]) + WINDOW - 1
            spans = np.array([x["span"] for x in ranges], np.int64)
            inside = ends <= block.offsets[j + 1]
            inside[inside] = run_hash(sums, starts[inside], ends[inside]).view(
                np.int64) == spans[inside]
            yield (ids[at], block, sums, block.offsets[j], list(compress(ranges, inside)),
                   starts[inside], ends[inside])
            at += 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the asked ranges: ``anchor, doc_id, start, words``."""
    schema = arrow_schema("anchor long, doc_id long, start int, words binary")
    for batch in batches:
        for doc, block, _, _, asked, starts, ends in _asked_ranges(batch):
            yield record_batch([
                [x["anchor"] for x in asked], [doc] * len(asked), [x["start"] for x in asked],
                [block.data[block.start[i]:block.end[j - 1]].tobytes()
                 for i, j in zip(starts, ends)]], schema)


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each range that no earlier range of its shard holds, as marks to keep.

    Rows come sorted by anchor and place; a shard may run across batches.
    """
    schema = arrow_schema("doc_id long, start int, windows int")
    shard, automaton = None, SuffixAutomaton()
    for batch in batches:
        docs, starts = [], []
        for anchor, doc, start, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if anchor != shard:
                shard, automaton = anchor, SuffixAutomaton()
            words = text.split()
            found = automaton.matches(words) if automaton.texts else [0] * len(words)
            new = [start + i for i, n in enumerate(found[WINDOW - 1:]) if n < WINDOW]
            docs += [doc] * len(new)
            starts += new
            automaton.add(words)
        yield record_batch([docs, starts, [-1] * len(docs)], schema)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of each window of the asked ranges."""
    schema = arrow_schema("window long, doc_id long, start int")
    for batch in batches:
        for doc, _, sums, offset, _, starts, ends in _asked_ranges(batch):
            begin = np.concatenate([np.zeros(0, np.int64), *(
                np.arange(i, j - WINDOW + 1) for i, j in zip(starts, ends))])
            hashes = run_hash(sums, begin, begin + WINDOW)
            yield record_batch([hashes.view(np.int64), np.full(len(hashes), doc),
                                (begin - offset).astype(np.int32)], schema)


def _texts_of(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents with the ranges asked of them; a list is no longer than its document."""
    asked = ranges.groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "start", "windows", "span")).alias("asked"))
    return rows.join(asked, "doc_id").select("doc_id", "text", "asked")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``doc_id, marks``: a list of ``start, windows``, removed, or kept where negative."""
    named = rows.where("doc_id is not null and text is not null")
    ranges = named.mapInArrow(_ranges, RANGES)
    often = ranges.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    again = settle(ranges.join(often.select("anchor"), "anchor"))

    places = settle(again.groupBy("anchor", "span", "windows")
                    .agg(F.min(F.struct("doc_id", "start")).alias("_at"))
                    .select("anchor", "span", "windows", "_at.doc_id", "_at.start"))
    shards = settle(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    alone = (places.join(shards.select("anchor"), "anchor", "left_anti")
             .select("doc_id", "start", (-F.col("windows")).alias("windows")))
    small = places.join(shards.where(F.col("n") <= SHARD_RANGES).select("anchor"), "anchor")
    first = (_texts_of(named, small)
             .mapInArrow(_pieces, "anchor long, doc_id long, start int, words binary")
             .repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
             .mapInArrow(_first_windows, "doc_id long, start int, windows int"))
    large = places.join(shards.where(F.col("n") > SHARD_RANGES).select("anchor"), "anchor")
    split = (_texts_of(named, large)
             .mapInArrow(_single_windows, "window long, doc_id long, start int")
             .groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("_at"))
             .select("_at.doc_id", "_at.start", F.lit(-1).alias("windows")))
    marks = (again.select("doc_id", "start", "windows").unionByName(alone)
             .unionByName(first).unionByName(split))
    return marks.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "windows")).alias("marks"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and marks, the first two columns, become word counts and the kept text."""
    for batch in batches:
        sizes, gone, texts = [], [], []
        for text, listed in zip(batch.column(0), batch.column(1)):
            marks = listed.as_py()
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            removed = 0
            if marks and len(words) >= WINDOW:
                step = np.zeros(len(words) + 1, np.int64)
                starts = np.zeros(len(words) - WINDOW + 1, bool)
                for mark in sorted(marks, key=lambda m: m["windows"] < 0):
                    starts[mark["start"]:mark["start"] + abs(mark["windows"])] = (
                        mark["windows"] > 0)
                hit = np.flatnonzero(starts)
                step[hit] += 1
                step[hit + WINDOW] -= 1
                keep = np.cumsum(step[:-1]) == 0
                removed = len(words) - int(keep.sum())
                kept = list(compress(words, keep))
            else:
                kept = words
            sizes.append(len(words))
            gone.append(removed)
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()),
             *batch.columns[2:]], names=["n_words", "n_removed", "kept", *batch.schema.names[2:]])


def without_repeats(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``n_words, n_removed, kept, doc_id`` of each row of ``docs`` and its columns ``carry``.

    ``kept`` holds the words left, joined by one space.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"), *carry)
    marked = (all_rows.join(repeated_windows(rows), "doc_id", "left")
              .select("text", "marks", "doc_id", *carry))
    out = (marked.drop("text", "marks").select(
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.lit("").alias("kept"), "doc_id", *carry).schema)
    return marked.mapInArrow(_kept, out)

"""Benchmark decontamination (operator 2): spaced-seed hashing, in native functions.

A seed is a fixed mask over consecutive words that looks at some places and ignores the
others, so a hit survives substitutions in the ignored ones.  Seeds of all places of the
benchmark items and of the documents are hashed and joined.  Around each hit document and
item are laid side by side, and a document is contaminated if some ``WINDOW`` neighbouring
words (the whole item, if it is shorter) agree in three of four places.  The masks lose
nothing: however the places that may differ lie in such a window, one of the masks fits
between them.  Items with fewer than ``LEAST`` words are too short to be told from chance
and are left out.

A bit table of the benchmark's seeds, of ``BITS`` bits whatever the benchmark's size, drops
nearly all places of the documents before anything is shuffled; what passes by chance
finds nothing in the join.  The join itself is left to the optimizer, which splits hot
hashes.

Words are what stands between white space (space and 0x09-0x0D) in the lower-cased text.
Null and empty texts and texts of fewer than ``LEAST`` words are clean.  Rows with the same
``doc_id`` are judged together, null being one of them.  An empty benchmark leaves all
documents clean; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places looked at (1) and ignored (0): enough for windows of ``WINDOW`` words, and what
#: items of ``LEAST`` to ``WINDOW - 1`` words need besides.
MASKS = ("110001011", "1100111", "111101")
SHORT_MASKS = ("11111", "10010111")
LONGEST = max(map(len, MASKS + SHORT_MASKS))
WINDOW = 13
LEAST = 9
#: Bits of the table and bits per word of it.
BITS, PER = 1 << 22, 32


def words_of(text: Column) -> Column:
    blank = F.lit(" \t\n\x0b\x0c\r")
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), blank), r"[\x09-\x0D\x20]+")


def seeds(window: str, masks: Sequence[str]) -> Column:
    """Hash of each mask over the word hashes of ``window``; null where it does not fit.

    As an array for ``explode``: a filter on what that gives is not pushed below it, so each
    hash is computed once.
    """
    out = []
    for number, mask in enumerate(masks):
        looked = [F.get(window, F.lit(i)) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(F.size(window) >= len(mask), F.xxhash64(F.lit(number), *looked)))
    return F.array(*out)


def seeded(table: DataFrame, key: str, masks: Sequence[str]) -> DataFrame:
    """``key, at, seed`` of every place (from 0) of texts with ``LEAST`` words or more.

    Only the few word hashes that a seed can look at travel with a place, not the text.
    """
    codes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    coded = table.select(key, codes.alias("codes")).where(F.size("codes") >= LEAST)
    windows = F.transform(F.sequence(F.lit(1), F.size("codes") - (min(map(len, masks)) - 1)),
                          lambda at: F.slice("codes", at, F.lit(LONGEST)))
    return (coded.select(key, F.posexplode(windows).alias("at", "window"))
            .select(key, "at", F.explode(seeds("window", masks)).alias("seed")))


def bit_place(seed: Column, turn: int) -> tuple[Column, Column]:
    """Word of the table and bit in it; two turns look at different parts of the hash."""
    bits = F.shiftrightunsigned(seed, 22 * turn).bitwiseAND(F.lit(BITS - 1))
    return F.shiftright(bits, 5).cast("int"), bits.bitwiseAND(F.lit(PER - 1)).cast("int")


def bit_table(marks: DataFrame) -> DataFrame:
    """One row with the table as an array of ``BITS / PER`` numbers."""
    both = marks.select(F.explode(F.array(*[
        F.struct(word.alias("word"), bit.alias("bit"))
        for word, bit in (bit_place(F.col("seed"), turn) for turn in (0, 1))])).alias("x"))
    filled = both.groupBy("x.word").agg(
        F.bit_or(F.expr("shiftleft(1L, x.bit)")).alias("bits"))
    blank = marks.sparkSession.range(BITS // PER).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = filled.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                 lambda x: x["bits"]).alias("bits"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, agreeing, out_of``: the best window of each hit that is an overlap."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    short = items.where(F.size(words_of(F.col("text"))).between(LEAST, WINDOW - 1))
    masks = MASKS if short.isEmpty() else MASKS + SHORT_MASKS
    marks = (seeded(items, "item_id", masks).where("seed is not null")
             .withColumnRenamed("at", "item_at"))
    table = bit_table(marks.select("seed")).scalar()

    def listed() -> Column:
        found = F.col("seed").isNotNull()
        for turn in (0, 1):
            word, bit = bit_place(F.col("seed"), turn)
            found = found & (F.getbit(F.get(table, word), bit) == 1)
        return found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = seeded(rows, "doc_id", masks).where(listed())
    # A document and an item laid side by side: once per shift, at the first and last hit.
    shifts = (hits.join(marks, "seed")
              .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
              .agg(F.min("at").alias("first"), F.max("at").alias("last")))
    found = shifts.withColumnRenamed("doc_id", "_id")
    ours = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    theirs = items.withColumnRenamed("text", "item_text")
    both = ours.join(theirs, "item_id").select(
        "doc_id", "item_id", "shift", words_of(F.col("text")).alias("x"),
        words_of(F.col("item_text")).alias("y"), "first", "last")
    # Places of the document that a window over one of the hits can reach.
    begin = F.greatest(F.lit(0), F.col("shift"), F.col("first") - (WINDOW - 1))
    end = F.least(F.size("x"), F.size("y") + F.col("shift"),
                  F.col("last") + LONGEST + (WINDOW - 1))
    laid = both.select(
        "doc_id", "item_id", F.least(F.size("y"), F.lit(WINDOW)).alias("out_of"),
        F.slice("x", begin + 1, F.greatest(F.lit(0), end - begin)).alias("x"),
        F.slice("y", begin - F.col("shift") + 1, F.greatest(F.lit(0), end - begin)).alias("y"))
    same = F.zip_with("x", "y", lambda x, y: (x == y).cast("int"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("out_of") + 1),
        lambda k: F.aggregate(F.slice("same", k, F.col("out_of")), F.lit(0),
                              lambda total, x: total + x)))
    return (laid.select("doc_id", "item_id", "out_of", same.alias("same"))
            .where(F.size("same") >= F.col("out_of"))
            .select("doc_id", "item_id", "out_of", best.alias("agreeing"))
            .where(F.col("agreeing") * 4 >= F.col("out_of") * 3))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, first_item`` of each row of ``docs``."""
    found = (overlaps(docs, benchmark).select("doc_id", "item_id").distinct()
             .groupBy("doc_id").agg(F.count("*").alias("n_items"),
                                    F.min("item_id").alias("first_item"))
             .withColumnRenamed("doc_id", "_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item"))

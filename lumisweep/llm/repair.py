"""Conversation structure repair (operator 11): cheapest edits by Four-Russians tables.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Rows are
kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4); a user or an
assistant with empty text can be inserted anywhere (I, 3).  Blank rows and repeats of an
earlier role and text must be deleted; a row that breaks off adds 3 unless it is deleted.
Of all cheapest edits those are taken whose letters, in order, are least in ASCII.

The pass runs from the last row to the first over *costs to go*: for each of the four
states of the pattern the cost of the cheapest edits of the rows behind.  Such a vector,
less its minimum, is one of a few; for each of them and each block of ``BLOCK`` row symbols
a table holds the vector before the block and the cost to add, so a block is one lookup.
Tracing goes the other way: each block is expanded again, from the vector behind it, into
the vectors between its rows, and the first letter in ASCII order that keeps the cost is
taken.  As costs to go are exact this is safe for ties.

Long conversations are cut into chunks of ``CHUNK`` rows.  A chunk is passed for every
possible vector behind it and traced for each state before it; only these summaries, some
numbers per chunk, are put in order per conversation.  Rows get their place by
``dense_positions`` and know repeats by a minimum per (conversation, role, text).

Rows are read by turn, nulls first, then by role and text; a null role or text counts as
one space, so a null text is blank and a null role is neither s, u nor a.  Roles are told
by their first letter as it stands.  A null ``conv_id`` is a conversation of its own.
Repeated rows are duplicates.  Other columns are not read.  An empty table gives an empty
result, a conversation without rows none of its own (``digests`` adds the ids it is told).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, record_batch, settle
from lumisweep.operators.keyed import dense_positions, join_on

KEEP, INSERT, REROLE, TRUNCATED, DELETE = 0, 3, 3, 3, 4
BLOCK = 4
CHUNK = 4096
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"

# States: nothing written yet, after a system row, after a user, after an assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_GOAL = (0, 2 * INSERT, INSERT, 0)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_TAIL = ("", "ua", "a", "")
_KEPT = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER),
         "a": (None, None, _ASSISTANT, None), "o": (None,) * 4}
#: Row symbols: padding, a row to delete, the role's letter, in capitals if it breaks off.
SYMBOLS = " -suaoSUAO"
#: Script letters to edits: u and a are inserts, U and A new roles.
SCRIPT, EDITS = "uaUAKD", "IIRRKD"


def _ways(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """``letter, cost, next state`` of the edits that use up the row."""
    yield "D", DELETE, state
    if symbol != "-":
        extra = TRUNCATED if symbol.isupper() else 0
        kept = _KEPT[symbol.lower()][state]
        if kept is not None:
            yield "K", KEEP + extra, kept
        yield "R", REROLE + extra, _NEXT[state]


def _before(symbol: str, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row from those behind it."""
    if symbol == " ":
        return behind
    used = [min(cost + behind[to] for _, cost, to in _ways(symbol, s)) for s in range(4)]
    user = min(used[_USER], INSERT + used[_ASSISTANT])
    return (min(used[_START], INSERT + user), min(used[_SYSTEM], INSERT + user), user,
            min(used[_ASSISTANT], INSERT + used[_USER]))


class Tables:
    """The vectors that occur, and what a symbol and a block do to each of them."""

    def __init__(self) -> None:
        self.vectors = [_GOAL]
        number = {_GOAL: 0}
        steps: list[list[int]] = []
        costs: list[list[int]] = []
        for vector in self.vectors:  # grows while it is read
            row, cost = [], []
            for symbol in SYMBOLS:
                found = _before(symbol, vector)
                least = min(found)
                normal = tuple(x - least for x in found)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(number[normal])
                cost.append(least)
            steps.append(row)
            costs.append(cost)
        self.step, self.cost = np.array(steps), np.array(costs)
        self.block_step, self.block_cost = self.step, self.cost
        for _ in range(BLOCK - 1):  # one more symbol in front of the block
            step, cost = self.block_step, self.block_cost
            self.block_step = self.step[step].transpose(0, 2, 1).reshape(len(step), -1)
            self.block_cost = (cost[:, None, :] + self.cost[step].transpose(0, 2, 1)).reshape(
                len(step), -1)

    def blocks(self, symbols: str) -> np.ndarray:
        """Numbers of the blocks of a chunk, padded at its end."""
        at = _DIGITS[np.frombuffer(symbols.encode(), np.uint8)]
        at = np.concatenate([at, np.zeros(-len(at) % BLOCK, np.int64)])
        return at.reshape(-1, BLOCK) @ (len(SYMBOLS) ** np.arange(BLOCK)[::-1])

    def summary(self, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the chunk: the vector before it and the cost added."""
        vector = np.arange(len(self.vectors))
        cost = np.zeros(len(vector), np.int64)
        for block in self.blocks(symbols)[::-1]:
            cost += self.block_cost[vector, block]
            vector = self.block_step[vector, block]
        return vector, cost

    def trace(self, symbols: str, behind: int, state: int) -> tuple[str, int]:
        """Script of a chunk entered in ``state`` with vector ``behind`` after it."""
        blocks = self.blocks(symbols)
        ends = []
        for block in blocks[::-1]:
            ends.append(behind)
            behind = int(self.block_step[behind, block])
        script = []
        for block, end in zip(blocks, ends[::-1]):
            part, state = _expand(int(block), end, state)
            script.append(part)
        return "".join(script), state


_DIGITS = np.full(256, -1)
_DIGITS[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=1 << 16)
def _expand(block: int, behind: int, state: int) -> tuple[str, int]:
    """Script of one block and the state after it."""
    known = tables()
    digits = [block // len(SYMBOLS) ** i % len(SYMBOLS) for i in range(BLOCK)][::-1]
    vectors = [behind]
    for digit in digits[::-1]:
        vectors.append(int(known.step[vectors[-1], digit]))
    script = ""
    for digit, here, after in zip(digits, vectors[:0:-1], vectors[-2::-1]):
        symbol, added = SYMBOLS[digit], int(known.cost[after, digit])
        to_go, behind_row = known.vectors[here], known.vectors[after]
        while symbol != " ":
            ways = {letter: to for letter, cost, to in _ways(symbol, state)
                    if cost + behind_row[to] == to_go[state] + added}
            if "D" not in ways and INSERT + to_go[_NEXT[state]] == to_go[state]:
                state = _NEXT[state]
                script += "a" if state == _ASSISTANT else "u"
                continue
            letter = min(ways)
            state = ways[letter]
            script += {"R": "A" if state == _ASSISTANT else "U"}.get(letter, letter)
            break
    return script, state


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a checksum of the row picks."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    row = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(turn.cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(row) % 20
    return (conversations.select(conv.alias("conv_id"), turn.alias("turn"),
                                 role.alias("role"), text.alias("text"), kind.alias("kind"))
            .select("conv_id", "turn",
                    F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "")
                    .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
                    .alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies"))))
            .where(F.col("copy") > 0).drop("copies", "copy"))


def _letter(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def place(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, pos, fault, letter, symbol`` of each row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
                  for c in ("role", "text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"),
                        F.col("turn").cast("long").alias("turn"), role, text)
    placed = settle(dense_positions(plain, ["conv_id"], "turn", ["role", "text"])
                    .withColumn("blank", ~F.col("text").rlike(NOT_SPACE)))
    first = (placed.where(~F.col("blank"))
             .groupBy("conv_id", "role", F.sha2("text", 256).alias("hash"))
             .agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("first")))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "-")
              .when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter")))
    return (join_on(placed, first, ["conv_id", "pos"], "left")
            .select("conv_id", "turn", "role", "text", "pos", fault.alias("fault"),
                    _letter(F.col("role")).alias("letter"))
            .withColumn("symbol", symbol))


def _in_order(column: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("pos", column)))
    return F.array_join(F.transform(rows, lambda r: r[column]), "").alias(f"{column}s")


def chunked(placed: DataFrame) -> DataFrame:
    """``conv_id, chunk, symbols, letters`` and the counts of faults of each chunk."""
    faults = [F.count_if(F.col("fault") == f).alias(f)
              for f in ("blank", "duplicate", "truncated")]
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    return placed.groupBy("conv_id", chunk).agg(_in_order("symbol"), _in_order("letter"), *faults)


def summaries(chunks: DataFrame) -> DataFrame:
    """``conv_id, chunk, illegal, ends, vectors, costs`` of each chunk."""
    ddl = "conv_id long, chunk long, illegal long, ends string, vectors binary, costs binary"
    schema = arrow_schema(ddl)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            out = []
            for conv, chunk, symbols, letters in zip(*(c.to_pylist() for c in batch.columns)):
                vector, cost = known.summary(symbols)
                out.append((conv, chunk, illegal_pairs(letters), letters[0] + letters[-1],
                            vector.astype(np.int32).tobytes(), cost.tobytes()))
            if out:
                yield record_batch(list(zip(*out)), schema)

    return chunks.select("conv_id", "chunk", "symbols", "letters").mapInArrow(sum_up, ddl)


def illegal_pairs(letters: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))


def behind_chunks(summed: DataFrame) -> DataFrame:
    """``conv_id, chunk, behind, cost, illegal``: the vector behind each chunk.

    ``cost`` and the illegal pairs at the seams are in the row of the first chunk.
    """
    ddl = "conv_id long, chunk long, behind int, cost long, illegal long"
    schema = arrow_schema(ddl)
    lists = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("chunk", "illegal", "ends", "vectors", "costs"))).alias("chunks"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            out = []
            for conv, chunks in zip(*(c.to_pylist() for c in batch.columns)):
                behind, total, rows = 0, 0, []
                for c in chunks[::-1]:
                    rows.append([conv, c["chunk"], behind, 0, c["illegal"]])
                    total += int(np.frombuffer(c["costs"], np.int64)[behind])
                    behind = int(np.frombuffer(c["vectors"], np.int32)[behind])
                rows[-1][3] = total + known.vectors[behind][_START]
                rows[-1][4] += sum(illegal_pairs(a["ends"][1] + b["ends"][0])
                                   for a, b in zip(chunks, chunks[1:]))
                out += rows
            if out:
                yield record_batch(list(zip(*out)), schema)

    return lists.mapInArrow(compose, ddl)


def traced(chunks: DataFrame, behind: DataFrame) -> DataFrame:
    """``conv_id, chunk, exits, scripts``: per state before the chunk the state after it."""
    ddl = "conv_id long, chunk long, exits string, s0 string, s1 string, s2 string, s3 string"
    schema = arrow_schema(ddl)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            out = []
            for conv, chunk, symbols, after in zip(*(c.to_pylist() for c in batch.columns)):
                found = [known.trace(symbols, after, state) for state in range(4)]
                out.append((conv, chunk, "".join(str(s) for _, s in found),
                            *(script for script, _ in found)))
            if out:
                yield record_batch(list(zip(*out)), schema)

    pairs = join_on(chunks.select("conv_id", "chunk", "symbols"),
                    behind.select("conv_id", "chunk", "behind"), ["conv_id", "chunk"])
    return pairs.mapInArrow(trace, ddl)


def scripts(tracks: DataFrame) -> DataFrame:
    """``conv_id, chunk, script`` by the states that the chunks are really entered in."""
    ddl = "conv_id long, chunk long, enter int, tail string"
    schema = arrow_schema(ddl)
    lists = tracks.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("chunk", "exits"))).alias("chunks"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chunks in zip(*(c.to_pylist() for c in batch.columns)):
                state = _START
                for c in chunks:
                    out.append([conv, c["chunk"], state, ""])
                    state = int(c["exits"][state])
                out[-1][3] = _TAIL[state]
            if out:
                yield record_batch(list(zip(*out)), schema)

    script = F.concat(F.element_at(F.array("s0", "s1", "s2", "s3"), F.col("enter") + 1), "tail")
    return (join_on(tracks, lists.mapInArrow(compose, ddl), ["conv_id", "chunk"])
            .select("conv_id", "chunk", script.alias("script")))


def repaired(placed: DataFrame, script: DataFrame) -> DataFrame:
    """``conv_id, pos, nth, edit, role, text``: all rows with their edits, in order.

    Inserted rows stand at the position of the row before which they are written, those
    at the end at the last one; a deleted row has neither role nor text.
    """
    one_row = F.regexp_extract_all("script", F.lit("[ua]*[KDUA](?:[ua]*$)?"), F.lit(0))
    steps = (script.select("conv_id", "chunk", F.posexplode(one_row).alias("i", "step"))
             .select("conv_id", (F.col("chunk") * CHUNK + F.col("i")).alias("pos"), "step"))
    letters = F.filter(F.split("step", ""), lambda c: c != "")
    edit = F.col("letter")
    own = edit.isin("K", "U", "A")
    role = (F.when(edit.isin("u", "U"), "user").when(edit.isin("a", "A"), "assistant")
            .when(edit == "K", F.col("role")))
    text = F.when(own, F.col("text")).when(edit.isin("u", "a"), "")
    return (join_on(placed.select("conv_id", "pos", "role", "text"), steps, ["conv_id", "pos"])
            .select("conv_id", "pos", "role", "text", F.posexplode(letters).alias("nth", "letter"))
            .select("conv_id", "pos", "nth", F.translate("letter", SCRIPT, EDITS).alias("edit"),
                    role.alias("role"), text.alias("text")))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows (see ``repaired``) and counts and cost per conversation."""
    placed = settle(place(rows))
    chunks = settle(chunked(placed))
    behind = settle(behind_chunks(summaries(chunks)))
    tracks = settle(traced(chunks, behind))
    counts = chunks.groupBy("conv_id").agg(
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    costs = behind.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"),
                                          F.sum("cost").alias("cost"))
    turns = placed.groupBy("conv_id").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = join_on(join_on(counts, costs, ["conv_id"]), turns, ["conv_id"])
    return repaired(placed, scripts(tracks)), report


def digests(rows: DataFrame, report: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row per id of ``all_ids``: report, edits in order and hash of the repaired lines.

    The rows of a conversation are read in order by one task, as its hash demands, one
    Arrow batch at a time.
    """
    ddl = "conv_id long, audit string, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def read_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, edits, digest, lines = None, False, [], hashlib.sha256(), 0
        for batch in batches:
            done = []
            for one, edit, line in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and one != conv:
                    done.append((conv, "".join(edits), digest.hexdigest()))
                    edits, digest, lines = [], hashlib.sha256(), 0
                conv, begun = one, True
                edits.append(edit)
                if line is not None:
                    digest.update((("\n" if lines else "") + line).encode())
                    lines += 1
            if done:
                yield record_batch(list(zip(*done)), schema)
        if begun:
            yield record_batch([[conv], ["".join(edits)], [digest.hexdigest()]], schema)

    line = F.concat("role", F.lit(":"), "text").alias("line")
    read = (rows.select("conv_id", "pos", "nth", "edit", line).repartition("conv_id")
            .sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "edit", "line")
            .mapInArrow(read_on, ddl))
    ids = all_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = join_on(join_on(ids, report, ["conv_id"], "left"), read, ["conv_id"], "left")
    number = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in number],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
                        .alias("repaired_sha256"))


def reachable() -> int:
    """How many normalised vectors occur; the block tables have one row for each."""
    return len(tables().vectors)


def plain_cost(symbols: str) -> int:
    """Cost by single steps without tables, for comparison."""
    vector = _GOAL
    for symbol in symbols[::-1]:
        vector = _before(symbol, vector)
    return vector[_START]


"""Chat formatting (operator 8): the best paths of reply trees as training conversations.

Messages form trees by ``parent_id``.  Self-joins that double their stride enumerate, for
every leaf, the score and length of its path to the root; leaves are ranked in their
conversation; and for the chosen leaves the same strides list the messages of the path,
doubling the rows each time.  Only ids and scores take part, texts join at the end, and no
more than one path is ever gathered into one row.

The template writes a turn as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.
Inside roles and texts, a ``<`` followed by any backslashes and ``|`` gets one more backslash,
so no control string is left and the change can be undone; in roles, newline and backslash
are written as ``\\n`` and ``\\\\`` first.

Null texts are empty; a null role is empty.  Rows of the same turn are ordered by role and
text.  A null conversation id is a conversation of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, record_batch, settle

START, END = "<|im_start|>", "<|im_end|>"
_GUARD = re.compile(r"<(\\*)\|")
_GUARDED = re.compile(r"<\\(\\*)\|")
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
           "loss_sha256 string, formatted_chars long")


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[:-len(END) - 1])))
    return turns


def linear_tree(rows: DataFrame) -> DataFrame:
    """Nodes of conversations whose every row answers the row before it.

    ``rows`` has ``conv_id, turn, role, text``; a conversation ends up in one row anyway,
    so numbering its rows in one task adds no bound.
    """
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("node_id", F.row_number().over(in_turn).cast("long"))
            .select("conv_id", "node_id",
                    F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
                    "role", "text", F.length("text").cast("double").alias("score")))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each conversation, one row per message.

    ``nodes`` has ``conv_id, node_id, parent_id, role, text, score``; ids are unique within
    a conversation.  A path's score is the sum of its scores; ties go to the smaller leaf.
    A parent that is not there makes a root; messages on a cycle have no root and no path.
    Returns ``conv_id``, ``branch`` (from 1), ``step`` (distance to the leaf), ``role``, ``text``.
    """
    texts = settle(nodes.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"),
                                                        F.lit(""))))
    parents = texts.select("_conv", F.col("node_id").alias("parent_id")).distinct()
    # far: the ancestor 2**k steps up (null beyond the root); total: score of the steps passed.
    stride = (texts.join(parents.withColumn("_there", F.lit(True)), ["_conv", "parent_id"], "left")
              .select("_conv", "node_id", F.when(F.col("_there"), F.col("parent_id")).alias("far"),
                      F.coalesce("score", F.lit(0.0)).alias("total")))
    state, strides, most = settle(stride), [], texts.count()
    # A chain is no longer than the number of messages; what still climbs then is a cycle.
    while ((1 << len(strides)) < 2 * most
           and state.where(F.col("far").isNotNull()).limit(1).count()):
        climbing = state.where(F.col("far").isNotNull())
        strides.append(climbing)
        up = state.select("_conv", F.col("node_id").alias("far"), F.col("far").alias("_far"),
                          F.col("total").alias("_total"))
        climbed = climbing.join(up, ["_conv", "far"]).select(
            "_conv", "node_id", F.col("_far").alias("far"),
            (F.col("total") + F.col("_total")).alias("total"))
        state = settle(climbed.unionByName(state.where(F.col("far").isNull())))
    inner = texts.where(F.col("parent_id").isNotNull()).select(
        "_conv", F.col("parent_id").alias("node_id")).distinct()
    leaves = (state.where(F.col("far").isNull())
              .join(inner, ["_conv", "node_id"], "left_anti"))
    ranked = Window.partitionBy("_conv").orderBy(F.col("total").desc(), "node_id")
    chosen = (leaves.withColumn("branch", F.row_number().over(ranked))
              .where(F.col("branch") <= branches)
              .select("_conv", "branch", "node_id", F.lit(0).cast("long").alias("step")))
    path = settle(chosen)
    for k, near in enumerate(strides):
        higher = (path.join(near.select("_conv", "node_id", "far"), ["_conv", "node_id"])
                  .select("_conv", "branch", F.col("far").alias("node_id"),
                          (F.col("step") + (1 << k)).alias("step")))
        path = settle(path.unionByName(higher))
    return path.join(texts, ["_conv", "node_id"]).select(
        "conv_id", "branch", "step", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: ``conv_id, branch, formatted`` and ``loss_spans`` in characters.

    ``loss_spans`` holds start and end of each assistant text, one after the other.
    """
    turns = F.sort_array(F.collect_list(F.struct(
        (-F.col("step")).alias("at"), "role", "text")))
    gathered = paths.groupBy("conv_id", "branch").agg(turns.alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("branch", pa.int32()),
                        ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns])
                    for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([f for f, _ in done], pa.string()),
                pa.array([[x for span in s for x in span] for _, s in done],
                         schema.field("loss_spans").type)], schema=schema)

    return gathered.select(F.col("conv_id").cast("long"), F.col("branch").cast("int"), "turns") \
        .mapInArrow(write, "conv_id long, branch int, formatted string, loss_spans array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as hashes and lengths."""
    schema = arrow_schema(DIGESTS)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2]))
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                            len(loss), sha(loss), len(text)))
            yield record_batch(list(zip(*out)) if out else [[]] * len(schema), schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read_back, DIGESTS)

"""Token counts (operator 9): exact lengths under a public tokenizer, no ids kept.

Texts are cut at safe boundaries, units are encoded once per batch of bounded bytes, and
a document's count is the sum over its units.  A boundary is safe where a single space
stands between two characters that are no space: the unit after it starts with the
word-begin mark that the encoder puts before any text, and no piece of the vocabulary
holds that mark behind another character, so no merge can cross the boundary.  The
vocabulary is checked for this; one that has such pieces is used on whole texts.

Nulls and empty texts have 0 bytes and 0 tokens; rows with a null ``doc_id`` and repeated
rows keep their own row.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumisweep.llm.common import arrow_schema, record_batch

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
BATCH_BYTES = 1 << 20
REMEMBERED = 300_000
LONG_UNIT = 48
# Letters, digits and ASCII signs on both sides, so that no normalisation reaches across.
_SAFE = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A sentencepiece model with a bounded memory of unit lengths."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.divisible = not any(mark in p.lstrip(mark) for p in pieces)
        self.known: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        return _SAFE.split(text) if self.divisible else [text]

    def lengths(self, units: list[str]) -> list[int]:
        """Tokens of each unit, encoded in batches of about ``BATCH_BYTES`` characters."""
        out, batch, size = [], [], 0
        for unit in units:
            batch.append(unit)
            size += len(unit)
            if size >= BATCH_BYTES:
                out += map(len, self.model.encode(batch, num_threads=1))
                batch, size = [], 0
        return out + [len(x) for x in self.model.encode(batch, num_threads=1)] if batch else out

    def count(self, texts: list[str]) -> list[int]:
        split = [self.units(t) for t in texts]
        known = self.known
        new = list({u for units in split for u in units if u not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({u for units in split for u in units})
        known.update(zip(new, self.lengths(new)))
        counts = [sum(map(known.__getitem__, units)) for units in split]
        for unit in new:
            if len(unit) > LONG_UNIT:
                del known[unit]
        return counts


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def balanced(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about ``BATCH_BYTES``; a longer text is alone in its run."""
    run, size = [], 0
    for text in texts:
        text = text or ""
        if run and size + len(text) > BATCH_BYTES:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``."""
    schema = arrow_schema(SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [n for run in balanced(texts) for n in encode.count(run)]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield record_batch([batch.column(0), size, tokens, [n > limit for n in tokens]],
                               schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text") \
        .mapInArrow(count, SCHEMA)

"""Cross-tokenizer alignment (operator 13): exact-text deduplication.

A text is read by two tokenizers: a byte-level one (A) on a space and the text, and a
piece one (B), which adds the space itself, on the text.  Each token covers some bytes of
space and text.  Where tokens of A and of B both end, the tokens are cut into groups; a
token of A and one of B are linked where their bytes overlap.

Rows are shuffled by their full text, with copies combined before, and each distinct text
is tokenised and aligned once.  A pair of ids counts the documents that hold it linked, so
the pairs of a text count as often as the text has copies.  Every row of the table is a
document.  Measures come back to the rows by a hash of the text (SHA-256).

Hot keys: the ``FREQUENT`` most frequent pairs and the texts that are more than one row in
``HOT_SHARE`` (fewer than that number of texts) are broadcast, tables of bounded size.
Any other pair or text is too rare to fill a task, and meets its rows in a shuffle.

Texts are read in units between single spaces, at which neither tokenizer joins anything,
and units are remembered; a unit whose bytes do not come back makes the text be read whole.
New units are read many at once, as one text with spaces between them.
Texts that are null or empty, or whose token bytes are not space and text, have no tokens:
zeros and an empty ``groups_sha256``.  Rows without ``doc_id`` and repeated rows keep their
own row.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import settle

FREQUENT = 1 << 16
HOT_SHARE = 1024
REMEMBERED = 250_000
RUN_CHARS = 1 << 18
LONG_UNIT = 48
JOINED = 128
ALIGNED = ("text_key string, copies long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, a array<int>, b array<int>, n array<int>")
# A single space between letters, digits or ASCII signs.
_SAFE = re.compile(r" (?<=[\w!-~] )(?=[\w!-~])")
_SPACE = "▁"
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def _lengths(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens) + 1, np.int64)
    for i, token in tokens.items():
        out[i] = len(token)
    return out


class Aligner:
    """Two tokenizers, and a bounded memory of aligned units."""

    def __init__(self, path_a: str, path_b: str):
        # Spark already runs one task per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token)
            else token.encode() for token, i in self.a.get_vocab().items()}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                        else p.replace(_SPACE, " ").encode() for i, p in pieces}
        self.length_a, self.length_b = _lengths(self.bytes_a), _lengths(self.bytes_b)
        # Names with what follows them; a line ends where the tokens of a unit end.
        self.names_a, self.names_b = (
            np.array([[f"{i}{end}" for i in range(len(known))] for end in ends], object)
            for known, ends in ((self.length_a, ",|"), (self.length_b, ",;\n")))
        self.divisible = not any(_SPACE in p.lstrip(_SPACE) for _, p in pieces)
        self.forget()

    def forget(self) -> None:
        """Units by number: groups as text; numbers of tokens and groups; pair codes of the
        links of unit i at ``codes[first[i]:first[i + 1]]``."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 3), np.int64)
        self.codes = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        return _SAFE.split(text) if self.divisible else [text]

    def read(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Tokens of A and of B of each text; None where their bytes are not space and text."""
        spaced = [" " + t for t in texts]
        in_a = self.a.encode_batch_fast(spaced, add_special_tokens=False)
        in_b = self.b.encode(texts, num_threads=1)
        known_a, known_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        pairs = [(e.ids, b) for e, b in zip(in_a, in_b)]
        return [(a, b) if b"".join(map(known_a, a)) == b"".join(map(known_b, b)) == t.encode()
                else None for t, (a, b) in zip(spaced, pairs)]

    def parts(self, units: list[str]) -> Iterator[list[str]]:
        """Units that a text is cut into, with one space between them; others one by one."""
        for i in range(0, len(units), JOINED):
            part = units[i:i + JOINED]
            if self.units(" ".join(part)) == part:
                yield part
            else:
                yield from ([unit] for unit in part)

    def learn(self, units: list[str]) -> None:
        """Align new units and remember them; -1 for those that do not come back."""
        parts = list(self.parts(units))
        read = self.read([" ".join(part) for part in parts])
        # One unit that does not come back hides those joined to it.
        hidden = [u for part, r in zip(parts, read) if not r and len(part) > 1 for u in part]
        if hidden:
            parts += [[unit] for unit in hidden]
            read += self.read(hidden)
        self.known.update(dict.fromkeys(units, -1))
        back = [unit for part, r in zip(parts, read) if r for unit in part]
        if back:
            self.known.update(zip(back, range(len(self.groups), len(self.groups) + len(back))))
            groups, sizes, codes, ends = self.align([r for r in read if r], back)
            self.groups += groups
            self.sizes = np.concatenate([self.sizes, sizes])
            self.first = np.concatenate([self.first, len(self.codes) + ends])
            self.codes = np.concatenate([self.codes, codes])

    def align(self, read: list[tuple[list[int], list[int]]], units: list[str]
              ) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Groups as text, numbers of tokens and groups, pair codes of all links and their ends.

        Units are laid end to end: every end of a unit is one where both tokens end.
        """
        a, b = (np.concatenate([np.array(r[i], np.int64) for r in read]) for i in range(2))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        stops = np.cumsum([len(unit.encode()) + 1 for unit in units])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = both[1:] == both[:-1]
        # Between two neighbouring ends lie bytes of one token of A and one of B: a link.
        ends, cuts = both[np.append(True, ~again)], both[1:][again]
        codes = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a] = mark_b[last_b] = 1
        # The tokens of A of a group stand before those of B.
        names = np.empty(len(a) + len(b), object)
        group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        mark_b[np.searchsorted(ends_b, stops)] = 2
        names[place_a], names[place_b] = self.names_a[mark_a, a], self.names_b[mark_b, b]
        groups = "".join(names.tolist()).split("\n")[:-1]
        sizes = np.column_stack([np.diff(np.searchsorted(x, stops, "right"), prepend=0)
                                 for x in (ends_a, ends_b, cuts)])
        return groups, sizes, codes, np.searchsorted(ends, stops, "right")

    def texts(self, texts: Iterable[str]) -> Iterator[tuple | None]:
        """``n_a, n_b, n_groups, n_links, hash, pair codes, links of each`` or None per text."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                yield from self.run(run)
                run, size = [], 0
        yield from self.run(run)

    def run(self, texts: list[str]) -> Iterator[tuple | None]:
        split = [self.units(text) for text in texts]
        distinct = dict.fromkeys(chain.from_iterable(split))
        new = [u for u in distinct if u not in self.known]
        if len(self.groups) + len(new) > REMEMBERED or len(self.codes) > 16 * REMEMBERED:
            self.forget()
            new = list(distinct)
        if new:
            self.learn(new)
        numbers = {u: self.known[u] for u in distinct}
        for text, units in zip(texts, split):
            at = list(map(numbers.__getitem__, units))
            if -1 not in at:
                kinds, times = np.unique(at, return_counts=True)
                first, counts = self.first[kinds], self.first[kinds + 1] - self.first[kinds]
                # The codes of all kinds, one range after another.
                ends = np.cumsum(counts)
                places = np.arange(ends[-1]) + np.repeat(first - (ends - counts), counts)
                yield self.measures(map(self.groups.__getitem__, at), times @ self.sizes[kinds],
                                    self.codes[places], np.repeat(times, counts))
            else:
                yield self.whole(text) if len(units) > 1 else None
        for unit in new:
            if len(unit) > LONG_UNIT:
                # Long units would fill the memory and hardly ever come again.
                del self.known[unit]

    def whole(self, text: str) -> tuple | None:
        """Measures of a text read in one piece."""
        read = self.read([text])
        if read == [None]:
            return None
        groups, sizes, codes, _ = self.align(read, [text])
        return self.measures(groups, sizes[0], codes, np.ones(len(codes), np.int64))

    @staticmethod
    def measures(groups: Iterable[str], sizes: np.ndarray, codes: np.ndarray, times: np.ndarray
                 ) -> tuple:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        order = np.argsort(codes)
        codes = codes[order]
        new = np.flatnonzero(np.diff(codes, prepend=-1))
        return (*sizes.tolist(), int(times.sum()), digest, codes[new],
                np.add.reduceat(times[order], new))


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct texts with tokens: copies, measures, and pairs ``a, b`` with ``n`` links each."""
    distinct = docs.groupBy("text").agg(F.count("*").alias("copies"))
    lists = pa.list_(pa.int32())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for batch in batches:
            keys, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = (t.as_py() for t in batch.column(2))
            rows = [(k, c, f) for k, c, f in zip(keys, copies, work.texts(texts)) if f]
            if not rows:
                continue
            starts = pa.array(np.cumsum([0, *(len(f[5]) for *_, f in rows)]), pa.int32())
            codes = np.concatenate([f[5] for *_, f in rows])
            each = np.concatenate([f[6] for *_, f in rows])
            arrays = [pa.array([k for k, *_ in rows]), pa.array([c for _, c, _ in rows]),
                      *(pa.array([f[i] for *_, f in rows]) for i in range(5)),
                      *(pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32)), type=lists)
                        for x in (codes >> 32, codes & 0xFFFFFFFF, each))]
            names = [x.split()[0] for x in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return (distinct.select(F.sha2("text", 256).alias("text_key"), "copies", "text")
            .mapInArrow(align, ALIGNED))


def pair_counts(texts: DataFrame) -> DataFrame:
    """``a, b, docs, best``: documents that hold a pair, and if no pair of ``a`` has more."""
    pairs = (texts.select("copies", F.inline(F.arrays_zip("a", "b")))
             .groupBy("a", "b").agg(F.sum("copies").alias("docs")))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most"))
                                        .alias("best"))


def link_sums(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``text_key, n_best, count_sum`` of each text, from the corpus-wide counts."""
    frequent = pairs.orderBy(F.col("docs").desc(), "a", "b").limit(FREQUENT)
    rare = pairs.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti")
    links = (texts.select("text_key", F.inline(F.arrays_zip("a", "b", "n")))
             .join(F.broadcast(frequent), ["a", "b"], "left"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("docs")).alias("count_sum")]
    common = links.where(F.col("docs").isNotNull()).groupBy("text_key").agg(*sums)
    others = (links.where(F.col("docs").isNull()).drop("docs", "best").join(rare, ["a", "b"])
              .groupBy("text_key").agg(*sums))
    return common.unionByName(others).groupBy("text_key").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id``, ``MEASURES`` and ``groups_sha256`` of each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    filled = rows.where(F.col("text") != "")
    texts = settle(aligned_texts(filled, path_a, path_b))
    pairs = settle(pair_counts(texts))
    measures = settle(texts.drop("a", "b", "n").join(link_sums(texts, pairs), "text_key"))

    rows_in_all = filled.count()
    hot = F.col("copies") * HOT_SHARE > rows_in_all
    known = F.struct(*MEASURES, "groups_sha256").alias("known")
    keyed = filled.select("doc_id", F.sha2("text", 256).alias("text_key")).join(
        F.broadcast(measures.where(hot).select("text_key", known)), "text_key", "left")
    of_hot = keyed.where(F.col("known").isNotNull()).drop("text_key")
    of_rare = (keyed.where(F.col("known").isNull()).drop("known")
               .join(measures.where(~hot).select("text_key", known), "text_key", "left")
               .drop("text_key"))
    empty = rows.where(F.coalesce(F.col("text") == "", F.lit(True))).select(
        "doc_id", F.lit(None).cast(of_hot.schema["known"].dataType).alias("known"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"known.{name}"), F.lit(0)).cast("long").alias(name)

    return of_hot.unionByName(of_rare).unionByName(empty).select(
        "doc_id", *map(number, MEASURES),
        F.coalesce("known.groups_sha256", F.lit("")).alias("groups_sha256"))

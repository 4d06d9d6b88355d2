"""Language ID (operator 5): unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, lower-cased, and single bytes so that
every text can be segmented.  Each language has its own piece probabilities.  A word's
probability is the sum over all its segmentations, found by the forward algorithm, and a
text's is the product over its words.  Words are lower-cased runs of letters; long ones are
read in steps with rescaled sums.  Only training cuts words, between letters, into units of
at most ``UNIT`` bytes.  The score is the posterior of the predicted language under equal
priors.

Training takes whole texts, about ``SAMPLE_CHARS`` characters a language, chosen by a hash
of the text so that the sample stays bounded at every size, and runs ``ROUNDS`` rounds of
expectation-maximisation.  Tasks return expected counts, one row per language and piece.

A null text and a text without letters is ``und`` with score 0.  Rows with a null ``lang`` or
``text`` teach nothing.  Ties go to the smaller language name.  Repeated rows count each.
Without any training rows every text is ``und``.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import arrow_schema, bound_batches, record_batch, settle

UNIT = 32
SAMPLE_CHARS = 1_000_000
ROUNDS = 3
#: Added to every count, so that no piece of the vocabulary is impossible.
SMOOTHING = 0.05
BLOCK_CHARS = 1 << 20
WORDS_AT_ONCE = 20_000
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIES: dict[str, Pieces] = {}


class Pieces:
    """A byte trie of the vocabulary, and the piece at each node."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).replace("▁", "").lower()
                 for i in range(model.get_piece_size())}
        names = sorted(n.encode() for n in names if _LETTERS.fullmatch(n))
        names += [bytes([b]) for b in range(256) if bytes([b]) not in set(names)]
        used = sorted({b for n in names for b in n})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for number, name in enumerate(names):
            at = 0
            for b in self.kind[list(name)]:
                at = children[at].setdefault(int(b), len(children))
                if at == len(children):
                    children.append({})
                    piece.append(-1)
            piece[at] = number
        # Most nodes have one child: only those with more have a row over all bytes.
        forks = [at for at, row in enumerate(children) if len(row) > 1]
        self.fork = np.full(len(children), -1, np.int32)
        self.fork[forks] = np.arange(len(forks))
        self.rows = np.zeros((len(forks), len(used)), np.int32)
        for row, at in enumerate(forks):
            self.rows[row, list(children[at])] = list(children[at].values())
        self.only_kind = np.full(len(children), -1, np.int32)
        self.only_child = np.zeros(len(children), np.int32)
        for at, row in enumerate(children):
            if len(row) == 1:
                ((self.only_kind[at], self.only_child[at]),) = row.items()
        self.piece, self.count = np.array(piece, np.int32), len(names)
        self.longest = max(map(len, names))

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The child of each node by each byte kind, 0 where there is none."""
        to = np.where(self.only_kind[node] == kind, self.only_child[node], 0)
        fork = self.fork[node]
        forked = np.flatnonzero(fork >= 0)
        to[forked] = self.rows[fork[forked], kind[forked]]
        return to

    def edges(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """For each start and length: which words have a piece there, and which piece.

        ``words`` has a word per row (byte kinds), in order of falling ``sizes``.
        """
        for start in range(words.shape[1]):
            alive = np.arange(np.searchsorted(-sizes, -start, "left"))
            node = np.zeros(len(alive), np.int32)
            for end in range(start + 1, min(words.shape[1], start + self.longest) + 1):
                inside = sizes[alive] >= end
                alive, node = alive[inside], node[inside]
                node = self.step(node, words[alive, end - 1])
                alive, node = alive[node > 0], node[node > 0]
                if not len(alive):
                    break
                hit = self.piece[node] >= 0
                if hit.any():
                    yield start, end, alive[hit], self.piece[node[hit]]

    def forward(self, words: np.ndarray, sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Sum over the segmentations of every prefix: word x length x language."""
        total = np.zeros((words.shape[1] + 1, len(sizes), chance.shape[1]))
        total[0] = 1
        for start, end, rows, piece in self.edges(words, sizes):
            total[end, rows] += total[start, rows] * chance[piece]
        return total

    def long_logs(self, words: list[bytes], chance: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all segmentations of long words: word x language.

        The words are read in steps of ``UNIT`` bytes.  The sums at the last places of a
        step, as far back as a piece reaches, begin the next one, over their maximum.
        """
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order])
        back = self.longest - 1
        out = np.zeros((len(words), chance.shape[1]))
        scale = np.zeros_like(out)
        carry = np.zeros((back + 1, *out.shape))
        carry[back] = 1
        for at in range(0, int(sizes.max(initial=0)), UNIT):
            live = int(np.searchsorted(-sizes, -at, "left"))
            grid = np.zeros((live, back + UNIT), np.int32)
            for row in range(live):
                data = words[order[row]][max(0, at - back):at + UNIT]
                skip = max(0, back - at)
                grid[row, skip:skip + len(data)] = self.kind[np.frombuffer(data, np.uint8)]
            here = np.minimum(sizes[:live] - at, UNIT) + back
            total = np.zeros((back + UNIT + 1, live, chance.shape[1]))
            total[:back + 1] = carry[:, :live]
            for start, end, rows, piece in self.edges(grid, here):
                if end > back:
                    total[end, rows] += total[start, rows] * chance[piece]
            out[:live] = np.log(total[here, np.arange(live)]) + scale[:live]
            carry = total[UNIT:]
            most = carry.max(axis=0)
            most[most == 0] = 1  # of words that ended before
            carry = carry / most
            scale[:live] += np.log(most)
        found = np.zeros_like(out)
        found[order] = out
        return found

    def expected(self, words: np.ndarray, sizes: np.ndarray, chance: np.ndarray,
                 weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by word weight: piece x language."""
        total = self.forward(words, sizes, chance)
        back = np.zeros_like(total)
        back[sizes, np.arange(len(sizes))] = 1
        edges = list(self.edges(words, sizes))
        counts = np.zeros_like(chance)
        whole = total[sizes, np.arange(len(sizes))]
        for start, end, rows, piece in reversed(edges):
            back[start, rows] += back[end, rows] * chance[piece]
        for start, end, rows, piece in edges:
            part = (total[start, rows] * chance[piece] * back[end, rows] / whole[rows]
                    * weight[rows])
            for j in range(part.shape[1]):
                counts[:, j] += np.bincount(piece, part[:, j], self.count)
        return counts

    def arrange(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte kinds of the words, longest first; their sizes; and their order."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((len(words), int(sizes.max(initial=0))), np.int32)
        for row, i in enumerate(order):
            grid[row, :sizes[i]] = self.kind[np.frombuffer(words[i], np.uint8)]
        return grid, sizes[order], order


def pieces_of(path: str) -> Pieces:
    """One trie per Python worker and vocabulary file."""
    if path not in _TRIES:
        _TRIES[path] = Pieces(path)
    return _TRIES[path]


def letter_words(text: str) -> list[str]:
    """Runs of letters; signs such as fractions and raised digits, words for ``re``, are none."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for word in words for w in
            "".join(c if c.isalpha() else " " for c in word).split()]


def units(word: str) -> list[bytes]:
    """The bytes of a word in units of at most ``UNIT``, cut between letters."""
    data, out = word.encode(), []
    while data:
        end = UNIT
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[:end])
        data = data[end:]
    return out


class Scorer:
    """Log-probabilities of words in each language, with a bounded memory of words."""

    remembered = 200_000

    def __init__(self, pieces: Pieces, chance: np.ndarray):
        self.pieces, self.chance = pieces, chance
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, chance.shape[1]))

    def of_words(self, words: list[str]) -> np.ndarray:
        data = [w.encode() for w in words]
        out = np.zeros((len(words), self.chance.shape[1]))
        short = [i for i, w in enumerate(data) if len(w) <= UNIT]
        for at in range(0, len(short), WORDS_AT_ONCE):
            some = short[at:at + WORDS_AT_ONCE]
            grid, sizes, order = self.pieces.arrange([data[i] for i in some])
            total = self.pieces.forward(grid, sizes, self.chance)
            out[[some[i] for i in order]] = np.log(total[sizes, np.arange(len(sizes))])
        long = [i for i, w in enumerate(data) if len(w) > UNIT]
        for at in range(0, len(long), WORDS_AT_ONCE // 10):
            some = long[at:at + WORDS_AT_ONCE // 10]
            out[some] = self.pieces.long_logs([data[i] for i in some], self.chance)
        return out

    def of_texts(self, texts: list[list[str]]) -> np.ndarray:
        """Log-probability of each text, given as its words, in each language."""
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.place))
        if len(self.place) + len(new) > self.remembered:
            self.place, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(w for t in texts for w in t))
        if new:
            self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate((self.scores, self.of_words(new)))
        size = np.array([len(t) for t in texts])
        at = np.fromiter((self.place[w] for t in texts for w in t), np.int64, int(size.sum()))
        sums = np.concatenate((np.zeros((1, self.chance.shape[1])),
                               np.cumsum(self.scores[at], axis=0)))
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(rows: DataFrame, vocabulary: str, sample_chars: int = SAMPLE_CHARS,
          rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (piece x language) from ``text, lang`` of ``rows``.

    The driver holds one number per piece and language; tasks hold one count each.
    """
    usable = rows.where("lang is not null and text is not null")
    volume = {r["lang"]: r["chars"] for r in usable.groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars")).collect()}
    languages = sorted(volume)
    if not languages:
        return [], np.zeros((0, 0))
    share = F.create_map(*[x for name in languages for x in (
        F.lit(name), F.lit(min(1.0, sample_chars / max(1, volume[name]))))])
    chosen = usable.where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("lang string, word string, n long")
        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column(0).to_pylist(),
                                  "word": [letter_words(t) for t in batch.column(1).to_pylist()]})
            counts = frame.explode("word").dropna().value_counts()
            yield record_batch([counts.index.get_level_values(0).tolist(),
                                counts.index.get_level_values(1).tolist(),
                                counts.to_list()], schema)

    counted = settle(chosen.select("lang", "text")
                     .mapInArrow(words, "lang string, word string, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    place = {name: i for i, name in enumerate(languages)}
    size = pieces_of(vocabulary).count
    chance = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        current = chance

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = arrow_schema("lang int, piece int, n double")
            pieces = pieces_of(vocabulary)
            counts = np.zeros((pieces.count, len(languages)))
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()])
                parts = [(i, u) for i, w in enumerate(batch.column(1).to_pylist())
                         for u in units(w)]
                weights = batch.column(2).to_numpy(zero_copy_only=False)
                for at in range(0, len(parts), WORDS_AT_ONCE):
                    some = parts[at:at + WORDS_AT_ONCE]
                    grid, sizes, order = pieces.arrange([u for _, u in some])
                    row = np.array([some[i][0] for i in order])
                    weight = np.zeros((len(row), len(languages)))
                    weight[np.arange(len(row)), lang[row]] = weights[row]
                    counts += pieces.expected(grid, sizes, current, weight)
            piece, lang = np.nonzero(counts)
            yield record_batch([lang.astype(np.int32), piece.astype(np.int32),
                                counts[piece, lang]], schema)

        found = counted.select("lang", "word", "n").mapInArrow(
            expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toPandas()
        counts = np.full((size, len(languages)), SMOOTHING)
        np.add.at(counts, (found["piece"].to_numpy(), found["lang"].to_numpy()),
                  found["n"].to_numpy())
        chance = counts / counts.sum(axis=0)
    return languages, chance


def predict(docs: DataFrame, languages: list[str], chance: np.ndarray, vocabulary: str,
            carry: Sequence[str] = (), folds: int = 4, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs`` and its columns ``carry``."""
    bound_batches(docs.sparkSession)
    # A text that goes along is sent to the worker once.
    along = "text" in carry and dict(docs.dtypes)["text"] == "string"
    own = [] if along else [F.col("text").cast("string").alias("_text")]
    at = 2 + (list(carry).index("text") if along else len(carry))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id").cast("long"), folds, fold).alias("held_out"),
                       *carry, *own)
    out = (rows.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
           .select("doc_id", "held_out", "lang_pred", "score", *carry).schema)
    # At most one number per piece of the fixed vocabulary and language.
    model = docs.sparkSession.sparkContext.broadcast(chance)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces_of(vocabulary), model.value) if languages else None
        for batch in batches:
            texts = batch.column(at)
            names: list[str] = []
            sure: list[float] = []
            run: list[list[str]] = []
            size = 0
            for i, value in enumerate(texts):
                text = value.as_py() or ""
                run.append(letter_words(text) if languages else [])
                size += len(text)
                if size >= BLOCK_CHARS or i == len(texts) - 1:
                    logs = scorer.of_texts(run) if languages else np.zeros((len(run), 1))
                    best = logs.argmax(axis=1)
                    share = np.exp(logs - logs.max(axis=1, keepdims=True))
                    for words, b, p in zip(run, best, 1 / share.sum(axis=1)):
                        names.append(languages[b] if words else "und")
                        sure.append(float(p) if words else 0.0)
                    run, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()),
                 pa.array(sure, pa.float64()),
                 *(batch.column(2 + i) for i in range(len(carry)))],
                names=["doc_id", "held_out", "lang_pred", "score", *carry])

    return rows.mapInArrow(score, out)


def identify(docs: DataFrame, vocabulary: str, carry: Sequence[str] = ()) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict every document."""
    teach = docs.where(~held_out(F.col("doc_id").cast("long"), 4, 2)).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, chance = train(teach, vocabulary)
    return predict(docs, languages, chance, vocabulary, carry)

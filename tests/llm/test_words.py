import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumisweep.llm import words
from lumisweep.llm.automaton import SuffixAutomaton

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = "aAbé漢 \t\n\r\x0b\x0c\u00a0."
    return [None, "", " ", "x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
                                   for _ in range(n)]


@pytest.mark.parametrize("limit, piece", [(1 << 20, 1 << 20), (50, 16)])
def test_words_and_hashes(monkeypatch, limit, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    rows, seen, at = texts(300), {}, 0
    for block in words.text_blocks(pa.array(rows), lower=True, limit=limit):
        for j in range(len(block.rows)):
            text = re.sub("[A-Z]", lambda m: m[0].lower(), rows[at] or "")
            own = slice(block.offsets[j], block.offsets[j + 1])
            assert [bytes(block.data[a:b]).decode() for a, b in zip(
                block.start[own], block.end[own])] == SPLIT.findall(text)
            for word, h in zip(SPLIT.findall(text), block.hashes[own]):
                assert seen.setdefault(word, h) == h
            at += 1
    assert at == len(rows) and len(set(map(int, seen.values()))) == len(seen)


def test_shingle_set_sizes():
    block = next(words.text_blocks(pa.array(["a b c", "a b c d e f a b c d e", ""]), lower=True))
    sets = [words.shingle_set(block.hashes[a:b], 5)
            for a, b in zip(block.offsets, block.offsets[1:])]
    assert [len(s) for s in sets] == [1, 6, 0]


def test_run_hash_is_the_same_everywhere():
    values = words.mix(np.arange(50, dtype=np.uint64))
    values[30:40] = values[5:15]
    sums = words.prefix_sums(values)
    found = words.run_hash(sums, np.array([5, 30, 6]), np.array([15, 40, 16]))
    assert found[0] == found[1] != found[2]


def test_automaton_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        added = [[rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(3)]
        asked = [rng.choice("abc") for _ in range(12)]
        automaton = SuffixAutomaton()
        for one in added:
            automaton.add(one)
        inside = {tuple(t[i:j]) for t in added for i in range(len(t)) for j in range(i, len(t) + 1)}
        assert automaton.matches(asked) == [
            max((n for n in range(i + 2) if tuple(asked[i + 1 - n:i + 1]) in inside), default=0)
            for i in range(len(asked))]

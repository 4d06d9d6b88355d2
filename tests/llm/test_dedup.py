import random
import re

import pytest
from pyspark.sql import functions as F

from lumisweep.llm import neardup, substring

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_rows():
    """Random texts with groups of copies, some of them with substitutions up to the limit."""
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(3, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "ONE", "one two", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = ({tuple(w)} if 0 < len(w) < 5 else
                   {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_match_brute_force(documents):
    rows = near_rows()
    found = neardup.near_duplicates(documents(rows)).collect()
    assert {tuple(r) for r in found} == brute_components(rows)
    assert len(found) == len(rows)


def test_near_duplicates_odd_rows(documents):
    twice = " ".join(f"w{i}" for i in range(30))
    rows = [(5, twice), (5, twice), (7, twice), (None, twice), (9, None)]
    found = neardup.near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(5, 26, 5, True)] * 2 + [(7, 26, 5, False), (None, 26, None, True), (9, 0, 9, True)],
        key=repr)
    assert neardup.near_duplicates(documents([])).count() == 0


def test_signature_index_holds_all_pairs_within_radius():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(len(b), neardup.RADIUS, replace=False)] ^= 1
        batch = pa.record_batch([[1, 2], [a.tobytes(), b.tobytes()]], names=["id", "signature"])
        keys = {}
        for out in neardup._keys(iter([batch])):
            for key, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                keys.setdefault(key, set()).add(i)
        assert {1, 2} in keys.values()


def passages():
    """Documents that share passages of many lengths, some within themselves."""
    rng = random.Random(5)
    shared = [prose(rng, n, 10 ** 6) for n in (19, 20, 21, 26, 40, 90)]
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 40), 10 ** 6)
        for _ in range(rng.randint(0, 3)):
            one = rng.choice(shared)
            at = rng.randint(0, len(text))
            text[at:at] = one[rng.choice((0, 0, 3)):]
        rows.append((i, rng.choice((" ", "\n", "  ")).join(text)))
    rows += [(100, "a " * 70), (101, None), (102, ""), (103, "\t one \n")]
    rng.shuffle(rows)
    return rows


def brute_kept(rows):
    seen, out = {}, []
    for i, text in sorted(rows):
        w = SPLIT.findall(text or "")
        gone = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s:s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup_matches_brute_force(documents, monkeypatch, most):
    monkeypatch.setattr(substring, "SHARD_RANGES", most)
    rows = passages()
    found = substring.without_repeats(documents(rows), carry=["size"])
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect())
                  ) == brute_kept(rows)
    assert found.where(F.col("size") != "extra").count() == 0


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup_other_texts_under_one_id(documents, monkeypatch, most):
    """A null or another text beside the one that holds an asked range."""
    monkeypatch.setattr(substring, "SHARD_RANGES", most)
    rng = random.Random(3)
    shared = prose(rng, 30, 10 ** 6)
    rows = [(i, " ".join(prose(rng, 5 + i, 10 ** 6) + shared + prose(rng, 6, 10 ** 6)))
            for i in range(5)]
    twins = [(i, None) for i in range(5)] + [(1, "short one"), (2, " ".join(prose(rng, 60, 10 ** 6)))]
    found = substring.without_repeats(documents(rows + twins)).collect()
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in found}
    assert len(found) == len(rows) + len(twins)
    for i, text in rows:
        assert got[i, len(text.split())] == (30 if i else 0)
    assert got[1, 2] == got[0, 0] == 0


def test_substring_dedup_odd_rows(documents):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    found = substring.without_repeats(documents(rows)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, 0), (1, 0), (2, 25), (None, 0)], key=repr)
    assert substring.without_repeats(documents([])).count() == 0

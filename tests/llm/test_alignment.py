"""Cross-tokenizer alignment (operator 13) against a plain reading of each whole text."""

import hashlib
from collections import Counter

import pytest

from lumisweep.llm import alignment
from lumisweep.llm.queries import QUERIES


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def _spans(tokens):
    end, out = 0, []
    for token in tokens:
        out.append((end, end + len(token)))
        end += len(token)
    return out


class Plain:
    """Whole texts, one token after another."""

    def __init__(self, path_a, path_b):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # The byte-level letters, from the rule that shifts those bytes which are not printed.
        self.bytes, shift = {}, 0
        for byte in range(256):
            if 33 <= byte <= 126 or (161 <= byte <= 255 and byte != 173):
                self.bytes[chr(byte)] = byte
            else:
                self.bytes[chr(256 + shift)] = byte
                shift += 1

    def read(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        in_a = [bytes(self.bytes[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(in_a) != whole or b"".join(in_b) != whole:
            return None
        spans_a, spans_b = _spans(in_a), _spans(in_b)
        links, first = [], 0
        for i, (x, y) in enumerate(spans_a):
            while spans_b[first][1] <= x:
                first += 1
            j = first
            while j < len(b) and spans_b[j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = [(",".join(str(t) for t, (_, e) in zip(a, spans_a) if lo < e <= hi) + "|"
                   + ",".join(str(t) for t, (_, e) in zip(b, spans_b) if lo < e <= hi))
                  for lo, hi in zip([0, *ends], ends)] if len(a) < 3000 else None
        return len(a), len(b), ends, links, groups


def _expected(plain, rows):
    read = [plain.read(text) for _, text in rows]
    counts = Counter(pair for r in read if r for pair in set(r[3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc_id, _), r in zip(rows, read):
        if r is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, ends, links, groups = r
        digest = groups and hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, len(ends), len(links),
                    sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), digest))
    return out


def _check(found, want):
    order = ("doc_id", *alignment.MEASURES, "groups_sha256")
    got = sorted((tuple(r[c] for c in order) for r in found), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_query_matches_plain_reading(spark, sf_dir, paths):
    rows = [(r["doc_id"], r["text"])
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _check(QUERIES["op13_tokenizer_alignment"](spark, sf_dir).collect(),
           _expected(Plain(*paths), rows))


ODD = ["", None, " ", "a", "a b", "a  b", " lead", "trail ", "tab\tbed", "line\nbreak", "\r\n",
       "<|endoftext|> and <s> or </s> <unk>", "<0x41> A", "▁ mark", "x▁y z", "é è ê",
       "漢字 かな 語", "🙂 emoji 👩‍👩‍👧 more", "can't won't I'll 'tis", "½ ² ① Ⅷ", "  hard space",
       "á combining", "1234567 89 3.14", "http://a.b/c?d=e f", "z" * 5000, "w " * 3000 + "end",
       "null\x00byte x", "﻿bom text", "ｆｕｌｌ ｗｉｄｔｈ", "ﬁ ligature", "soft­hyphen here"]


def test_odd_texts(spark, documents, paths, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "a b")]
    want = _expected(Plain(*paths), rows)
    _check(alignment.align(documents(rows), *paths).collect(), want)
    # Few pairs and texts are broadcast: the rest takes the other way.
    monkeypatch.setattr(alignment, "FREQUENT", 3)
    monkeypatch.setattr(alignment, "HOT_SHARE", 1)
    _check(alignment.align(documents(rows), *paths).collect(), want)


def test_units_do_not_change_a_reading(paths):
    work, plain = alignment.Aligner(*paths), Plain(*paths)
    texts = [t for t in ODD if t]
    work_memory = alignment.REMEMBERED
    for found, text in zip(work.texts(texts * 2), texts * 2):
        want = plain.read(text)
        assert (found is None) == (want is None)
        if found:
            assert found[:4] == (want[0], want[1], len(want[2]), len(want[3]))
    assert len(work.known) <= work_memory


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def encode(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode(texts, **options)


def _matches(found, want):
    """Measures, and the pairs with their links, against a plain reading."""
    pairs = Counter(want[3])
    codes = {a << 32 | b: n for (a, b), n in pairs.items()}
    digest = want[4] and hashlib.sha256(";".join(want[4]).encode()).hexdigest()
    return (found[:4] == (want[0], want[1], len(want[2]), len(want[3]))
            and digest in (None, found[4]) and dict(zip(*map(list, found[5:]))) == codes)


def test_new_units_are_read_many_at_once(paths):
    work, plain = alignment.Aligner(*paths), Plain(*paths)
    work.a, work.b = Counted(work.a), Counted(work.b)
    texts = [" ".join(f"qu{'aeiou'[i % 5]}rk{i * 7919:x}, zo{i}n." for i in range(j, j + 100))
             for j in range(0, 2000, 100)]
    for found, text in zip(work.texts(texts), texts):
        assert _matches(found, plain.read(text))
    assert len(work.known) == 4000
    # 4,000 new units: one by one, they would be 4,000 texts for each tokenizer.
    assert work.a.texts <= 4000 / 50 and work.b.texts <= 4000 / 50


@pytest.mark.parametrize("divisible", [True, False])
def test_units_that_do_not_come_back_hide_no_others(paths, divisible):
    work, plain = alignment.Aligner(*paths), Plain(*paths)
    work.divisible = divisible
    texts = [f"plain{i} words{i}" for i in range(300)] + [t for t in ODD if t]
    texts[50] = "some ▁ x▁y mark"
    texts[120:120] = [" lead space", "trailing space ", "two  spaces", "¿odd edge?"]
    none = 0
    for found, text in zip(work.texts(texts), texts):
        want = plain.read(text)
        assert (found is None) == (want is None)
        assert found is None or _matches(found, want)
        none += found is None
    assert 0 < none < 10


def test_empty(spark, documents, paths):
    assert alignment.align(documents([]), *paths).collect() == []
    assert len(alignment.align(documents([(1, None), (2, "")]), *paths).collect()) == 2

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lumisweep.llm import decontaminate, langid, tokencount, toxicity, urlfilter


def test_decontamination(spark, documents):
    rng = random.Random(2)
    item = [f"b{i}" for i in range(30)]
    filler = [f"f{rng.randrange(10 ** 6)}" for _ in range(400)]

    def with_changes(step):
        return [w if (i + 1) % step else f"z{i}" for i, w in enumerate(item)]

    rows = [(1, " ".join(filler)), (2, " ".join(filler[:50] + item + filler[50:])),
            (3, " ".join(filler[:50] + with_changes(6) + filler[50:]).upper()),
            (4, " ".join(item[8:21])), (5, " ".join(item[8:17] + filler[:30])),
            (6, None), (7, ""), (8, "b1"), (9, "\n".join(item) * 2), (9, "clean"), (None, " ".join(item)),
            (10, " ".join(["c1 c2 c3 c4 c5 c6 c7 c8 c9"]))]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "c1 c2 c3 c4 c5 c6 c7 c8 c9"), (3, "f1 f2"), (4, None), (5, "")],
        "item_id long, text string")
    found = {r["doc_id"]: (r["contaminated"], r["first_item"])
             for r in decontaminate.contamination(documents(rows), bench).collect()}
    assert {i for i, (bad, _) in found.items() if bad} == {2, 3, 4, 9, 10, None}
    assert found[10] == (True, 2) and found[3] == (True, 1)
    assert decontaminate.contamination(documents([]), bench).count() == 0
    none = decontaminate.contamination(documents(rows), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_masks_fit_between_all_allowed_differences():
    for size in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        masks = decontaminate.MASKS + (
            decontaminate.SHORT_MASKS if size < decontaminate.WINDOW else ())
        for gone in itertools.combinations(range(size), size - -(-3 * size // 4)):
            assert any(not any(mask[i - at] == "1" for i in gone if at <= i < at + len(mask))
                       for mask in masks for at in range(size - len(mask) + 1)), (size, gone)


def brute_overlaps(texts, items):
    """Pairs that the window rule accepts, without seeds."""
    found = set()
    for d, text in texts:
        x = text.lower().split()
        for i, item in items:
            y = item.lower().split()
            n = min(len(y), 13)
            if len(y) >= 9 and any(
                    4 * sum(x[p + k] == y[q + k] for k in range(n)) >= 3 * n
                    for p in range(len(x) - n + 1) for q in range(len(y) - n + 1)):
                found.add((d, i))
    return found


@pytest.mark.parametrize("sizes", [(13, 15, 20), (9, 10, 11, 12, 15)])
def test_decontamination_meets_every_pair_of_the_window_rule(spark, documents, sizes):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(n))) for i, n in enumerate(sizes)]
    rows = []
    for i, item in items:
        words = item.split()
        for _ in range(150):
            share = rng.choice((0.2, 0.25, 0.3))
            rows.append([f"z{k}" if rng.random() < share else w for k, w in enumerate(words)])
        rows.append([w if k % 4 != 3 else f"z{k}" for k, w in enumerate(words)])
    texts = [(d, " ".join(["f1", "f2", *words, "f3"])) for d, words in enumerate(rows)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"])
             for r in decontaminate.overlaps(documents(texts), bench).collect()}
    expected = brute_overlaps(texts, items)
    assert found == expected and 0 < len(expected) < len(texts)


def test_forward_sums_all_segmentations(vocabulary):
    pieces = langid.pieces_of(vocabulary)
    rng = np.random.default_rng(0)
    chance = rng.random((pieces.count, 2))
    for word in ("the", "ing", "straße", "x", "zz"):
        data = word.encode()
        grid, sizes, _ = pieces.arrange([data])
        total = pieces.forward(grid, sizes, chance)[len(data), 0]
        edges = {(s, e): p[0] for s, e, _, p in pieces.edges(grid, sizes)}
        brute = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(data) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(data)]
            spans = list(zip([0, *ends], ends))
            if all(s in edges for s in spans):
                brute += np.prod([chance[edges[s]] for s in spans], axis=0)
        assert np.allclose(total, brute)


def test_long_words_sum_all_segmentations(vocabulary):
    pieces = langid.pieces_of(vocabulary)
    rng = np.random.default_rng(1)
    chance = rng.dirichlet(np.ones(pieces.count), 2).T
    words = ["donaudampfschifffahrtsgesellschaft", "straße" * 30, "語" * 200, "x" * 33,
             "the" * 4000, "каша" * 50]
    data = [w.encode() for w in words]
    found = pieces.long_logs(data, chance)
    for word, logs in zip(data, found):
        if len(word) > 2000:
            assert np.isfinite(logs).all()
            continue
        # The plain recursion over whole words with sums kept over their last value.
        grid, sizes, _ = pieces.arrange([word])
        total = np.zeros((len(word) + 1, 2))
        total[0], scale = 1, np.zeros(2)
        edges = {}
        for start, end, _, piece in pieces.edges(grid, sizes):
            edges.setdefault(end, []).append((start, piece[0]))
        for end in range(1, len(word) + 1):
            total[end] = sum(total[s] * chance[p] for s, p in edges[end])
            if end % 20 == 0:
                scale += np.log(total[end])
                total[:end + 1] /= total[end]
        assert np.allclose(logs, np.log(total[len(word)]) + scale)


def test_letters_and_units():
    assert langid.letter_words("x² ½ ① ab③cd Ⅷ") == ["x", "ab", "cd"]
    assert langid.letter_words("²½①12_") == []
    word = "aü語" * 40
    assert b"".join(langid.units(word)) == word.encode()
    assert all(0 < len(u) <= langid.UNIT and u.decode() for u in langid.units(word))


def test_expected_counts_of_a_word(vocabulary):
    pieces = langid.pieces_of(vocabulary)
    grid, sizes, _ = pieces.arrange([b"thering"])
    counts = pieces.expected(grid, sizes, np.full((pieces.count, 1), 0.1), np.ones((1, 1)))
    total = counts.sum()
    assert 1 <= total <= len(b"thering")


def test_language_id(spark, vocabulary):
    rng = random.Random(0)
    words = {"aa": ["kato", "miru", "sono"], "bb": ["grund", "stark", "pferd"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(8)), lang)
            for i in range(200) for lang in words]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (None, "kato kato", None),
             (903, "grund " * 30_000, None), (904, "Grund", None), (904, "Grund", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, vocabulary, carry=["lang"]).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is None or r["doc_id"] >= 900}
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[None]["lang_pred"] == "aa" and by_id[903]["lang_pred"] == "bb"
    held = [r for r in found if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert held and all(r["lang"] == r["lang_pred"] and 0.5 <= r["score"] <= 1 for r in held)
    assert langid.identify(docs.limit(0), vocabulary).count() == 0
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r[0] for r in langid.identify(blank, vocabulary).select("lang_pred").collect()} == {"und"}


def test_toxicity(spark, documents):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["scum", "Moron", "trash"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (None, "scum"), (702, "w1 " * 100_000), (703, "w1")]
    labels += [(700, 1), (703, None), (703, 5), (None, 1)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(documents(rows), known).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 80 and right > 0.93 * len(held)
    assert toxicity.toxicity(documents([]), known).count() == 0
    assert {r["score"] for r in toxicity.toxicity(documents(rows), known.limit(0)).collect()} == {0.0}


def test_toxicity_sample_is_bounded_where_an_id_repeats(spark):
    labels = spark.createDataFrame([(7, 1)] * 3000 + [(i, 0) for i in range(100, 900)],
                                   "doc_id long, label int")
    docs = spark.createDataFrame([(7, f"bad {i % 3}") for i in range(2000)]
                                 + [(i, f"good {i}") for i in range(100, 900)],
                                 "doc_id long, text string")
    assert toxicity.sample(labels, 400).where("label = 1").count() == 1
    assert 250 < toxicity.sample(labels, 400).where("label = 0").count() < 550
    places, weights = toxicity.train(docs, labels, 400)
    found = toxicity.score(spark.createDataFrame([(1, "bad"), (2, "good")],
                                                 "doc_id long, text string"), places, weights)
    assert found.count() == 2


def test_ftrl_keeps_useless_places_at_zero():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(l1=3.0)
    for _ in range(2000):
        label = int(rng.random() < 0.5)
        model.learn(np.array([1 if label else 2, 10 + rng.integers(500)]), label, 1.0)
    w = model.weights(slice(None))
    assert w[1] > 0.5 and w[2] < -0.5 and np.count_nonzero(w[10:510]) < 50


def brute_split(text, counts, total):
    best = (-math.inf, [])
    for cuts in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in counts or len(p) == 1 for p in parts):
            score = sum(math.log(counts[p] / total) if p in counts else
                        math.log(urlfilter.UNKNOWN / total) for p in parts)
            best = max(best, (score, parts))
    return best


def plain_split(run, counts, total):
    """Best split of each prefix from those of all shorter ones; ties to the longer last word."""
    best = {0: (0.0, [])}
    for end in range(1, len(run) + 1):
        ways = []
        for start in range(end):
            word = run[start:end]
            if word in counts or len(word) == 1:
                n = counts[word] if word in counts else urlfilter.UNKNOWN
                ways.append((best[start][0] + math.log(n / total), -start, [*best[start][1], word]))
        score, _, words = max(ways, key=lambda w: w[:2])
        best[end] = (score, words)
    return best[len(run)][1]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_takes_a_lone_letter_where_a_word_ends(seed):
    hits = [(0, 4, 10), (3, 2, 10)]
    assert urlfilter.viterbi("abcdx", hits, 20) == ["abcd", "x"]
    rng = random.Random(seed)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50)
             for _ in range(12)}
    total = sum(words.values())
    for _ in range(60):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        hits = [(i, len(w), n) for w, n in words.items() for i in range(len(text))
                if text.startswith(w, i)]
        found = urlfilter.viterbi(text, hits, total)
        score = sum(math.log((words[w] if w in words else urlfilter.UNKNOWN) / total)
                    for w in found)
        assert math.isclose(score, brute_split(text, words, total)[0])


def test_viterbi_matches_brute_force():
    counts = {"the": 5, "ring": 4, "thering": 1, "he": 2, "in": 7, "g": 1, "r": 1, "t": 2}
    total = sum(counts.values())
    for text in ("thering", "theringthe", "xhe", "gg", "ringxin"):
        hits = [(i, len(w), n) for w, n in counts.items() for i in range(len(text))
                if text.startswith(w, i)]
        found = urlfilter.viterbi(text, hits, total)
        score, _ = brute_split(text, counts, total)
        assert "".join(found) == text
        assert math.isclose(score, sum(
            math.log((counts[w] if w in counts else urlfilter.UNKNOWN) / total) for w in found))


def test_url_rules_and_odd_urls(spark):
    urls = {1: "http://A.example.NET/en/x?q#f", 2: "https://example.net/de/", 3: "http://netx/en/",
            4: None, 5: "no scheme", 6: "x://net", 7: "x://net/", 8: "http://www.example.org/fr/a",
            9: "http://example.com/de", 10: "http://example.com/de/9", 11: "://é.net/\n/a",
            12: "http://" + "abc" * 5000 + ".org/" + "z/" * 5000}
    pages = spark.createDataFrame(
        [(i, u, f"<title>The ring {i}</title>", "x") for i, u in urls.items()] + [(1, urls[1], None, "x")],
        "page_id long, url string, html string, host string")
    found = urlfilter.judge(pages).collect()
    assert len(found) == len(urls) + 1
    by_id = {r["page_id"]: r for r in found}
    assert [by_id[i]["rule"] for i in range(1, 12)] == [
        "example.net/en/", "net/", None, None, None, None, "net/", "org/fr/", None,
        "example.com/de/", "net/"]
    assert (by_id[1]["host"], by_id[1]["path"]) == ("a.example.net", "/en/x")
    assert by_id[4]["host"] == by_id[5]["path"] == "" and by_id[6]["path"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in found)
    assert urlfilter.judge(pages.limit(0)).count() == 0


def brute_verdicts(pages):
    """Naive Bayes in plain Python over hosts split here."""
    import re
    from collections import Counter
    titles = Counter(w for p in pages for w in re.findall(r"[^\W\d_]+", (re.search(
        r"(?i)<title[^>]*>([^<]*)", p["html"] or "") or [0, ""])[1].lower()))
    total = sum(titles.values())
    out, taught = {}, {"block": Counter(), "allow": Counter()}
    rows = []
    for p in pages:
        host, path = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", p["url"]).groups()
        tokens = []
        for run in re.findall(r"[^\W\d_]+", host.lower()):
            tokens += plain_split(run, titles, total)
        tokens += re.findall(r"[^\W\d_]+", path.lower())
        fits = [(len(h + s), k) for k, h, s in urlfilter.RULES
                if ("." + host.lower()).endswith("." + h) and path.startswith(s)]
        rule = max(fits)[1] if fits else None
        rows.append((p["page_id"], tokens, rule))
        if rule:
            taught[rule].update(tokens)
    size = len(set(taught["block"]) | set(taught["allow"]))
    docs = {k: sum(r == k for *_, r in rows) for k in taught}
    for page, tokens, rule in rows:
        odds = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        for t in tokens:
            if t in taught["block"] or t in taught["allow"]:
                odds += math.log((taught["block"][t] + 1) / (sum(taught["block"].values()) + size))
                odds -= math.log((taught["allow"][t] + 1) / (sum(taught["allow"].values()) + size))
        out[page] = rule or ("block" if round(odds, 9) > 0 else "allow")
    return out


def test_url_filter_matches_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages).collect()}
    assert found == brute_verdicts(pages.collect())


def test_token_counts_match_the_library(documents, vocabulary):
    rng = random.Random(4)
    alphabet = "a é  ▁ \n\t<s></s>ﬁ\u0301漢ß.,1 ﷺ¨ \u3000 x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["word " * 5000, "x" * 20_000, " ", "a b" * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again"), (None, "no id"), (800, None)]
    found = tokencount.token_counts(documents(rows), vocabulary).collect()
    model = tokencount.encoder(vocabulary).model
    assert sorted(map(tuple, found), key=repr) == sorted(
        ((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096)
         for i, t in rows), key=repr)
    assert tokencount.token_counts(documents([]), vocabulary).count() == 0


@pytest.mark.parametrize("most", [1, 10])
def test_token_memory_is_bounded(vocabulary, monkeypatch, most):
    monkeypatch.setattr(tokencount, "REMEMBERED", most)
    encoder = tokencount.Encoder(vocabulary)
    texts = ["one two three", "four five one", ""]
    assert encoder.count(texts) == [len(encoder.model.encode(t)) for t in texts]
    assert encoder.count(texts[::-1]) == [len(encoder.model.encode(t)) for t in texts[::-1]]


def test_score_batches_agree(vocabulary):
    pieces = langid.pieces_of(vocabulary)
    chance = np.full((pieces.count, 1), 1 / pieces.count)
    texts = [["the", "ring"], [], ["ring"] * 3, ["é" * 40]]
    whole = langid.Scorer(pieces, chance).of_texts(texts)
    small = langid.Scorer(pieces, chance)
    small.remembered = 1
    assert np.allclose(whole, np.concatenate([small.of_texts([t]) for t in texts]))
    assert whole[1, 0] == 0 and pa.array(whole[:, 0]).null_count == 0

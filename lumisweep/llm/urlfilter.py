"""URL filter (operator 4): rules first, then naive Bayes over segmented hosts and paths.

Host names are written without spaces.  Each run of letters in a host is split into words by
unigram Viterbi: the split with the largest product of word probabilities, words of the
pages' titles being counted over the whole table; a letter that no known word covers stands
alone at a cost.  The words of the host and the letter runs of the path are the tokens.
Multinomial naive Bayes with add-one smoothing learns from all urls that a rule judges and
gives the verdict of those that no rule fits.

Nothing that grows with the table is broadcast or gathered: substrings of distinct letter
runs meet the word counts in a join, tokens meet their weights in a join, and sums are
combined before the shuffle.  Distinct urls are scored once.

A null url, or one without ``://``, has an empty host and path, no tokens, and gets the
verdict of the priors.  Equal odds allow.  Null titles count no words.  Repeated rows count
each and are judged each.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisweep.llm.common import ascii_lower, settle

#: verdict, host, start of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LETTERS = r"\p{L}+"
#: Share of one count that a letter without a known word gets.
UNKNOWN = 0.01


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(
        F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host))
                & F.col("path").startswith(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def title_words(pages: DataFrame) -> DataFrame:
    """``word, n`` over the titles of all pages."""
    title = F.regexp_extract("html", r"(?i)<title[^>]*>([^<]*)", 1)
    words = F.regexp_extract_all(F.lower(title), F.lit(LETTERS), 0)
    return (pages.select(F.explode(words).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")))


def viterbi(text: str, hits: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable split of ``text``; ``hits`` are start, length and count of known words.

    Equal splits: the one whose last word is longer, then the same before it.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, size, n in hits:
        ending.setdefault(start + size, []).append((start, math.log(n / total)))
    alone = math.log(UNKNOWN / max(1, total))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        # A letter can stand alone anywhere, also where a known word ends.
        options = [(end - 1, alone), *ending.get(end, [])]
        found = max((best[s][0] + p, -s) for s, p in options)
        best.append((found[0], -found[1]))
    words, end = [], len(text)
    while end:
        words.append(text[best[end][1]:end])
        end = best[end][1]
    return words[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``run, words`` for each distinct letter run (``run``)."""
    total, longest = words.agg(F.sum("n"), F.max(F.length("word"))).first()
    total = total or 0
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest or 1), F.length("run") - F.col("start")))
    parts = (runs.select("run", F.explode(F.sequence(
        F.lit(0), F.length("run") - 1)).alias("start"))
        .select("run", "start", F.explode(sizes).alias("size"))
        .select("run", "start", "size",
                F.substring(F.col("run"), F.col("start") + 1, F.col("size")).alias("word")))
    known = (parts.join(words, "word").groupBy("run").agg(
        F.sort_array(F.collect_list(F.struct("start", "size", "n"))).alias("hits")))
    schema = pa.schema([("run", pa.string()), ("words", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [viterbi(run, [(h["start"], h["size"], h["n"]) for h in hits or []], total)
                     for run, hits in zip(*(batch.column(i).to_pylist() for i in range(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array(found, schema.field(1).type)],
                schema=schema)

    return runs.join(known, "run", "left").select("run", "hits").mapInArrow(
        split, "run string, words array<string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, odds`` of each row of ``pages``."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("_url"))
    rule, by_rule = rule_of(rules)
    judged = (urls.select("page_id", host_of(F.col("_url")).alias("host"),
                          path_of(F.col("_url")).alias("path"))
              .withColumns({"rule": rule, "_by_rule": by_rule}))
    judged = settle(judged)

    # One row per distinct host and path, with how many pages have it.
    places = judged.groupBy("host", "path", "_by_rule").agg(F.count("*").alias("pages"))
    hosts = judged.select("host").distinct().select(
        "host", F.posexplode(F.regexp_extract_all(F.lower("host"), F.lit(LETTERS), 0))
        .alias("at", "run"))
    runs = segmented(hosts.select("run").distinct(), settle(title_words(pages)))
    host_tokens = hosts.join(runs, "run").groupBy("host").agg(
        F.flatten(F.collect_list("words")).alias("_words"))
    in_path = F.regexp_extract_all(F.lower("path"), F.lit(LETTERS), 0)
    tokens = settle(places.join(host_tokens, "host", "left").select(
        "host", "path", "_by_rule", "pages",
        F.concat(F.coalesce("_words", F.array().cast("array<string>")), in_path)
        .alias("tokens")))

    token = tokens.select("host", "path", "_by_rule", "pages", F.explode("tokens").alias("token"))
    blocked = F.when(F.col("_by_rule") == "block", F.col("pages")).otherwise(F.lit(0))
    allowed = F.when(F.col("_by_rule") == "allow", F.col("pages")).otherwise(F.lit(0))
    counts = settle(token.where("_by_rule is not null").groupBy("token").agg(
        F.sum(blocked).alias("b"), F.sum(allowed).alias("a")))
    sums = counts.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
    kinds, all_b, all_a = (x or 0 for x in sums)
    taught = tokens.agg(F.sum(blocked), F.sum(allowed)).first()
    prior = math.log(((taught[0] or 0) + 1) / ((taught[1] or 0) + 1))
    weights = counts.select("token", (F.log((F.col("b") + 1) / (all_b + kinds))
                                      - F.log((F.col("a") + 1) / (all_a + kinds))).alias("w"))
    odds = (token.where("_by_rule is null").select("host", "path", "token")
            .join(weights, "token").groupBy("host", "path").agg(F.sum("w").alias("_odds")))
    verdict = F.coalesce("_by_rule", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return (judged.join(odds, ["host", "path"], "left")
            .withColumn("odds", F.when(F.col("_by_rule").isNull(), F.round(
                F.coalesce("_odds", F.lit(0.0)) + prior, 9)))
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "odds"))

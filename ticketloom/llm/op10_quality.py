"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). The votes of all documents are counted by pattern (3 ** rules patterns at
most, whatever the input), expectation-maximisation on these counts estimates how often each rule votes which way on good
and on bad documents, and a document is kept when its posterior probability of being good is at least one half. Nothing is
learned from labels. The base limits are checked apart: a document that fails them isn't kept.

Defined results: null text has no words, so every count is zero and the base check fails; rows with a repeated or null doc_id are
judged each on their own.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, map_texts, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(r"[^\W\d_]")
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words inside repeated 3-word windows
WINDOW = 3
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended long, n_letter_words long, n_distinct long, n_shouted long"


def repeated_words(words: list[str], size: int = WINDOW) -> tuple[int, int]:
    """Words inside windows found twice or more (the first included), and distinct words."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(words) - size + 1
    if n < 2:
        return 0, len(number)
    key = ids[:n]
    for j in range(1, size):  # window classes, renumbered at each step so that they never overflow
        key = key * len(number) + ids[j : j + n]
        if j < size - 1:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    k = key[order]
    twice = np.zeros(n, bool)
    same = k[1:] == k[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum()), len(number)


def features(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat, distinct = repeated_words(words)
    return (
        len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat,
        len(lines), sum(x.rstrip(" \t\r\x0b\x0c").endswith((".", "!", "?", "…", "。", '"', "”", ":", ")")) for x in lines), sum(1 for w in words if LETTER.search(w)), distinct, sum(1 for w in words if w.isupper() and len(w) > 2),
    )


def measured(docs: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in FEATURES.split(", ")][1:]

    def rows(ids, texts):
        got = [features(t.decode()) for t in texts]
        return {"doc_id": ids} | {c: [g[i] for g in got] for i, c in enumerate(names)}

    return map_texts(docs, FEATURES, rows)


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes as columns over FEATURES; limits are in the units of the counts, so that no rule divides by zero."""
    c = F.col
    return {
        "length": vote(c("n_words") >= 80, c("n_words") < MIN_WORDS),
        "word_length": vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 10 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
        "symbols": vote(50 * c("n_symbols") <= c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "dup_lines": vote(c("n_dup_lines") == 0, 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": vote(5 * c("n_repeat_words") <= c("n_words"), 10 * c("n_repeat_words") > 4 * c("n_words")),
        "letters": vote(10 * c("n_letter_words") >= 9 * c("n_words"), 10 * c("n_letter_words") < 7 * c("n_words")),
        "ended": vote(2 * c("n_ended") >= c("n_lines"), 10 * c("n_ended") < c("n_lines")),
        "shouted": vote(20 * c("n_shouted") <= c("n_words"), 10 * c("n_shouted") > 3 * c("n_words")),
        "distinct": vote(5 * c("n_distinct") >= c("n_words"), 20 * c("n_distinct") < c("n_words")),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.8) -> tuple[float, np.ndarray]:
    """(log odds of good, log odds [rule, vote + 1]) by expectation-maximisation over vote patterns (n x rules, -1..1).
    It starts from the votes' sum; each rule's probabilities are smoothed by one count for each vote and are kept
    on the side that its votes name, so that good can't turn into bad."""
    total = counts.sum()
    if not total:
        return 0.0, np.zeros((patterns.shape[1], 3))
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    good = 1 / (1 + np.exp(-(patterns.sum(axis=1) + np.log(prior / (1 - prior)))))
    for _ in range(rounds):
        share = min(max((counts * good).sum() / total, 0.01), 0.99)
        p1 = np.einsum("p,prv->rv", counts * good, hot) + 1
        p0 = np.einsum("p,prv->rv", counts * (1 - good), hot) + 1
        odds = np.log(p1 / p1.sum(axis=1, keepdims=True)) - np.log(p0 / p0.sum(axis=1, keepdims=True))
        odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        bias = float(np.log(share / (1 - share)))
        new = 1 / (1 + np.exp(-np.clip(bias + np.einsum("prv,rv->p", hot, odds), -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return bias, odds


def judged(docs: DataFrame) -> DataFrame:
    """FEATURES, base_failed, quality (posterior probability of good), kept."""
    feats = cut(measured(docs))
    named = rules()
    seen = feats.select(*(v.alias(n) for n, v in named.items())).groupBy(*named).count().collect()
    patterns = np.array([[r[n] for n in named] for r in seen], int).reshape(-1, len(named))
    bias, odds = estimate(patterns, np.array([r["count"] for r in seen], float))
    score = F.lit(float(bias))
    for (_, v), w in zip(named.items(), odds, strict=True):
        score = score + F.when(v == -1, float(w[0])).when(v == 1, float(w[2])).otherwise(float(w[1]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return feats.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-score))}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")

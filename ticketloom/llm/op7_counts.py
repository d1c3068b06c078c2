"""Token counts of a unigram tokenizer, without making the tokens.

The vocabulary is a list of pieces with scores. Texts get a leading space mark, spaces become marks, and the text is parted
before each mark. In each part an Aho-Corasick automaton enumerates the pieces, and dynamic programming carries the best
score and its number of pieces to each position. The rules are those of the tokenizers library's Unigram model:
scores are summed in double precision from the left; a later candidate replaces the best one only if it is greater, and
candidates come by their start, so that of equal ones the longest last piece wins; a character that is no piece costs the least score
less 10 and counts as its UTF-8 bytes. Names of control and byte pieces ("<s>", "<0x41>") are ordinary text here.

The scores are those of the public piece model, which has no unigram kind: ranks serve as scores there, so the counts are
those of that vocabulary under unigram rules, and not those of its own merge rules (op2 has these).

Defined results: null or empty text has no tokens.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import Memory, map_texts, table
from .op2_sentencepiece import BYTE, MARK, NORMAL, Model, model_path

PENALTY = 10.0
REMEMBERED = 400_000


class Counter:
    """count(text) gives (tokens, best score); pieces: (piece, score), with a byte piece for each byte."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.memory = Memory(REMEMBERED, self.learn)

    def best(self, s: str) -> tuple[int, float]:
        """(tokens, score) of a part, whose space mark is put before it here."""
        s = MARK + s
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.auto.iter(s):
            ends[end].append(match)
        for end, found in enumerate(ends):
            top, k = None, 0
            found.sort(reverse=True)  # by start
            for length, piece in found:
                x = score[end + 1 - length] + piece
                if top is None or x > top:
                    top, k = x, count[end + 1 - length] + 1
            if not found or found[-1][0] > 1:  # the character itself is no piece
                x = score[end] + self.unknown
                if top is None or x > top:
                    top, k = x, count[end] + len(s[end].encode())
            score[end + 1], count[end + 1] = top, k
        return count[n], score[n]

    def learn(self, parts: list[str]) -> list[tuple[int, float]]:
        return list(map(self.best, parts))

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = (text if text[0] in " " + MARK else " " + text).replace(MARK, " ").split(" ")
        n, score = zip(*self.memory.values(parts[1:]), strict=True)
        return sum(n), sum(score)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with their scores, byte pieces left out (they come in only for unknown characters)."""
    m = Model(path)
    return [(p, s) for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == NORMAL]


def hf_vocabulary(path: str) -> list[tuple[str, float]]:
    """The whole vocabulary as the tokenizers library takes it, for comparison."""
    m = Model(path)
    return [(p, s if k in (NORMAL, BYTE) else 0.0) for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True)]


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score: one row for each row of docs."""
    at = path or model_path()

    def rows(ids, texts):
        c = counter(at)
        got = [c.count(t.decode()) for t in texts]
        return {"doc_id": ids, "n_tokens": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_texts(docs, "doc_id long, n_tokens long, score double", rows)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

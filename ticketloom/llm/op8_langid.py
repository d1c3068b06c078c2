"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of a bounded sample of labelled texts. A text is cut into chunks
(the whole text, so that a long one can't outgrow the dictionary by its own history), each chunk is compressed with each
language's dictionary, and the language with the smallest sum wins; ties go to the language with more labelled rows. The
margin of the second language over the first gives the score, and narrow margins are rejected.

Learning uses text and lang of rows outside the held-out fold only: up to SAMPLE_DOCS texts a language, those with the least
hash of their id, and EXCERPT characters of each. That is the only bound; predictions read every text whole.

Defined results: null text or text without a letter is `und` with score 0; without any labelled row every prediction is `und`.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, keep_texts, map_texts, table

LETTERS = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample: texts for each language, characters of each text, bytes of a dictionary.
SAMPLE_DOCS, EXCERPT, DICTIONARY = 96, 2000, 96 << 10
CHUNK, LEVEL = 2048, 6
#: Texts below this many bytes gain nothing from compression alone. They are compressed after BASE bytes of the language, whose
#: size is taken off, and this with BASES such texts, as single sizes are whole bytes.
SHORT, BASE, BASES = 400, 2048, 4
#: Least margin (second size over first, less one) of an accepted prediction.
MARGIN = 0.005


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, n: int = SAMPLE_DOCS, excerpt: int = EXCERPT) -> list[tuple[str, list[str]]]:
    """(language, texts), most frequent language first."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a share of each language that has about four times the texts wanted, so that one pass finds them
    share = F.element_at(F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 4 * n / c)))), F.col("lang"))
    r = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where((r < share) & (F.length("text") > 0)).select("lang", r.alias("r"), "doc_id", F.substring("text", 1, excerpt).alias("t")).collect()
    found: dict[str, list] = {}
    for row in sorted(rows, key=lambda x: (x["r"], x["doc_id"])):
        found.setdefault(row["lang"], []).append(row["t"])
    return [(k, found[k][:n]) for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if k in found]


def letters(text: str) -> bytes:
    """What is compressed: the lower-cased words of letters, so that capitals, digits and symbols say nothing."""
    return " ".join(LETTERS.findall(text.lower())).encode()


def dictionaries(docs: DataFrame) -> tuple[tuple[str, bytes], ...]:
    # the end of a dictionary is the cheapest to refer to; order is that of the sample
    return tuple((k, letters("\n".join(dict.fromkeys(t)))[-DICTIONARY:]) for k, t in sample(docs))


def compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple]:
    """For each language: compressor for texts, compressor for short texts after a base, the bases, their size together."""
    out = []
    for _, raw in model:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        # a base must not be a copy of what the dictionary holds, or nothing is learned from it
        n = BASE if len(raw) > 2 * BASE * BASES else len(raw) // (2 * BASES)
        rest = zstandard.ZstdCompressionDict(raw[n * BASES :].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        rest.precompute_compress(level=LEVEL)
        c2 = zstandard.ZstdCompressor(level=LEVEL, dict_data=rest, write_content_size=False, write_dict_id=False, write_checksum=False)
        bases = [raw[i * n : (i + 1) * n] + b" " for i in range(BASES)]
        out.append((c, c2, bases, sum(len(c2.compress(x)) for x in bases)))
    return out


def predict(text: str, model: tuple) -> tuple[str, float, float]:
    """(language or und, score 0..1, margin)."""
    clean = letters(text)
    if not model or not any(map(str.isalpha, clean.decode())):  # LETTERS also takes fractions and circled numbers
        return "und", 0.0, 0.0
    if len(clean) < SHORT:
        sizes = [max(1, sum(len(c.compress(x + clean)) for x in bases) - size) for _, c, bases, size in held(compressors, model)]
    else:
        parts = [clean[i : i + CHUNK] for i in range(0, len(clean), CHUNK)]
        sizes = [sum(map(len, map(c.compress, parts))) for c, *_ in held(compressors, model)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = sizes[:best] + sizes[best + 1 :]
    margin = min(rest) / sizes[best] - 1 if rest else 1.0
    return model[best][0], min(1.0, margin / (margin + MARGIN)), margin


def languages(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score, accepted (und and narrow margins are rejected): one row for each row of docs. train
    has doc_id, text and lang; docs if not given."""
    model = dictionaries(docs if train is None else train)

    def rows(ids, texts):
        got = [predict(t.decode(), model) for t in texts]
        return {"doc_id": ids, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] >= MARGIN for g in got]}

    return map_texts(docs, "doc_id long, lang_pred string, score double, accepted boolean", rows)


def accepted(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is predicted with a margin that is not narrow."""
    model = dictionaries(docs if train is None else train)

    def keep(texts):
        return [g[0] != "und" and g[2] >= MARGIN for g in (predict(t.decode(), model) for t in texts)]

    return keep_texts(docs, keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")

"""Near copies for the pipeline: components of texts with a five-word similarity of at least 0.8; of each the row with the smallest
(doc_id, text hash) stays.

Fingerprints meet first, as in op3: each set of five-word shingles has a SimHash fingerprint, and the trie self-join finds those within
its budget of bits. Its links are no result yet: a pair is linked if its sets are similar. At a similarity of 0.8 two fingerprints of
64 bits differ in about ten bits, which no trie walk can take as a budget, so what the trie leaves apart is searched in op12's
tables; no pair of 0.8 is left to the trie alone.

Defined results: those of op12, except that texts without words are copies of each other. Rows without doc_id stay. Rows with one
doc_id and one text all stay or go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .op3_simhash import STRIDE, majority, signed, trie_links
from .op12_minhash import fit, groups, text_key

#: Least similarity in percent; at it, 64 tables of pairs of short keys miss a pair with 2 * (1 - 0.8^2)^8 = 0.06 %.
PERCENT, HALF, KEYS = 80, 2, 8


def print_of(x: np.ndarray) -> int:
    """The fingerprint of a set, from its shingles' hashes."""
    return signed(majority((x[i : i + STRIDE] for i in range(0, len(x), STRIDE)), len(x)))


def met_in_trie(nodes: DataFrame) -> DataFrame:
    """u, v: a node and the least one of its fingerprint, and the least ones of two fingerprints that the trie links; those that may be
    similar by their sizes and sketches."""
    first = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "q", "odd")).alias("a")))
    links = cut(trie_links(first.select("fp")).distinct())
    other = first.select(F.col("fp").alias("v"), F.col("a").alias("b"))
    across = links.join(first.withColumnRenamed("fp", "u"), "u").join(other, "v").select("a", "b")
    within = nodes.select("fp", F.struct("node", "q", "odd").alias("b")).join(first, "fp").where("a.node <> b.node").select("a", "b")
    near = across.union(within).where(fit("a.{}", "b.{}", PERCENT))
    return near.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that are the first of their group or have no doc_id."""
    go = groups(docs, PERCENT, HALF, KEYS, empty_linked=True, print_of=print_of, met_by=met_in_trie).where("doc_id <> first_id or tkey <> first_tkey").where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct()
    named = docs.withColumn("_of", text_key())
    return named.join(go, (named["doc_id"] == F.col("_id")) & (F.col("_of") == F.col("_tkey")), "left_anti").drop("_of")

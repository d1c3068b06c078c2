"""The pipeline, stage by stage and as a whole, against plain versions on a small table with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib

import corpus_pipeline
import sentencepiece
from test_near_copies import plain as plain_groups
from test_near_copies import shingles
from test_plain_models import SF, plain_language

from ticketloom.llm import op2_sentencepiece

KEY = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def table(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(110).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    full = [t for _, t, _ in rows if t and len(t.split()) > 60]
    near = [" ".join([*t.split()[:40], "changed", *t.split()[41:]]) for t in full[:8]]
    odd = [*near, full[0], full[1] * 30, full[2] + "\n" + items[0][1], items[1][1] + " " + " ".join(full[3].split()[:30]), "", None, "12 ½", "the", "\n\n", full[4] + "\n" + full[5]]
    rows += [(5000 + i, t, "en") for i, t in enumerate(odd)]
    rows += [rows[7], rows[7], (None, full[6], None), (None, None, "de"), (None, full[6], None)]
    return rows, items + [(None, "an item without a number that nobody holds"), (9999, None), (9998, "")]


def plain_lines(rows):
    cleaned = lambda x: x.strip(KEY).translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(cleaned(x)) >= 10:
                where[cleaned(x)].add(i)
    keep = lambda i, x: i is None or len(where[cleaned(x)]) < 2 or min(where[cleaned(x)]) == i
    return [(i, "\n".join(x for x in (t or "").split("\n") if keep(i, x)), k) for i, t, k in rows]


def plain_clean(rows, items):
    def windows(t, n):
        w = t.translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = [(s, len(next(iter(s)))) for _, x in items if (s := shingles(x))]
    bad = lambda t: any(len(s & windows(t, n)) >= 0.8 * len(s) - 1e-9 for s, n in held)
    return [r for r in rows if not bad(r[1])]


def bag(rows):
    return collections.Counter((i, t or "", k) for i, t, k in rows)


def test_stages_and_run(spark, tmp_path):
    rows, items = table(spark)
    docs = spark.createDataFrame([(i, t, k, "s", 1, 2, "k") for i, t, k in rows], COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sure = [ok for _, _, ok in plain_language([(i, t) for i, t, _ in rows], rows)]
    wants = [[r for r, ok in zip(rows, sure, strict=True) if ok]]
    wants.append(plain_lines(wants[-1]))
    left = collections.Counter(plain_groups([(i, t) for i, t, _ in wants[-1]]))
    wants.append([r for r in wants[-1] if left[r[0], r[1]]])
    wants.append(plain_clean(wants[-1], items))
    assert len(rows) > len(wants[0]) > len(wants[2]) > len(wants[3]) > 50 and wants[0] != wants[1]

    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants, strict=True):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and bag((r.doc_id, r.text, r.lang) for r in got.collect()) == bag(want), name
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")

    m = sentencepiece.SentencePieceProcessor(model_file=op2_sentencepiece.model_path())
    want = collections.Counter()
    for i, t, _ in wants[-1]:
        ids = [*m.encode(t), 2]
        want[i, tuple(ids), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter((r[0], tuple(r[1]), *r[2:]) for r in found) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticketloom.llm import op1_decontaminate as op1
from ticketloom.llm import op2_sentencepiece as op2
from ticketloom.llm import op3_simhash as op3
from ticketloom.llm import op4_substrings as op4
from ticketloom.llm import op5_urls as op5
from ticketloom.llm import op6_lines as op6
from ticketloom.llm import op7_counts as op7
from ticketloom.llm import op8_langid as op8
from ticketloom.llm import op9_tokenbin as op9
from ticketloom.llm import op10_quality as op10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tkey string, lines int, row string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(12)]
    shared = "A line that many documents hold, and a long one at that: " + " ".join(word() for _ in range(30))
    texts = [b if i % 3 else b + "\n" + shared + "\n" + b[:40] for i, b in enumerate(base)]
    texts += [base[0], base[1] + "!", base[1] + " more", base[2].upper(), "\n".join([shared, shared, "short", "short"]), "x", "", None, " \t\n", "é 日本 😀 " + shared, base[4] * 40]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[5]), (None, None), (4, base[6])]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", 2, "b") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def bag(rows):
    return collections.Counter(map(str, rows))


def test_decontaminate(spark, docs, none):
    items = [(1, ROWS[0][1][10:200]), (2, "not in any of them at all, I say"), (3, None), (4, ""), (5, "x"), (6, " ".join(WORD.findall(ROWS[1][1])[3:40]) + " changed end"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingles(t, n):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = []
    for i, t in ROWS:
        for k, x in items:
            n = min(5, len(WORD.findall(x or "")))
            if k is not None and n and (s := shingles(x, n)) and len(s & shingles(t, n)) >= 0.8 * len(s) - 1e-9:
                want.append((i, k, len(s), len(s & shingles(t, n))))
    got = op1.contained(docs, bench).collect()
    assert bag((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got) == bag(want) and want
    left = op1.clean(docs, bench)
    held = op1.Items([(k, (x or "").encode()) for k, x in items])
    assert left.columns == docs.columns and left.count() == sum(not held.search((t or "").encode()) for _, t in ROWS)
    assert op1.contained(none, bench).count() == 0 and op1.contained(docs, bench.limit(0)).count() == 0


def test_sentencepiece(spark, docs, none):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=op2.model_path())
    want = []
    for i, t in ROWS:
        ids = [*m.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
    assert bag(tuple(r) for r in op2.encoded(docs, columns=("n_tokens", "ids_sha256", "decoded_sha256")).collect()) == bag(want)
    assert all(r.ids == [*m.encode(t or ""), 2] for r, t in zip(op2.encoded(spark.createDataFrame(ROWS[:5], "doc_id long, text string").coalesce(1)).collect(), [t for _, t in ROWS[:5]], strict=True))
    e, rng = op2.encoder(op2.model_path()), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices("ab the\n▁é日😀.\0<s>", k=rng.randint(0, 30)))
        assert e.encode(t) == m.encode(t) and e.decode(e.encode(t)) == m.decode(m.encode(t)), t
    for _ in range(500):
        ids = [rng.randrange(3, 500) for _ in range(rng.randint(1, 6))]
        assert e.decode(ids) == m.decode(ids), ids
    assert op2.encoded(none).count() == 0


def plain_components(fps):
    lab = list(range(len(fps)))

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                lab[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, none):
    fps = []
    for _, t in ROWS:
        w = WORD.findall(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, 1))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    groups = collections.defaultdict(list)
    for (i, _), c in zip(ROWS, plain_components(fps), strict=True):
        groups[c].append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in groups.items()}
    want = [(i, op3.signed(f), least[c]) for (i, _), f, c in zip(ROWS, fps, plain_components(fps), strict=True)]
    assert bag(tuple(r) for r in op3.near_duplicates(docs).collect()) == bag(want)
    assert op3.near_duplicates(none).count() == 0
    kept = {r.doc_id for r in op3.one_of_each(docs).collect()}
    assert all(i in kept for i in least.values() if i is not None) and len(kept) < len({i for i, _ in ROWS})


@pytest.mark.parametrize("seed", range(4))
def test_trie_walk(seed):
    rng = random.Random(seed)
    keys = [rng.getrandbits(64) for _ in range(3)]
    for _ in range(250):
        x = rng.choice(keys)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        keys.append(x)
    k = np.unique(np.array(keys, np.uint64))
    for top in (48, 56):
        u, v = np.triu_indices(len(k), 1)
        ok = (np.bitwise_count(k[u] ^ k[v]) <= 3) & (k[u] >> np.uint64(top) == k[v] >> np.uint64(top))
        assert (op3.forest(k, top, 3) == op3.roots(len(k), u[ok], v[ok])).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)], "u long, v long")
    got = {r.node: r.root for r in op3.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


def plain_spans(rows, length=100):
    signed = lambda t: op3.signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: (x[0], signed(x[1]))):
        raw = (t or "").encode()
        marks = []
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                marks.append((s, s + length))
            seen.add(raw[s : s + length])
        out[i, t] = op4.without(raw, marks)
    return [(i, len((t or "").encode()), *((out[i, t][1:] if i is not None else (0, 0))), hashlib.sha256(out[i, t][0] if i is not None else (t or "").encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_substrings(docs, none, monkeypatch, hot):
    monkeypatch.setattr(op4, "HOT", hot)
    assert bag(tuple(r) for r in op4.deduplicated(docs).collect()) == bag(plain_spans(ROWS))
    assert op4.deduplicated(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_run_length_index(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(5)]
    texts = [rng.choice(base) + bytes(rng.choices(b"abc", k=rng.randint(0, 5))) + rng.choice(base) for _ in range(9)]
    for length in (4, 7, 12):
        seen, want = set(), set()
        for j, t in enumerate(texts):
            for o in range(len(t) - length + 1):
                want |= {(j, o)} if t[o : o + length] in seen else set()
                seen.add(t[o : o + length])
        j, o = op4.matched(texts, length)
        assert set(zip(j.tolist(), o.tolist(), strict=True)) == want
    index = op4.RunLengthIndex(texts, 4)
    at = np.zeros(index.n, int)
    at[: len(texts)] = index.ends
    for j, off, row in index.stream():
        at[row] = index.starts[j] + off
    assert (index.before(at[1:]) == at[:-1]).all()


URLS = [
    ("http://WWW.Example.net/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.example.net", "a.example.net", "", None, None), ("http://b.net/x", "b.net", "/x", "net/", "block"),
    ("http://x.example.com/de/4", "x.example.com", "/de/4", "example.com/de/", "block"), ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://h?q=://z/", "h", "", None, None),
    ("http://free-casino-bonus.example.com/en/9", "free-casino-bonus.example.com", "/en/9", None, "block"), ("https://www.library.example.com/en/9", "www.library.example.com", "/en/9", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in op5.judged(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (verdict is None or got[i].verdict == verdict), URLS[i]
    own = spark.createDataFrame([("http://good.a/x", 0), ("http://bad.a/x", 1)], "url string, blocked int")
    assert op5.judged(pages, labelled=own).count() == len(URLS) and op5.judged(pages.limit(0)).count() == 0


def plain_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    where = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                where[key(x)].add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(where[key(x)]) < 2 or min(where[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(docs, none):
    got = op6.with_bitmaps(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(op6.kept_text(), 256)).collect()
    assert bag(tuple(r) for r in got) == bag(plain_lines(ROWS))
    assert op6.with_bitmaps(none).count() == 0
    new = op6.deduplicated(docs)
    assert new.columns == docs.columns and new.count() == len(ROWS) and new.where("row <> 'b'").count() == 0


def test_hot_lines(spark):
    rows = [(i, "\n".join(["the same line everywhere", f"own line number {i}", "x"])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = op6.with_bitmaps(d).select("doc_id", "n_lines", "n_dropped", F.sha2(op6.kept_text(), 256)).collect()
    assert bag(tuple(r) for r in got) == bag(plain_lines(rows))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    hf = Tokenizer(models.Unigram(op7.hf_vocabulary(op2.model_path()), unk_id=0, byte_fallback=True))
    hf.pre_tokenizer = pre_tokenizers.Metaspace()
    n = lambda t: len(hf.encode(t or "", add_special_tokens=False).ids)
    assert bag((r.doc_id, r.n_tokens) for r in op7.token_counts(docs).collect()) == bag((i, n(t)) for i, t in ROWS)
    c, rng = op7.counter(op2.model_path()), random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choices("ab the\n▁é日😀.", k=rng.randint(0, 30)))
        assert c.count(t)[0] == n(t), t
    assert op7.token_counts(none).count() == 0


def test_language(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = d.select("doc_id", "lang").join(op8.languages(d), "doc_id").where(op8.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "12 :-)", "z"), (None, "the and of", None)], "doc_id long, text string, lang string")
    r = {x.doc_id: x.lang_pred for x in op8.languages(odd, d).collect()}
    assert r[1] == r[2] == r[3] == "und" and r[None] == "en"
    assert [x.lang_pred for x in op8.languages(odd, none).collect()] == ["und"] * 4 and op8.languages(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op9.tokenizer_path())
    op9.write_ids(docs, f"{tmp_path}/a")
    got = sorted(map(tuple, op9.read_ids(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = []
    for i, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert bag((i, n, c) for i, _, n, c in got) == bag(want)
    op9.write_ids(none, f"{tmp_path}/b")
    assert op9.read_ids(spark, f"{tmp_path}/b").count() == 0
    for width in (1, 7, 16, 17, 32):
        ids = np.random.default_rng(0).integers(0, 1 << width, 9001, dtype=np.uint64).astype(np.uint32)
        p = op9.Packed(op9.pack([ids[:5], ids[5:5], ids[5:]], width))
        assert (p.ids(0, 9001) == ids).all() and (p.ids(4090, 8200) == ids[4090:8200]).all() and (p.doc(2) == ids[5:]).all() and not len(p.doc(1))


def plain_quality(t):
    w = WORD.findall(t or "")
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, pos = collections.Counter(win), set()
    for k, x in enumerate(win):
        pos |= {k, k + 1, k + 2} if n[x] > 1 else set()
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(pos) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(pos), failed


def test_quality(docs, none):
    got = op10.judged(docs).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag((i, *plain_quality(t)) for i, t in ROWS)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got) and op10.judged(none).count() == 0


def test_quality_keeps_good_documents(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = op10.judged(d).withColumnRenamed("quality", "p").join(lab, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in bad) <= 0.5 * len(bad)


def test_no_letter_is_no_language():
    model = (("en", b"the words of a language " * 40), ("de", b"die worte einer sprache " * 40))
    assert [op8.predict(t, model)[0] for t in ("", "12 ½ ² ①", "_ 3.5 !")] == ["und"] * 3 and op8.predict("½ the words of a language", model)[0] == "en"

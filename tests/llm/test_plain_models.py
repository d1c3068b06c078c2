"""URL model, language model and quality rules against plain versions of themselves, and on rows kept from their training."""

import collections
import math
import struct
import unicodedata
import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ticketloom.llm import op5_urls as op5
from ticketloom.llm import op8_langid as op8
from ticketloom.llm import op10_quality as op10

SF = "/root/testdata/sf0.001"

#: URLs that the training table doesn't have, nor their hosts.
BAD = """
http://casino-nights.example.org/en/5 https://poker-bonus-club.example.com/de/7 http://free-porn-videos.example.net/fr/9 https://xxx-cams.example.org/es/1
http://viagra-pills.example.com/en/3 https://cheap-replica-bags.example.net/en/2 http://torrent-warez.example.org/fr/6 https://phishing-drop.example.com/de/8
http://spam-seo-links.example.net/es/4 https://win-a-prize.example.org/en/1 http://payday-loans-now.example.com/en/6 https://sexy-dating.example.net/fr/2
""".split()
GOOD = """
http://swimming.example.org/en/5 https://library-of-maps.example.com/de/7 http://opera.example.net/fr/9 https://geography.example.org/es/1
http://town-hall.example.com/en/3 https://birdwatching.example.net/en/2 http://lectures.example.org/fr/6 https://vineyard.example.com/de/8
http://papers.example.net/es/4 https://sailing-club.example.org/en/1 http://archaeology.example.com/en/6 https://knitting.example.net/fr/2
""".split()


def logistic(labelled, rounds, rate=4.0, decay=1e-3):
    """Plain gradient descent over dictionaries of n-gram buckets."""
    rows = [(op5.grams(*op5.split(u)), y) for u, y in labelled]
    w, bias = collections.defaultdict(float), 0.0
    for _ in range(rounds):
        step, off = collections.defaultdict(float), 0.0
        for g, y in rows:
            z = sum(w[k] for k in g) / math.sqrt(len(g)) + bias
            miss = (1 / (1 + math.exp(-z)) - y) / len(rows)
            off += miss
            for k in g:
                step[k] += miss / math.sqrt(len(g))
        for k in step:
            w[k] -= rate * (step[k] + decay * w[k] / len(rows))
        bias -= rate * off
    return w, bias


def test_url_model_is_logistic_regression():
    rows = [(u, 1) for u in op5.BLOCKED.split()] + [(u, 0) for u in op5.ALLOWED.split()]
    got, (w, bias) = op5.fit(rows, rounds=30), logistic(rows, 30)
    assert got[-1] == pytest.approx(bias) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in w.items())
    assert sum(map(bool, got[:-1])) == sum(map(bool, w.values()))


def plain_url(url):
    """host, path, rule, verdict of the rule, by plain string cuts."""
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(r, v) for r, v in op5.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def probability(host, path):
    w = op5.built_in()
    g = op5.grams(host, path)
    return 1 / (1 + math.exp(-(sum(w[k] for k in g) / math.sqrt(len(g)) + w[-1]))) if host or path else 0.0


def test_urls_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(7, None), (7, None), (None, "http://A.B.NET/?x"), (8, ""), (9, "x://"), (10, "x:///en/"), (11, "http://example.net/en/" + "a/" * 50_000)]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string"))
    want = collections.Counter()
    for r in pages.collect():
        host, path, rule, verdict = plain_url(r.url)
        want[r.page_id, host, path, rule, verdict or ("block" if probability(host, path) >= 0.5 else "allow")] += 1
    wide = pages.selectExpr("*", "'x' AS host", "1 AS rule", "'y' AS p_block")
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op5.judged(wide).collect()) == want


def test_urls_kept_from_training():
    """21 of the 24 are right as measured (a bonus club and a prize pass, knitting is blocked); the floor leaves room for one more."""
    right = sum(probability(*op5.split(u)) >= 0.5 for u in BAD) + sum(probability(*op5.split(u)) < 0.5 for u in GOOD)
    assert right >= 20


def plain_language(rows, train):
    """(doc_id, language, accepted) of rows, from (doc_id, text, lang) of train; one dictionary object for each call of the compressor."""
    words = lambda t: " ".join(op8.LETTERS.findall(t.lower())).encode()
    found, counts = collections.defaultdict(list), collections.Counter()
    for d, t, k in train:
        if d is not None and k is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            counts[k] += 1
            if t:
                found[k].append((xxhash.xxh64_intdigest(struct.pack("<q", d), 42) % (1 << 30), d, t[: op8.EXCERPT]))
    raw = [(k, words("\n".join(dict.fromkeys(x[2] for x in sorted(found[k])[: op8.SAMPLE_DOCS])))[-op8.DICTIONARY :]) for k in sorted(counts, key=lambda k: (-counts[k], k)) if found[k]]

    def size(text, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=op8.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, level=op8.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress(text))

    out = []
    for d, t in rows:
        text = words(t or "")
        if not raw or not any(unicodedata.category(c)[0] == "L" for c in text.decode()):
            out.append((d, "und", False))
            continue
        sizes = []
        for k, x in raw:
            if len(text) < op8.SHORT:
                n = op8.BASE if len(x) > 2 * op8.BASE * op8.BASES else len(x) // (2 * op8.BASES)
                rest, bases = x[n * op8.BASES :], [x[j * n : (j + 1) * n] + b" " for j in range(op8.BASES)]
                total = sum(size(base + text, rest) - size(base, rest) for base in bases)
            else:
                total = sum(size(text[i : i + op8.CHUNK], x) for i in range(0, len(text), op8.CHUNK))
            sizes.append((max(1, total), len(sizes), k))
        best, *others = sorted(sizes)
        out.append((d, best[2], not others or others[0][0] / best[0] - 1 >= op8.MARGIN))
    return out


ODD = [(1, None), (2, ""), (3, "12 ½ ² ①"), (None, "the and of"), (4, "a"), (4, "a"), (4, "der"), (5, "日本語 の 文"), (6, "the theind and of ton " * 4000)]


def test_language_against_plain_version(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = [tuple(r) for r in d.collect()]
    rows = [(i, t) for i, t, _ in train][:60] + ODD
    docs = spark.createDataFrame([(i, t, "xx", "y", 0.0) for i, t in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    want = collections.Counter(plain_language(rows, train))
    assert collections.Counter((r.doc_id, r.lang_pred, r.accepted) for r in op8.languages(docs, d).collect()) == want
    kept = op8.accepted(docs, d)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(k[0] for k in want.elements() if k[2])


def plain_votes(t):
    words = op10.WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if op10.WORD.search(x)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or "")
    win = [tuple(words[i : i + 3]) for i in range(n - 2)]
    seen = collections.Counter(win)
    repeat = len({i + j for i, w in enumerate(win) if seen[w] > 1 for j in range(3)})
    letters = sum(any(op10.LETTER.match(c) for c in w) for w in words)
    ended = sum(x.rstrip(" \t\r\x0b\x0c")[-1] in '.!?…。"”:)' for x in lines)
    shouted = sum(w.isupper() and len(w) > 2 for w in words)
    dup = len(lines) - len(set(lines))
    bad_good = [
        (n < 50, n >= 80), (chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 10 * n), (symbols > 0.1 * n, symbols <= 0.02 * n), (dup > 0.3 * len(lines), dup == 0), (repeat > 0.4 * n, repeat <= 0.2 * n),
        (letters < 0.7 * n, letters >= 0.9 * n), (ended < 0.1 * len(lines), ended >= 0.5 * len(lines)), (shouted > 0.3 * n, shouted <= 0.05 * n), (len(set(words)) < 0.05 * n, len(set(words)) >= 0.2 * n),
    ]
    return tuple(-1 if b else int(g) for b, g in bad_good), n < 50 or 100 * repeat > 50 * n


def posterior(votes, rounds=100, prior=0.8):
    """Plain expectation-maximisation, a document at a time: probability of good for each row of votes."""
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-50, min(50, z))))
    good = [sigmoid(sum(v) + math.log(prior / (1 - prior))) for v in votes]
    for _ in range(rounds):
        share = min(max(sum(good) / len(good), 0.01), 0.99)
        odds = []
        for r in range(len(votes[0])):
            yes, no = collections.Counter({-1: 1.0, 0: 1.0, 1: 1.0}), collections.Counter({-1: 1.0, 0: 1.0, 1: 1.0})
            for v, g in zip(votes, good, strict=True):
                yes[v[r]] += g
                no[v[r]] += 1 - g
            o = {x: math.log(yes[x] / sum(yes.values())) - math.log(no[x] / sum(no.values())) for x in (-1, 0, 1)}
            odds.append({-1: min(o[-1], 0), 0: o[0], 1: max(o[1], 0)})
        new = [sigmoid(math.log(share / (1 - share)) + sum(o[x] for o, x in zip(odds, v, strict=True))) for v in votes]
        if max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9:
            break
        good = new
    return good


def test_quality_against_plain_version(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(None, None), (1, ""), (1, "x " * 400), (2, "Ab cd. " * 70_000), (2, "½ ¾ " * 60)], "doc_id long, text string"))
    rows = [tuple(r) for r in d.collect()]
    votes, failed = zip(*(plain_votes(t) for _, t in rows), strict=True)
    want = {(i, t): (round(p, 6), not f and p >= 0.5) for (i, t), p, f in zip(rows, posterior(votes), failed, strict=True)}
    got = op10.judged(d.selectExpr("*", "1 AS kept", "2 AS quality")).select("doc_id", F.round("quality", 6), "kept", "n_words").collect()
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == collections.Counter((i, *want[i, t]) for i, t in rows)


def test_posterior_of_one_half_is_kept(spark):
    assert op10.judged(spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")).first().base_failed
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op10, "estimate", lambda patterns, counts: (0.0, [[0.0] * 3] * patterns.shape[1]))
        text = " ".join(f"word{k}" for k in range(60))
        assert op10.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().kept

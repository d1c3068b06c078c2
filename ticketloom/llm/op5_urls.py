"""URL filters: rules first, and for the other URLs logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (url, blocked): the one below, or a DataFrame of which at
most MAX_LABELLED rows are taken, those with the least hash of the URL (the documented bound). Weights are a fixed-size vector,
whatever the input.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed; a probability of exactly
one half blocks; rows of one page_id, or without one, are judged each on their own; only page_id and url are read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, slices, table, to_arrow

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
MAX_LABELLED = 10_000
#: rule (host, then path from its first slash), verdict
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Fixed training values: URLs of our own making, first blocked ones, then allowed ones.
BLOCKED = """
http://adult-videos.example.com/en/10 http://free-adult-cams.example.org/fr/24 https://adult-x-chat.example.net/de/38 https://www.adult-dating.example.com/es/52
http://xxx-movies.example.org/en/66 https://sexy-pics.example.net/fr/80 http://porn-tube.example.com/de/94 https://m.porn-hd.example.org/es/108
http://best-casino-bonus.example.net/en/122 https://casino-royal.example.com/fr/136 http://online-poker-win.example.org/de/150 http://betting-tips.example.net/es/164
https://spam-links.example.com/en/178 http://link-farm.example.org/fr/192 http://spam-farm-seo.example.net/de/206 https://seo-farm.example.com/es/220
http://cheap-pills.example.org/en/234 https://buy-viagra-now.example.net/fr/248 http://pharma-discount.example.com/de/262 http://replica-watches.example.org/es/276
https://free-warez.example.net/en/290 http://torrent-cracks.example.com/fr/304 https://malware-drop.example.org/de/318 http://phishing-login.example.net/es/332
http://win-prize-now.example.com/en/346 https://click-here-win.example.org/fr/360 http://ads-tracker.example.net/de/374 https://payday-loans-fast.example.com/es/388
"""
ALLOWED = """
https://www.example.com/en/12 http://blog.example.org/fr/825?page=2 https://m.example.net/de/25#top http://news.example.org/es/190.html
https://docs.example.com/guide/intro http://www.city-library.example.org/catalogue/81 https://university.example.net/courses/physics https://museum.example.com/exhibits/2020
http://blog.gardening.example.org/post/7 https://recipes.example.net/soup/41 http://weather.example.com/forecast/north https://www.parliament.example.org/records/11
https://wiki.example.net/article/river http://history.example.com/en/1848 https://science-journal.example.org/volume/3/paper/9 https://school.example.net/maths/lesson-2
http://m.newspaper.example.com/fr/3321 https://www.bookshop.example.org/title/202 https://forum.example.net/thread/5501 http://travel-notes.example.com/es/lisbon
https://open-source.example.org/project/readme http://hospital.example.net/contact https://radio.example.com/programme/17 http://www.village.example.org/de/events
https://mathematics.example.net/en/theorem/6 http://geology.example.com/en/670 https://www.botany.example.org/fr/34 http://blog.railway.example.net/es/52.html
https://m.poetry.example.com/de/8 http://carpentry.example.org/en/88/ https://nation-theatre.example.net/en/720?page=2 http://m.astronomy.example.com/es/9#top
https://www.letters.example.com/en/41 http://harbour.example.org/fr/77.html https://m.orchard.example.net/de/118?page=2 http://violin-makers.example.com/es/204
https://blog.chemistry.example.org/en/13/ http://www.cathedral.example.net/fr/305 https://football-club.example.com/de/466#top http://m.island-ferry.example.org/es/512
https://lantern.example.net/en/630?utm_source=feed http://blog.meadow.example.com/fr/71 https://www.painting.example.org/de/845.html http://stones.example.net/es/95
https://kitchen-garden.example.org/en/252 http://bakery.example.net/fr/147/ https://blog.lighthouse.example.com/de/388 http://www.beekeepers.example.org/es/24
https://wiki.example.org/article/casino_(film) http://film-archive.example.com/review/poker-scenes https://web-basics.example.net/seo/introduction http://pharmacy-school.example.org/en/210
https://thatched-roofs.example.com/fr/4120 http://the-other-shore.example.net/es/961?page=2 https://anthem.example.org/de/7702#top http://www.another-day.example.com/es/318.html
https://health-and-hearth.example.net/en/1290 http://m.northern-lights.example.org/es/2044?page=2 https://tent-hire.example.com/fr/58?utm_source=feed http://earth-sciences.example.net/de/3019
https://hospital.example.com/leaflets/pills http://statistics.example.org/adult-education/11 https://security.example.net/advice/phishing http://news.example.com/torrent-of-rain
"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) by the documented cuts; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    found = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    host, path = (F.coalesce(x, F.lit("")) for x in found)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[int]:
    """Buckets of the n-grams, host and path apart; the ends of both are marked."""
    out = set()
    for tag, s in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        raw = s.encode()
        for n in SIZES:
            out.update(zlib.crc32(tag + raw[i : i + n]) % BUCKETS for i in range(len(raw) - n + 1))
    return sorted(out)


def split(url: str) -> tuple[str, str]:
    """The same cuts as parts(), for the training table."""
    if "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def fit(labelled: list[tuple[str, int]], rounds: int = 2000, rate: float = 4.0, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) by gradient descent with squared-weight decay; n-grams are scaled to unit length."""
    rows = [(grams(*split(u)), y) for u, y in labelled]
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    at = np.concatenate([g for g, _ in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    x = np.repeat([1 / np.sqrt(len(g)) for g, _ in rows], [len(g) for g, _ in rows])
    y = np.array([y for _, y in rows], float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(of, w[at] * x, len(rows)) + w[-1])))
        g = (p - y) / len(rows)
        w[:-1] -= rate * (np.bincount(at, g[of] * x, BUCKETS) + decay * w[:-1] / len(rows))
        w[-1] -= rate * g.sum()
    return w


@lru_cache(1)
def built_in() -> np.ndarray:
    return fit([(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()])


def judged(pages: DataFrame, key: str = "page_id", labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, p_block (the model's probability): one row for each row of pages."""
    if labelled is None:
        w = built_in()
    else:
        rows = labelled.select("url", F.col("blocked").cast("int").alias("y")).where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED).collect()
        w = fit([(r["url"], r["y"]) for r in rows])
    host, path = parts(F.col("url").cast("string"))
    cut = pages.select(F.col(key).cast("long").alias(key), host.alias("host"), path.alias("path"))
    schema = f"{key} long, host string, path string, p_block double"
    out = to_arrow(pages.sparkSession, schema)

    def run(batches):
        for b in slices(batches):
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            p = []
            for h, q in zip(hosts, paths, strict=True):
                g = grams(h, q)
                p.append(float(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(len(g), 1)) + w[-1])))) if h or q else 0.0)
            yield batch({key: b.column(0), "host": hosts, "path": paths, "p_block": p}, out)

    scored = cut.mapInArrow(run, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))

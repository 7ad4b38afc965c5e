"""URL filter: rules by host and path, else logistic regression on hashed character n-grams of both."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BITS, GRAMS = 14, (3, 4, 5)
#: Rows of a labelled table that a fit reads at most.
FIT_ROWS = 100_000

#: (rule, verdict): a host, and the beginning of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# A small labelled table (1: unwanted), invented addresses of the usual kinds.
UNWANTED = """best-casino-bonus.test/en/12 www.online-slots.test/win m.free-poker-chips.test/bet www.cheap-meds.test/en/471 www.discount-pills-shop.test/fr/76
blog.buy-pills-now.test/en/33 www.replica-watches.test/sale adult-cams.test/live xxx-videos.test/hot hot-singles.test/date spam-links.test/en/685 www.link-farm.test/seo
www.seo-spam-network.test/en/28 free-crack-download.test/keygen warez-torrents.test/serial payday-loans.test/cash www.quick-cash-loan.test/de/14
win-free-iphone.test/prize lottery-winner.test/claim crypto-doubler.test/invest get-rich-quick.test/scam fake-login.test/verify account-verify.test/phish
www.cheap-essays.test/order miracle-diet.test/weightloss malware-host.test/exe.php clickbait-farm.test/shock www.content-farm.test/en/825 www.cheap-pharma-pills.test/es/25
escort-ads.test/city""".split()
WANTED = """www.city-library.test/catalogue blog.gardening.test/en/12 news.daily-post.test/2020/05/story www.university.test/physics/lecture docs.python-lib.test/guide
en.encyclopedia.test/wiki/River m.weather.test/forecast www.museum.test/fr/collection www.recipes.test/de/kuchen blog.travel-notes.test/es/viaje
forum.cycling.test/thread/33 www.parliament.test/debates archive.history.test/1914 www.school.test/maths/lesson www.hospital.test/patients/guide
science.journal.test/articles/88 www.bookshop.test/en/novels blog.astronomy.test/en/471 www.courts.test/judgments www.theatre.test/fr/programme
www.railway.test/de/fahrplan m.museum.test/en/25 www.botany.test/species/fern blog.history.test/en/685 www.orchestra.test/concerts
docs.database.test/sql/select www.gallery.test/es/obras news.radio.test/en/770 www.charity.test/about blog.language.test/fr/825""".split()
SEED = [(f"http://{u}", 1) for u in UNWANTED] + [(f"http://{u}", 0) for u in WANTED]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased (A-Z) after the first ://, the path up to ? or #; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    ok = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(ok, host).otherwise(""), F.when(ok, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains if the path begins with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for text, v in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, beginning = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + beginning)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> list[int]:
    """Hashed character n-grams of host and path, each of which has marks at its ends."""
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for i in range(max(1, len(text) - n + 1)))
    return sorted(out)


def parts(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def fit(rows: list[tuple[str, int]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the bias) by stochastic gradient descent on a small table (url, 1 for unwanted)."""
    w = np.zeros((1 << BITS) + 1)
    data = [(np.array([*features(*parts(u)), 1 << BITS]), y) for u, y in rows]
    rng = random.Random(seed)
    for k in range(rounds):
        rng.shuffle(data)
        for x, y in data:
            scale = 1 / math.sqrt(len(x))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[x].sum() * scale))))
            w[x] += rate / (1 + 0.1 * k) * ((y - p) * scale - decay * w[x])
    return w


def fit_on(labelled: DataFrame) -> np.ndarray:
    """Fit on a table (url, label), of which at most FIT_ROWS rows are read, by a hash of the url."""
    rows = labelled.where("url is not null and label in (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(FIT_ROWS).collect()
    return fit([(r.url, int(r.label)) for r in rows])


def judge_urls(pages: DataFrame, weights: np.ndarray, rules=RULES, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url); score is the classifier's probability of unwanted
    (0 where host and path are empty: a null url, or one without ://). Repeated rows are judged each on its own, and an empty
    table gives an empty one. Of rules of one length the last by name wins; no two fit one url unless they are equal."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                if not h and not p:  # nothing to judge: allowed
                    score.append(0.0)
                    continue
                x = features(h, p)
                z = (weights[x].sum() + weights[-1]) / math.sqrt(len(x) + 1)
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    key = dict(split.dtypes)["page_id"]
    scored = split.mapInArrow(run, f"page_id {key}, host string, path string, score double")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= cut, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def url_query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), fit(SEED))

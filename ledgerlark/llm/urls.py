"""URL filters: longest matching rule, else logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table, which is a parameter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_RULES = 1000
#: (url, 1 for block); the default training table
LABELLED = (
    ("http://casino-royal.example.com/en/4410", 1),
    ("https://www.best-casino.example.net/bonus", 1),
    ("http://blog.online-bets.example.org/de/51?page=2", 1),
    ("https://sport-bets.example.com/fr/820.html", 1),
    ("http://m.poker-win.example.net/es/7/", 1),
    ("https://win-big.example.org/en/1203#top", 1),
    ("http://buy-pills.example.com/de/66", 1),
    ("https://www.cheap-meds.example.net/en/12", 1),
    ("http://cheap-loans.example.org/apply", 1),
    ("https://blog.pills-online.example.com/fr/930/", 1),
    ("https://adult-chat.example.com/en/71", 1),
    ("http://m.adult-video.example.net/xxx/4", 1),
    ("https://xxx-cams.example.org/es/3105?ref=x", 1),
    ("http://www.spam-mail.example.com/en/208", 1),
    ("https://link-farm.example.net/links/33", 1),
    ("http://spam-links.example.org/de/9041", 1),
    ("https://m.ads-server.example.com/fr/15.html", 1),
    ("http://track-click.example.net/pixel.gif", 1),
    ("https://blog.ads-popup.example.org/en/9/", 1),
    ("http://ad-track.example.com/es/450", 1),
    ("https://free-money.example.net/en/3377?utm_source=feed", 1),
    ("http://www.free-prize.example.org/claim", 1),
    ("https://replica-watch.example.com/de/19#top", 1),
    ("http://m.farm-links.example.net/fr/2", 1),
    ("https://blog.casino-club.example.net/en/62", 1),
    ("http://m.win-casino.example.org/fr/8", 1),
    ("https://spin-win.example.net/en/540.html", 1),
    ("http://blog.lucky-casino.example.com/de/31", 1),
    ("https://www.library.example.com/en/4410", 0),
    ("http://blog.travel.example.org/bonus", 0),
    ("https://m.recipes.example.net/de/51?page=2", 0),
    ("http://news.example.com/fr/820.html", 0),
    ("https://science.example.org/es/7/", 0),
    ("http://www.history.example.net/en/1203#top", 0),
    ("https://blog.garden.example.com/de/66", 0),
    ("http://m.weather.example.org/en/12", 0),
    ("https://theatre.example.net/apply", 0),
    ("http://tennis.example.com/fr/930/", 0),
    ("https://www.museum.example.org/en/71", 0),
    ("http://blog.thinking.example.net/about/4", 0),
    ("https://m.nation.example.com/es/3105?ref=x", 0),
    ("http://thunder.example.org/en/208", 0),
    ("https://www.station.example.net/links/33", 0),
    ("http://blog.stable.example.com/de/9041", 0),
    ("https://m.together.example.org/fr/15.html", 0),
    ("http://therapy.example.net/logo.gif", 0),
    ("https://www.mountain.example.com/en/9/", 0),
    ("http://blog.reading.example.org/es/450", 0),
    ("https://m.handmade.example.net/en/3377?utm_source=feed", 0),
    ("http://education.example.com/contact", 0),
    ("https://www.other-things.example.org/de/19#top", 0),
    ("http://the-station.example.com/fr/2", 0),
    ("https://tiles.example.net/en/812", 0),
    ("http://onions.example.net/de/44/", 0),
    ("https://www.heath.example.org/en/5120", 0),
    ("http://shoreline.example.net/fr/61?page=2", 0),
    ("https://blog.thesis.example.com/en/77.html", 0),
    ("http://m.anthem.example.net/es/900", 0),
    ("https://rations.example.org/en/6#top", 0),
    ("http://www.editions.example.net/fr/3021", 0),
    ("https://weather-today.example.com/de/15", 0),
    ("http://blog.bread-and-salt.example.net/en/48/", 0),
    ("https://m.motions.example.com/en/2204?utm_source=feed", 0),
    ("http://thrones.example.org/es/18.html", 0),
    ("https://www.tenths.example.net/en/730", 0),
    ("http://hinges.example.com/de/5", 0),
    ("https://blog.ninth.example.org/fr/111/", 0),
    ("http://nations.example.net/en/9090", 0),
)
BUCKETS = 1 << 14
_DIGITS = re.compile("[0-9]+")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (`host/path`) and its verdict, null where none fits.

    Equal lengths: the longer host wins. The rules are configuration, at most MAX_RULES.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> list[int]:
    """Buckets of the distinct character n-grams (3 to 5) of the host and of the path, runs of digits as 0."""
    found = set()
    for tag, part in (("h", f"^{host}$"), ("p", f"{path}$")):
        part = _DIGITS.sub("0", part)
        for n in (3, 4, 5):
            for i in range(len(part) - n + 1):
                found.add(zlib.crc32(f"{tag}{part[i : i + n]}".encode()) % BUCKETS)
    return sorted(found)


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def train(labelled=LABELLED, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent; the table is small by definition."""
    rows = [np.array(features(*split_url(u))) for u, _ in labelled]
    y = np.array([k for _, k in labelled], float)
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        off = np.array([1 / (1 + np.exp(-(weights[r].sum() / np.sqrt(len(r)) + bias))) for r in rows]) - y
        step = ridge * weights
        for r, e in zip(rows, off, strict=True):
            step[r] += e / np.sqrt(len(r)) / len(rows) * 4
        weights -= rate * step
        bias -= rate * off.mean()
    return weights, bias


def score_of(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    at = features(host, path)
    return float(1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(len(at)) + bias)))) if host else 0.0


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """Judge every url: page_id, host, path, rule, score, verdict.

    A null url or one without `://` has an empty host and path, score 0 and, as no rule fits,
    the verdict allow. Repeated rows are judged alike, other columns are ignored, an empty table
    gives an empty result. The score is computed for every url; a rule overrides it.
    """
    weights, bias = train(labelled)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series([score_of(h, p, weights, bias) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_ruled"), score("host", "path").alias("score"))
    return judged.select(
        "page_id", "host", "path", "rule", "score",
        F.coalesce("_ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
    )

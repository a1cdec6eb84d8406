"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

Native: scoring is one projection over the url column; n-grams are hashed with crc32 and their weights, a fixed-size
table fitted on the driver, are looked up in a literal array. No shuffle; other columns aren't read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict and rule, host before the first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: n-gram lengths and the size of the hashed weight table.
GRAMS = (3, 4)
BUCKETS = 8192
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Small labelled table, by families: words of hosts and paths to block and to allow. Words of a family share their stem and are held out together.
BLOCKED = (
    "casino casino-win online-casino casinos", "poker poker-room holdem-poker", "free-bets betting bets bet-now sports-betting", "gambling gamble gamblers-den", "roulette free-roulette", "blackjack blackjack-21", "online-slots slots slot-machine", "jackpot jackpots mega-jackpot",
    "lottery lotto lottery-win", "cheap-pills pills diet-pills", "viagra cheap-viagra", "pharma-deal pharmacy-cheap", "replica-watch replica-bags", "spam spam-farm", "link-farm backlinks", "adult adult-x adult-video", "xxx xxx-tube", "porn pornhub-mirror free-porn", "sex-cam sexy-chat sex",
    "escort escorts", "hot-dating hot-singles dating-tonight", "webcam-girls cam-girls", "ads-track adserver popads ads", "tracker track-click", "click-bait clickbank", "free-money easy-money money-fast", "fast-loan loans-now quick-loan", "payday payday-cash", "crypto-win bitcoin-doubler crypto",
    "warez warez-zone", "crack-keygen cracked-apps keygen", "torrent-movies torrents", "malware trojan-kit", "phishing verify-account", "free-iphone win-iphone prize-winner", "work-from-home get-rich",
)
ALLOWED = (
    "news newspaper newsroom", "library libraries", "science sciences", "weather forecast", "garden gardening", "recipes recipe cooking", "crackers-recipe crackers", "history historian", "travel traveller", "museum museums", "school schools", "university universities", "health healthcare", "sports sporting",
    "music musician", "forum forums", "docs documents", "support supporters", "community communities", "research researcher", "journal journals", "city cities", "family families", "photo photography", "theatre theatres", "therapist therapy", "anderson sanderson", "another mother", "theory theories", "nation national", "station stations",
    "western western-city", "eastern", "reading readers", "painting painters", "worth wordsworth", "leather weather-map", "essex sussex middlesex", "analysis analytics-lab", "classic classics", "expert experts", "alphabet better letters", "adults-education adultlearning", "slotted-spoon", "potter pottery", "camera cameras", "campus camping",
    "address", "loading", "adventure", "shadows", "railway", "bicycle cycling", "cookery cook", "physics", "chemistry", "biology", "kitchen", "parliament", "government", "council", "hospital", "church", "football", "cricket", "chess", "film cinema", "novel novels", "poetry poets", "dictionary", "encyclopedia wiki", "maps", "trains", "bakery", "market",
)
SUBDOMAINS = ("", "www.", "blog.", "m.")
SUFFIXES = ("example.com", "example.net", "example.org")
PATHS = ("/en/17", "/de/205/", "/fr/318.html", "/es/42", "/", "")
#: A path of a host to allow may name what is bad as a host: an article on it.
REFERENCES = ("encyclopedia.example.org/wiki/", "news.example.com/report/")


def labelled_urls() -> list[tuple[str, int, int, int]]:
    """The labelled table: (host + path, 1 = block, family, word), every word with some subdomain, suffix and path, in a fixed rotation."""
    out, n = [], 0
    for label, families in ((1, BLOCKED), (0, ALLOWED)):
        for i, family in enumerate(families):
            for word in family.split():
                n += 1
                for j in range(4):
                    out.append((f"{SUBDOMAINS[(i + j) % 4]}{word}.{SUFFIXES[(i + 2 * j) % 3]}{PATHS[(2 * i + j) % 6]}", label, i, n))
                if label:
                    out.append((f"{REFERENCES[i % 2]}{word}", 0, i, n))
    return out


def training_urls(used=lambda family, word: True) -> list[tuple[str, int]]:
    """(host + path, 1 = block) of the table's families and words that are used, and invented words like those of ordinary sites, so that unknown letters alone aren't a reason to block."""
    out = [(url, label) for url, label, family, word in labelled_urls() if used(family, word)]
    parts = ("th", "er", "on", "an", "in", "re", "st", "en", "ti", "ou", "es", "nd", "ha", "ed", "le", "ion", "ble", "ing", "sh", "wh", "ly", "at", "ea", "or")
    for i in range(240):
        word = "".join(parts[(i * a + b) % len(parts)] for a, b in ((1, 0), (5, 3), (7, i // 24)))
        out.append((f"{SUBDOMAINS[i % 4]}{word}.{SUFFIXES[i % 3]}{PATHS[(i // 3) % 6]}", 0))
    return out


def marked(host: str, path: str) -> str:
    """Host and path marked at both ends; letters of the path are capitals, so that its n-grams are others than a host's."""
    return f"^{host}{path.translate(str.maketrans(LOWER, UPPER))}$"


def buckets_of(url: str, grams: tuple[int, ...] = GRAMS, size: int = BUCKETS) -> list[int]:
    """Hashed n-grams of a host and path; every occurrence counts."""
    host, slash, path = url.partition("/")
    s = marked(host, slash + path)
    return [zlib.crc32(s[i : i + n].encode()) % size for n in grams for i in range(len(s) - n + 1)]


def share(url: str) -> np.ndarray:
    """A URL's hashed n-grams as shares that sum to 1, times 10."""
    x = np.bincount(buckets_of(url), minlength=BUCKETS).astype(float)
    return 10 * x / max(1.0, x.sum())


@lru_cache(1)
def fitted() -> tuple[float, tuple[float, ...]]:
    """The model of the whole labelled table."""
    return fitted_on(tuple(training_urls()))


def fitted_on(table: tuple[tuple[str, int], ...], steps: int = 1500, rate: float = 0.5, penalty: float = 1e-4) -> tuple[float, tuple[float, ...]]:
    """Intercept and weights of a penalised logistic regression by plain gradient descent with momentum; the same every time."""
    x, y = np.stack([share(u) for u, _ in table]), np.array([v for _, v in table], float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b, vw, vb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        d = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        vw, vb = 0.9 * vw - rate * (x.T @ d + penalty * w), 0.9 * vb - rate * d.sum()
        w, b = w + vw, b + vb
    return round(float(b), 6), tuple(np.round(w, 6).tolist())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def score(host: Column, path: Column) -> Column:
    """Log-odds of the model that the URL is to be blocked."""
    b, weights = fitted()
    table = F.array(*map(F.lit, weights))
    text = F.concat(F.lit("^"), host, F.translate(path, LOWER, UPPER), F.lit("$"))
    def weights_of(n: int) -> Column:
        last = F.length(text) - n + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(table, (F.crc32(F.substring(text, i, F.lit(n)).cast("binary")) % BUCKETS).cast("int")))

    total = sum((weights_of(n) for n in GRAMS), F.lit(0.0))
    number = sum((F.greatest(F.length(text) - n + 1, F.lit(0)) for n in GRAMS), F.lit(0))
    return F.lit(b) + F.when(number > 0, 10 * total / number).otherwise(0.0)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The longest fitting rule decides; a rule fits its host and its subdomains where the path starts with the rule's.
    Without one the model does: block from even odds. A null url, or one without `://`, has an empty host and path,
    which the model judges. Repeated rows are judged each; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    judged = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("score", score(F.col("host"), F.col("path")))
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0, "block").otherwise("allow")))

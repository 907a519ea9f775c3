"""URL filters: rules on hosts and paths, and logistic regression on hashed character n-grams for the rest.

The classifier is trained on a small table of labelled URLs, on the driver; what is broadcast is its 2 ** BITS weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, SIZES = 18, (3, 4, 5)
EPOCHS, RATE, L2 = 400, 20.0, 1e-5

# The filter's rules, as (verdict, host, start of the path).
RULES: list[tuple[str, str, str]] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

# Names of invented hosts to block, with words that such hosts are known by; names of others; and where a name may stand in a URL.
BLOCKED: list[str] = [
    "spam-mailer", "bulkspam", "seo-spam", "comment-spam", "spammers-den", "link-farm", "seo-linkfarm", "click-farm", "adult-videos", "hot-adult", "adult-cams", "xxx-adult", "xxx-live", "sex-chat", "porn-tube", "nude-x",
    "escort-girls", "online-casino", "casino-royal", "casinos", "crypto-casino", "win-big-money", "win-prize", "lottery-win", "gambling-kings", "poker-stakes", "slots-jackpot", "roulette-spin", "diet-pills", "pills-pharma", "discount-pills", "viagra-online",
    "cheap-meds", "cheap-replica", "cheapsteroids", "sports-bets", "best-bets", "horse-bets", "bet-bonus", "freebet-club", "free-spins", "free-xxx", "live-betting", "ads-server", "banner-ads", "popup-ads", "ads-network", "pixel-track",
    "track-clicks", "tracker-cdn", "usertrack", "malware-kit", "trojan-host", "virus-alert", "phish-bank", "hack-tools", "keygen-crack", "warez-torrent", "scam-prize", "payday-loans", "fake-login", "get-rich-quick",
]
ALLOWED: list[str] = [
    "encyclopedia", "library-docs", "university", "daily-post", "kitchen-table", "gardening", "city-museum", "open-science", "code-host", "weather-service", "bookshop", "travel-notes", "health-clinic", "music-school", "nature-photos", "local-paper",
    "hartwell", "norrin", "stenholt", "arderne", "lindsey", "rothane", "wentholm", "inglethorn", "ashering", "ethelred", "thornley", "sherwin", "station-road", "whitfield", "garden-nation", "radio",
    "theatre-season", "winter-sports", "bicycle-tours", "address-book", "marine-biology", "better-sleep", "athletics-field", "farm-house", "free-museum", "education", "hearing-health", "wine-cellar", "parliament", "lighthouse-trust", "oak-street", "river-walk",
    "maths-lessons", "history-forum", "bakery", "window-makers", "chapel-hill", "parish-news", "wheat-barley", "northern-rail", "southshore", "other-things", "thistle", "nationwide-maps", "intheran", "whispering",
    "school-meals", "green-grocer", "timetable", "tennis-club", "painters", "hospital-trust", "village-shop", "water-mill", "furniture-care", "stone-bridge", "pottery-class", "swimming-times", "dental-care", "quilt-patterns", "old-books", "knitting-club",
    "science-fair", "choir-practice", "harbour-view", "camping-gear", "fishing-boats", "allotments", "dairy-farm", "solar-panels", "legal-help", "tax-guide", "plumbing-repairs", "roofing", "primary-school", "film-society", "stamp-collectors", "astronomy",
    "street-maps", "bus-times", "church-bells", "pet-rescue", "horse-riding", "rowing-club", "crossword", "genealogy", "volunteers", "charity-run", "coffee-roasters", "tea-house", "vegetables", "butterflies", "mountain-huts", "ferry-times",
    "translators", "engineers", "surveyors", "architecture", "opera-house", "poetry", "grammar", "dictionary", "chemistry", "geology", "statistics", "economics", "philosophy", "archaeology", "nursing", "pharmacy-school",
]
PLACES: list[str] = [
    "http://{}.net/index.html", "https://www.{}.com/", "https://{}.org/en/4", "http://{}.info/a/b?c=1", "https://{}.example.com/fr/12", "http://blog.{}.example.org/de/310.html", "https://m.{}.example.net/es/77/", "https://www.{}.example.com/en/853#top",
]


def labelled() -> list[tuple[str, int]]:
    """The training table: each name in each place, 1 for those to block. Both kinds have the same places, so that these tell nothing."""
    return [(at.format(name), y) for y, names in ((1, BLOCKED), (0, ALLOWED)) for name in names for at in PLACES]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. The host stands after the first :// up to /, ?, # or the end, A-Z lower-cased; the path from there up to ?, # or the end. Both are empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return host.translate(_ASCII_LOWER), path[:stop]


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Rules:
    """Finds the longest rule for a host and path; of equally long ones the one with the longer host. The rules are looked
    up by the host's suffixes, so their number costs nothing."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, start in rules:
            self.by_host.setdefault(host, []).append((start, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule as host and path, and its verdict."""
        best, labels = None, host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best[0])):
                    best = (suffix + start, verdict)
        return best


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashes of the character n-grams of host and path, each with its ends marked."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        data = part.encode()
        for n in SIZES:
            out.update(zlib.crc32(data[i : i + n], ord(mark) * n) & ((1 << BITS) - 1) for i in range(len(data) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def train(rows: list[tuple[str, int]] | None = None) -> np.ndarray:
    """Weights of the hashed n-grams, the intercept last: logistic regression by full-batch gradient descent over labelled URLs, those of labelled()
    by default. A row's features are scaled to unit length. Every run gives the same weights."""
    rows = labelled() if rows is None else rows
    y = np.array([v for _, v in rows], float)
    rows = [features(*split_url(u)) for u, _ in rows]
    w = np.zeros((1 << BITS) + 1)
    flat, scale = np.concatenate(rows), np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(EPOCHS):
        z = np.bincount(of, w[flat], len(rows)) * scale + w[-1]
        g = 1 / (1 + np.exp(-z)) - y
        w[:-1] -= RATE * (np.bincount(flat, (g * scale)[of], 1 << BITS) / len(rows) + L2 * w[:-1])
        w[-1] -= RATE * g.mean()
    return w


def probability(weights: np.ndarray, host: str, path: str) -> float:
    """How likely the URL is one to block; 0 without a host."""
    if not host:
        return 0.0
    x = features(host, path)
    return float(1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + weights[-1]))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rows: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of pages.

    The longest fitting rule decides; without one, block if score, the classifier's probability, is 0.5 or more. Null URLs and those
    without :// have an empty host and path, no rule and score 0, and are allowed. Repeated rows are repeated; no other column is read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast((train(rows), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, told = shared.value
        table = Rules(told)
        score = lru_cache(1 << 14)(lambda host, path: probability(weights, host, path))
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                p, hit = score(host, path), table.find(host, path)
                for c, v in zip(cols, (host, path, hit and hit[0], hit[1] if hit else "block" if p >= 0.5 else "allow", p), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")

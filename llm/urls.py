"""URL filters: rules for hosts and paths, and for all other urls a logistic regression on hashed character n-grams.

The features of a url are the n-grams of GRAMS code points of its host and, apart from them, of its path, with marks
at both ends, hashed to BUCKETS places. The model is fitted on a small
table of labelled urls: one that is passed in, or the one ``labelled_urls`` makes from the term lists below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
ROUNDS, STEP, DECAY = 150, 0.03, 3e-5
SHARE = 0.125
FITTED = 20_000  # labelled urls that are fitted, at most
MOST_RULES = 100_000  # rules travel with the tasks
ALLOW, BLOCK = "allow", "block"
_SLICE = 1 << 19  # code points that are hashed at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of hosts and paths to block, and of ordinary ones. The second list ends with words that share letters with the
#: first one.
UNWANTED = (
    "casino bets betting poker slots jackpot roulette lottery win winner bonus pills pharma viagra meds pharmacy cheap discount "
    "adult xxx porn cams escort dating hookup nude ads adserver track tracker click banner popup affiliate spam farm seo "
    "linkfarm backlinks replica crack warez torrent keygen payday loans crypto doubler free prize giveaway x"
).split()
ORDINARY = (
    "news garden museum library recipes physics history weather school university journal cooking travel health sport "
    "music review docs wiki city council science forum letters poetry kitchen hiking railway harbor theatre painting "
    "castle forest mountain river village market bakery cinema orchestra chess sailing astronomy biology geology "
    "archive press daily gazette studio atelier better between alphabet winter window adventure advice tracks clicker "
    "farmer freedom prizewinner"
).split()
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ly tion ing ble al ra ne mo ka lu".split()


def labelled_urls(seed: int = 1, each: int = 1600) -> list[tuple[str, int]]:
    """``each`` urls to block (1) and twice as many to allow (0), half of them of ordinary and half of invented words.

    Both kinds share subdomains, domains, endings and paths, so that only words tell them apart.
    """
    rng = np.random.default_rng(seed)
    pick = lambda words: str(words[rng.integers(len(words))])
    out = []
    for k in range(3 * each):
        if k % 3 == 0:
            word, label = pick(["-", "-", ""]).join(pick(UNWANTED) for _ in range(2)), 1
        elif k % 3 == 1:
            word, label = pick(["-", ""]).join(pick(ORDINARY) for _ in range(rng.integers(1, 3))), 0
        else:
            word, label = pick(["", "", "-"]).join("".join(pick(_SYLLABLES) for _ in range(rng.integers(2, 5))) for _ in range(rng.integers(1, 3))), 0
        host = f"{pick(['', 'www.', 'm.', 'blog.', 'shop.'])}{word}{pick(['', '', '.example', '.site', '.host'])}.{pick(['com', 'net', 'org', 'info', 'de', 'co'])}"
        path = f"/{pick(['', 'en/', 'de/', 'fr/', 'es/', 'p/'])}{rng.integers(1, 60_000)}{pick(['', '/', '.html'])}"
        if k % 16 == 0:
            path = f"/{pick(UNWANTED)}{path}"
        out.append((f"{pick(['http', 'https'])}://{host}{path}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for text without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _places(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts as (text number, place); an empty text has none."""
    codes = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    empty = np.array([not t for t in texts], bool)
    owners, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, salt * 31 + n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = (owner[: len(h)] == owner[n - 1 :]) & ~empty[owner[: len(h)]]
        owners.append(owner[: len(h)][inside])
        places.append((h[inside] >> np.uint64(20)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(places)


class Model:
    """Weights of hashed n-grams; ``logits`` of (host, path) pairs."""

    def __init__(self):
        self.weights, self.bias = np.zeros(BUCKETS), 0.0

    def features(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(url number, place, value); an n-gram counts SHARE, less in hosts and paths with more than SHARE**-2 of them."""
        parts = []
        for salt, texts in enumerate((hosts, paths)):
            owner, place = _places(texts, salt)
            size = np.bincount(owner, minlength=len(texts))
            parts.append((owner, place, np.minimum(SHARE, 1 / np.sqrt(size[owner]))))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def logits(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        out, lo, size = np.zeros(len(hosts)), 0, 0
        for k in range(len(hosts) + 1):
            if k == len(hosts) or size > _SLICE:
                owner, place, value = self.features(hosts[lo:k], paths[lo:k])
                out[lo:k] = np.bincount(owner, self.weights[place] * value, k - lo)
                lo, size = k, 0
            if k < len(hosts):
                size += len(hosts[k]) + len(paths[k]) + 4
        return out + self.bias

    def fit(self, hosts: list[str], paths: list[str], y: np.ndarray) -> None:
        """Least log loss by gradient steps (Adam). With one label, or none, its smoothed share."""
        if not len(y) or y.min() == y.max():
            self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 2)))
            return
        owner, place, value = self.features(hosts, paths)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        m, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for t in range(1, ROUNDS + 1):
            z = np.bincount(owner, self.weights[place] * value, len(y)) + self.bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            g = np.bincount(place, d[owner] * value, BUCKETS) + DECAY * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.weights -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fitted(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """The model of at most FITTED labelled urls (1: block, 0: allow), picked by a hash of the url; other labels are left out."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1)).select(host.alias("host"), path.alias("path"), F.col(f"`{label}`").cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(FITTED).collect()
    model = Model()
    model.fit([r.host for r in rows], [r.path for r in rows], np.array([r.y for r in rows], np.float64))
    return model


class Rules:
    """Verdicts by host and path: a rule fits its host and all subdomains where the path starts with the rule's."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"not a verdict: {verdict}")
            host, slash, path = rule.partition("/")
            known = self.by_host.setdefault(host.translate(str.maketrans(_UPPER, _LOWER)), {})
            known[slash + path] = BLOCK if BLOCK in (verdict, known.get(slash + path)) else ALLOW
        if sum(map(len, self.by_host.values())) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones, the one with the longer host."""
        best, at = None, 0
        while True:
            known = self.by_host.get(host[at:])
            if known:
                for size in self.lengths[host[at:]]:
                    start = path[:size]
                    if len(start) == size and start in known:
                        if best is None or len(host) - at + size > len(best[0]):
                            best = host[at:] + start, known[start]
                        break
            at = host.find(".", at) + 1
            if not at:
                return best


def filtered(df: DataFrame, rules: Iterable[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict and score, one row per row.

    ``rules`` are (verdict, "host/path") pairs; the longest that fits a url decides, and of contradicting equal rules
    the blocking one. All other urls are blocked where score, the model's probability, is at least 0.5. ``labelled`` has
    url and label (1: block). NULL urls and urls without ``://`` have an empty host and path and the score of no
    n-grams. Columns of the five names are replaced, others stay; an empty table gives an empty result.
    """
    known = Rules(rules)
    spark = df.sparkSession
    model = fitted(labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int"))
    cols = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = host_and_path(F.col(f"`{url}`"))
    plain = df.select(host.alias("host"), path.alias("path"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(0).to_pylist(), b.column(1).to_pylist()
            score = 1 / (1 + np.exp(-np.clip(model.logits(hosts, paths), -30, 30)))
            found = [known.fitting(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdict = [f[1] if f else BLOCK if s >= 0.5 else ALLOW for f, s in zip(found, score.tolist(), strict=True)]
            added = [pa.array([f and f[0] for f in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "rule", "verdict", "score"])

    types = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))
    schema = "host string, path string, " + (types + ", " if cols else "") + "rule string, verdict string, score double"
    out = plain.mapInArrow(judged, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "host", "path", "rule", "verdict", "score")

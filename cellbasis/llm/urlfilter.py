"""URL filter: host and path rules, and for the rest gradient-boosted trees on lexical features.

The trees are trained on the URLs that the rules decide (block 1, allow 0), from a bounded sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import ready

#: The rules of the driver's query: host and path, and the verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The documented bound of the training sample: URLs that a rule decides, chosen by a hash, and characters of each; longer URLs
#: are judged like all others but not learnt from.
SAMPLE_URLS = 20_000
SAMPLE_CHARS = 2000

SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _until(text: str, ends: str) -> int:
    return min((i for i in map(text.find, ends) if i >= 0), default=len(text))


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or a URL without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    n = _until(rest, "/?#")
    tail = rest[n:]
    return rest[:n].translate(_UPPER), tail[: _until(tail, "?#")]


@dataclass
class Rules:
    """Rules by host, so that a look-up costs a few probes however many there are."""

    verdicts: dict[str, str]

    def __post_init__(self) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule in self.verdicts:
            host, slash, rest = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + rest, rule))
        self.dots = max((h.count(".") for h in self.by_host), default=0)

    def match(self, host: str, path: str) -> str | None:
        """The longest rule whose host is `host` or a parent of it and whose path `path` starts with."""
        best = None
        # only ends of the host with as many labels as some rule has can be a rule's host
        labels = host.rsplit(".", self.dots + 1)
        for k in range(len(labels)):
            for start, rule in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best is None or (len(rule), rule) > (len(best), best)):
                    best = rule
        return best


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix")


def features(url: str | None, host: str, path: str, suffixes: dict[str, float], prior: float) -> list[float]:
    u = url or ""
    counts = Counter(u)
    n = len(u) or 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    query = u.partition("?")[2].partition("#")[0]
    return [
        len(u), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + 1 if host else 0,
        sum(counts.get(d, 0) for d in "0123456789") / n, entropy, query.count("&") + 1 if query else 0, u.count("-"), suffixes.get(host.rpartition(".")[2], prior),
    ]


@dataclass
class Trees:
    """Boosted trees of one depth: for each tree the features, thresholds and leaf values in heap order."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            raw += v[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Logistic gradient boosting over histograms of the features' quantiles. No randomness."""
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    base = math.log(mean / (1 - mean))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    raw = np.full(len(y), base)
    out = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-9
            gs, hs = g[mine].sum(), h[mine].sum()
            for k, c in enumerate(cuts):
                if not len(c) or not len(mine):
                    continue
                gl = np.cumsum(np.bincount(binned[mine, k], weights=g[mine], minlength=len(c) + 1))[: len(c)]
                hl = np.cumsum(np.bincount(binned[mine, k], weights=h[mine], minlength=len(c) + 1))[: len(c)]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, f[node], t[node] = gain[i], k, c[i]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > t[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + l2)
        raw += value[leaf]
        for keep, v in zip(out, (f, t, value), strict=True):
            keep.append(v)
    return Trees(base, depth, *map(np.array, out))


@dataclass
class Model:
    trees: Trees
    suffixes: dict[str, float]
    prior: float


def train(urls: list[str], rules: dict[str, str]) -> Model:
    """Trees trained on the URLs of `urls` that a rule decides; the label is the rule's verdict."""
    parsed, known = [(u, *split(u)) for u in urls], Rules(rules)
    decided = [(u, h, p, rules[r] == "block") for u, h, p in parsed if (r := known.match(h, p))]
    y = np.array([d[3] for d in decided], dtype=float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    seen, blocked = Counter(), Counter()
    for _, h, _, label in decided:
        seen[h.rpartition(".")[2]] += 1
        blocked[h.rpartition(".")[2]] += label
    suffixes = {s: (blocked[s] + 10 * prior) / (n + 10) for s, n in seen.items()}
    x = np.array([features(u, h, p, suffixes, prior) for u, h, p, _ in decided], dtype=float).reshape(-1, len(FEATURES))
    return Model(boost(x, y), suffixes, prior)


def judge(urls: list[str | None], model: Model, rules: Rules) -> list[tuple[str, str, str | None, str, float]]:
    parts = [split(u) for u in urls]
    x = np.array([features(u, h, p, model.suffixes, model.prior) for u, (h, p) in zip(urls, parts, strict=True)], dtype=float).reshape(-1, len(FEATURES))
    scores = model.trees.score(x).tolist()
    out = []
    for (h, p), s in zip(parts, scores, strict=True):
        rule = rules.match(h, p)
        out.append((h, p, rule, rules.verdicts[rule] if rule else "block" if s >= 0.5 else "allow", s))
    return out


def sample(plain: DataFrame, rules: dict[str, str], sample_urls: int = SAMPLE_URLS) -> list[str]:
    """At most `sample_urls` distinct URLs that some rule may decide, by a hash, the same ones every time. A hash threshold from
    their estimated number thins them first, so about twice as many reach the driver, however large the table is."""
    # a native test that keeps every URL that some rule may fit; train() applies the rules themselves
    may = F.lit(False)
    for rule in rules:
        may = may | F.lower("url").contains(rule.partition("/")[0].lower())
    some = plain.where(F.col("url").isNotNull() & (F.length("url") <= SAMPLE_CHARS) & may).select("url", F.xxhash64("url").alias("h"))
    n = some.agg(F.approx_count_distinct("h")).first()[0]
    span = 1 << 32
    if n > 2 * sample_urls:
        some = some.where(F.pmod("h", F.lit(span)) < F.lit(2 * sample_urls * span // n))
    return [r.url for r in some.distinct().orderBy("h", "url").limit(sample_urls).collect()]


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, sample_urls: int = SAMPLE_URLS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict and the trees' score.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins. The trees judge what
    no rule fits (block from a score of 0.5). A null URL, or one without '://', has an empty host and path, and is
    judged by the trees. Where the rules decide no URL, the trees are a constant of even odds, and block.
    Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    ready(spark)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    drawn = sample(plain, rules, sample_urls)
    model = train(drawn, rules)
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column(1).to_pylist(), model, known)
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return plain.mapInArrow(run, SCHEMA)

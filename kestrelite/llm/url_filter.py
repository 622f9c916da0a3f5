"""URL filters: path rules, then naive Bayes over host names split into words.

A rule names a host (and all its subdomains) and the start of a path; the longest that fits decides. Other urls are judged by
the method: host labels and path pieces are split into words by unigram Viterbi, whose word counts come from all pages'
texts, and a multinomial naive Bayes over these words gives the verdict. It learns from hosts that hold a seed word, as
blocked, and from all other urls that no rule blocks, as allowed; what a rule blocks says nothing about other hosts.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; repeated rows are
judged alike; with nothing to learn from, everything unruled is allowed; only the named columns are read; an empty table
gives an empty result. Very long urls take time linear in their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words that mark a host as one to block when they are among its split words.
SEEDS = frozenset("adult porn sex xxx casino bet bets betting poker gambling pills viagra warez crack torrent spam ads adserver track tracker tracking escort dating loans".split())
#: Words of the language model and of the classifier: the most frequent ones. Longest word that is tried.
VOCABULARY, FEATURES, LONGEST = 50_000, 50_000, 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the rules use them."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Rules:
    """Rules by host, so that a url costs its number of labels, not of rules."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host[host].append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        labels, found = host.split("."), []
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start):
                    found.append((len(rule), rule, verdict))
        return max(found)[1:] if found else None


class Splitter:
    """Unigram Viterbi segmentation with an unknown-word cost that grows with length."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 2.0
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - LONGEST), j):
                c = best[i] + self.cost.get(name[i:j], self.unknown + 2.5 * (j - i))
                if c < best[j]:
                    best[j], back[j] = c, i
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[name] = words[::-1]
        return self.known[name]


def tokens(host: str, path: str, splitter: Splitter) -> list[str]:
    """Features of a url: the split words of host labels (less the last) and of path pieces; numbers are one token."""
    out = []
    for label in host.split(".")[:-1]:
        for piece in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", label):
            out += [f"h:{w}" for w in splitter.split(piece)] if piece and not piece.isdigit() else ["h:#"] * bool(piece)
    for piece in re.split(r"[^a-z0-9]+", path.translate(_LOWER)):
        if piece:
            out += ["p:#"] if piece.isdigit() else [f"p:{w}" for w in splitter.split(piece)]
    return out


class Bayes:
    """Multinomial naive Bayes from counts by (token, verdict)."""

    def __init__(self, counts: dict[tuple[str, str], int], urls: dict[str, int]) -> None:
        words = Counter()
        for (w, _), n in counts.items():
            words[w] += n
        self.words = {w for w, _ in words.most_common(FEATURES)}
        total = {v: sum(n for (w, u), n in counts.items() if u == v and w in self.words) for v in ("allow", "block")}
        self.log = {(w, v): math.log((counts.get((w, v), 0) + 1) / (total[v] + len(self.words))) for w in self.words for v in total}
        n = sum(urls.values())
        self.prior = {v: math.log((urls.get(v, 0) + 1) / (n + 2)) for v in total}
        self.both = all(urls.get(v) for v in total)

    def odds(self, words: list[str]) -> float:
        """Log odds that a url is to block."""
        known = [w for w in words if w in self.words]
        score = {v: self.prior[v] + sum(self.log[w, v] for w in known) for v in self.prior}
        return score["block"] - score["allow"] if self.both else -1.0


def word_counts(pages: DataFrame, html: str = "html", url: str = "url") -> dict[str, int]:
    """Counts of lower-case words over all pages' texts and urls; the ``VOCABULARY`` most frequent."""
    text = F.lower(F.concat_ws(" ", F.regexp_replace(F.col(html), r"<[^>]*>", " "), F.col(url)))
    words = pages.select(F.explode(F.split(text, r"[^a-z]+")).alias("w")).where((F.length("w") >= 2) & (F.length("w") <= LONGEST))
    # written, so that executors merge the partitions' lists; a direct collect would send each of them to the driver
    top = written(words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(VOCABULARY), "vocabulary")
    return {r["w"]: r["count"] for r in top.collect()}  # a bounded vocabulary


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, host, path, rule, verdict, odds (the method's log odds for block), words (the split host and path)."""
    spark = pages.sparkSession
    arrow_batches(spark)
    counts = spark.sparkContext.broadcast(word_counts(pages, html, url))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, splitter, seen = Rules(rules), Splitter(counts.value), Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, v, n) for (w, v), n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["token", "verdict", "n"])

        for batch in batches:
            for u in batch.column(0).to_pylist():
                host, path = parts(u)
                if host:
                    words = tokens(host, path, splitter)
                    bad = any(w[2:] in SEEDS for w in words if w[0] == "h")
                    rule = own.match(host, path)
                    verdict = "block" if bad else None if rule and rule[1] == "block" else "allow"
                    if verdict:
                        seen.update((w, verdict) for w in words)
                        seen["", verdict] += 1
            if len(seen) > 100_000:
                yield flush()
        if seen:
            yield flush()

    learnt = pages.select(url).mapInArrow(learn, "token string, verdict string, n long")
    learnt = written(learnt.groupBy("token", "verdict").agg(F.sum("n").alias("n")), "url-tokens")
    top = learnt.groupBy("token").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "token").limit(FEATURES)
    rows = learnt.join(F.broadcast(top), "token").select("token", "verdict", "n").collect()  # a bounded vocabulary
    bayes = spark.sparkContext.broadcast(({(r[0], r[1]): r[2] for r in rows if r[0]}, {r[1]: r[2] for r in rows if not r[0]}))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, splitter, model = Rules(rules), Splitter(counts.value), Bayes(*bayes.value)
        for batch in batches:
            out = []
            for u in batch.column(1).to_pylist():
                host, path = parts(u)
                rule = own.match(host, path) if host else None
                words = tokens(host, path, splitter) if host else []
                odds = model.odds(words) if words else -1.0
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else "block" if odds > 0 else "allow", odds, " ".join(words)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.string()] * 4, pa.float64(), pa.string()))] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "host", "path", "rule", "verdict", "odds", "words"])

    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, odds double, words string")

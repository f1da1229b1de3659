"""URL filtering: longest matching rule, else a naive Bayes verdict on segmented host and path words.

Host labels are split into words by unigram Viterbi; the words and the path's tokens are scored by a
multinomial naive Bayes model that is trained on the URLs that the rules decide.  Tokens that the rules
themselves test (the top-level domain, words of their hosts, path parts of theirs) are left out of the
model: it would only learn the rules again and apply them where they do not hold.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table

# fixed values: the rules (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Expected labelled URLs that the verdict model is learnt from.
LABELLED = 50_000
#: No host label, so no word in one, is longer; and the pseudo-count of a token.
LONGEST_WORD, ALPHA = 63, 1.0

_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host and path together; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the split of a name into words with the highest probability."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        """Counts of words; ``total`` is the count of all words where ``counts`` leaves some out."""
        total = (sum(counts.values()) if total is None else total) + 1.0
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / total)
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return _segmenter, (self.log, self.unknown)

    def _word(self, w: str) -> float:
        # an unknown word costs a factor 10 for each further letter
        return self.log.get(w, self.unknown - 2.3 * (len(w) - 1))

    def _split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            best.append(max((best[start][0] + self._word(name[start:end]), start) for start in range(max(0, end - LONGEST_WORD), end)))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str, rules=()) -> list[str]:
        """h: words of host labels but the last, p: path tokens (numbers as #), without what ``rules`` test."""
        tested, first = _tested(tuple(rules))
        labels = [x for x in host.split(":")[0].split(".")[:-1] if x not in tested]
        words = [f"h:{w}" for label in labels for part in _TOKEN.findall(label) for w in (self.split(part) if part.isalpha() else "#")]
        parts = path.lower().split("/")
        if len(parts) > 1 and parts[1] in first:
            parts[1] = ""
        return words + [f"p:{'#' if t.isdigit() else t}" for part in parts for t in _TOKEN.findall(part)]


@lru_cache
def _tested(rules: tuple) -> tuple[frozenset[str], frozenset[str]]:
    """Host labels and first path parts that the rules test."""
    return frozenset(x for _, h, _ in rules for x in h.split(".")), frozenset(p.strip("/").split("/")[0].lower() for *_, p in rules if p.strip("/"))


def _segmenter(log: dict[str, float], unknown: float) -> Segmenter:
    """A segmenter as it was pickled, with an empty cache."""
    out = Segmenter({})
    out.log, out.unknown = log, unknown
    return out


class NaiveBayes:
    """Multinomial, with additive smoothing; classes are ``block`` and ``allow``."""

    def __init__(self, counts: dict[tuple[str, str], int], documents: dict[str, int]):
        words = {t for _, t in counts}
        self.score: dict[str, float] = {}
        total = {c: sum(n for (k, _), n in counts.items() if k == c) for c in ("block", "allow")}
        seen = sum(documents.values())
        self.prior = math.log((documents.get("block", 0) + ALPHA) / (documents.get("allow", 0) + ALPHA)) if seen else -1.0
        for t in words:
            p, q = ((counts.get((c, t), 0) + ALPHA) / (total[c] + ALPHA * len(words)) for c in ("block", "allow"))
            self.score[t] = math.log(p / q)

    def odds(self, tokens: list[str]) -> float:
        """Log odds of ``block``."""
        return self.prior + sum(self.score.get(t, 0.0) for t in tokens)


def learn_words(texts: Column, pages: DataFrame) -> Segmenter:
    """Word counts of all pages (words of 2 to LONGEST_WORD letters); only words that some host of ``url`` holds are kept.

    No other word can be looked up, so hosts split as with the counts of every word."""
    text = F.regexp_replace(F.lower(F.coalesce(texts, F.lit(""))), r"(?s)<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(rf"\b[a-z]{{2,{LONGEST_WORD}}}\b"), 0)).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    runs = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("[a-z]{2,}"), 0)).alias("run")).distinct().withColumn("size", F.length("run"))
    starts = runs.select("run", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("start"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), F.col("size") - F.col("start") + 1))
    held = starts.select(F.explode(F.transform(sizes, lambda k: F.substring("run", F.col("start"), k))).alias("word")).distinct()
    return Segmenter({r["word"]: float(r["n"]) for r in counts.join(held, "word", "left_semi").collect()}, float(total))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, host, path, rule, verdict, odds.

    A null URL or one without ``://`` has empty host and path; no rule fits it, and the model decides
    by its prior, as it does for an empty host without path tokens.  Odds of exactly 0 allow.  Without any URL
    that a rule decides, the model allows.  Repeated rows and null ids
    give a row each; other columns are not read."""
    prepare(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = base.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))

    words = learn_words(F.col("html"), pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")))
    decided = {r["ruled"]: r["count"] for r in rows.where("ruled IS NOT NULL").groupBy("ruled").count().collect()}
    share = int(min(1.0, LABELLED / max(1, sum(decided.values()))) * (1 << 30))
    sample = rows.where((F.col("ruled").isNotNull()) & (F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 30)) < share))

    def tokens(batches):
        for b in batches:
            what, token = [], []
            for v, h, p in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = words.tokens(h, p, rules)
                token += found
                what += [v] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(token, pa.string())], names=["verdict", "token"])

    counts = map_arrow(sample.select("ruled", "host", "path"), tokens, "verdict string, token string").groupBy("verdict", "token").agg(F.count("*").alias("n"))
    # every token of the sample: a token may not lose the row of one class
    model = NaiveBayes({(r["verdict"], r["token"]): r["n"] for r in counts.collect()}, decided)

    def judge(batches):
        for b in batches:
            odds = [model.odds(words.tokens(h, p, rules)) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            made = [v or ("block" if o > 0 else "allow") for v, o in zip(b.column(4).to_pylist(), odds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.string()), pa.array(odds, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "odds"])

    out = map_arrow(rows, judge, "page_id long, host string, path string, rule string, verdict string, odds double")
    return out.withColumnRenamed("page_id", id_col)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))

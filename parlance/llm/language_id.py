"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed character trigrams.  A document's language proportions
are estimated by expectation-maximisation; the set of languages is the one with the best penalised
likelihood among the nested sets of its most probable languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_arrow, prepare, read_table, stored

#: Hash buckets of trigrams; expected training documents of a language; pseudo-count of a bucket.
BUCKETS, PER_LANGUAGE, SMOOTH = 1 << 15, 2000, 0.5
#: Expected training documents of all languages together: with very many languages, each gets fewer of them.
ROWS = 1_000_000
#: Languages up to which a model is held as a full table; beyond, only the buckets that a language has are held.
DENSE = 256
#: EM rounds, and the penalty of each further language in units of log(n)/2 (trigrams overlap and
#: repeat, so n counts far more evidence than there is).
ROUNDS, PENALTY = 25, 12.0
UNKNOWN = "und"

# letters of any script stay; ASCII that is no letter becomes a space
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the letters of a lower-cased text, with their counts."""
    b = _CLASS[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    h = (h * np.uint32(2654435761)) >> np.uint32(17)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


class Mixture:
    """Languages and their trigram distributions: ``counts`` holds (buckets, counts) of each language."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.total = np.array([n.sum() for _, n in counts], dtype=np.float64) + SMOOTH * BUCKETS
        self.p: np.ndarray | None = None
        if len(languages) <= DENSE:
            self.p = np.full((len(languages), BUCKETS), SMOOTH)
            for row, (at, n) in zip(self.p, counts):
                row[at] += n
            self.p /= self.total[:, None]
            return
        bucket = np.concatenate([at for at, _ in counts])
        order = np.argsort(bucket, kind="stable")
        self.language = np.repeat(np.arange(len(counts), dtype=np.int32), [len(at) for at, _ in counts])[order]
        self.count = np.concatenate([n for _, n in counts])[order].astype(np.float32)
        self.first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The probabilities of buckets ``at``, a row a language."""
        if self.p is not None:
            return self.p[:, at]
        p = np.full((len(self.languages), len(at)), SMOOTH)
        for k, bucket in enumerate(at):
            lo, hi = self.first[bucket], self.first[bucket + 1]
            p[self.language[lo:hi], k] += self.count[lo:hi]
        return p / self.total[:, None]

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        pi, total = np.full(len(p), 1 / len(p)), n.sum()
        for _ in range(rounds):
            new = pi * (p @ (n / (pi @ p))) / total
            if np.abs(new - pi).max() < 1e-4:
                pi = new
                break
            pi = new
        return pi, float(n @ np.log(pi @ p))

    def infer(self, text: str | None) -> dict[str, float]:
        """Proportions of the chosen languages; empty if the text has no letter."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return {}
        at, n = trigrams(text)
        if not len(at):
            return {}
        p = self.rows(at)
        pi, _ = self._em(p, n, ROUNDS)
        order = np.argsort(-pi, kind="stable")
        cost = PENALTY * 0.5 * np.log(max(n.sum(), 2))
        best, found = float(n @ np.log(p[order[0]])), (order[:1], np.ones(1))
        for k in range(2, len(order) + 1):
            if pi[order[k - 1]] < 0.02:
                break
            share, fit = self._em(p[order[:k]], n, ROUNDS)
            if fit - cost * (k - 1) > best:
                best, found = fit - cost * (k - 1), (order[:k], share)
        return {self.languages[i]: float(s) for i, s in zip(*found)}

    def best(self, text: str | None) -> tuple[str, float]:
        share = self.infer(text)
        if not share:
            return UNKNOWN, 0.0
        lang = max(sorted(share), key=share.get)
        return lang, min(1.0, share[lang])


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int = PER_LANGUAGE, most: int = ROWS) -> Mixture:
    """Fit on a sample with about ``per_language`` documents of each language, and ``most`` of all, chosen by their ids' hash.

    Every value of ``lang`` is learnt, however rare: the sample takes all documents of a rare one.  Counts are
    summed on the executors; the driver gets a row a language.  Of languages with equal proportions the first
    by code point is predicted."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("size")).select(F.col("lang").alias("of"), "size"))  # its size on disk tells Spark whether to send it
    each = min(per_language, max(1, most // max(1, sizes.count())))
    share = (F.least(F.lit(1.0), F.lit(float(each)) / F.col("size")) * (1 << 30)).cast("long")
    sample = rows.join(sizes, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)

    def count(batches):
        for b in batches:
            total: dict[str, np.ndarray] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = trigrams(text)
                total.setdefault(lang, np.zeros(BUCKETS))[at] += n
            for lang, v in total.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(v[at])], names=["lang", "bucket", "n"])

    counts = map_arrow(sample.select("text", "lang"), count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).join(sizes, F.col("lang") == F.col("of"), "right")
    found = sorted(((r["of"], np.array(r["at"] or [], dtype=np.int64), np.array(r["n"] or [], dtype=np.float64)) for r in packed.collect()), key=lambda x: x[0])  # a row a language, of BUCKETS numbers at most
    return Mixture([f[0] for f in found], [f[1:] for f in found])


def held_out(id_col: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text leaves 1 when divided by 3; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and lang_set (the chosen languages with their proportions) to ``docs``.

    A null text or one without letters is ``und`` with score 0; so is every text when nothing was
    learnt.  Columns of ``docs`` with one of the three names are replaced; repeated rows, null ids
    and other columns pass unchanged."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "lang_set")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_set", StringType())])
    at = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            found = []
            for text in b.column(at).to_pylist():
                share = model.infer(text)
                lang = max(sorted(share), key=share.get) if share else UNKNOWN
                found.append((lang, min(1.0, share.get(lang, 0.0)), ",".join(f"{k}:{v:.4f}" for k, v in sorted(share.items()))))
            cols = list(zip(*found)) if found else [()] * 3
            extra = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lang_pred", "score", "lang_set"])

    return map_arrow(docs, work, schema)


def fit(docs: DataFrame) -> Mixture:
    return learn(docs.where(~held_out()), "text", "lang", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = identify(rows, fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_set")

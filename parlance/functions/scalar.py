"""Scalar column expressions.  All are built-in expressions and stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Trim all white space at the ends and turn runs inside into one space."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def parse_timestamp(c: Column | str) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or ``S``; null where a part is no number."""
    p = F.split(strip(c), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2)).otherwise(part(1))


def render_window(utterances: Column | str) -> Column:
    """``[speaker] (12.0s): text`` a line."""
    return F.array_join(F.transform(col(utterances), lambda u: F.format_string("[%s] (%.1fs): %s", u["speaker_id"], u["start_time"], u["text"])), "\n")


def speaker_set(utterances: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(col(utterances), lambda u: u["speaker_id"])))


def preview(c: Column | str, n: int = 200) -> Column:
    return F.left(col(c), F.lit(n))


def normalize_relation(c: Column | str) -> Column:
    return F.regexp_replace(strip(F.lower(col(c))), r"\s+", "_")


def normalize_entity(name: Column | str, kind: Column | str) -> Column:
    """Persons lose one leading title; white space is squeezed."""
    return squeeze(F.when(col(kind) == "PERSON", F.regexp_replace(strip(name), schema.TITLE, "")).otherwise(strip(name)))


def soundex_code(c: Column | str) -> Column:
    """American Soundex of the letters; the empty string without any."""
    letters = F.regexp_replace(F.lower(col(c)), "[^a-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; 1 if equal, 0 if one is empty or the lengths differ by more than half."""
    a, b = col(a), col(b)
    longer, gap = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    apart = F.lit(0.0)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0) | (gap * 2 > longer), apart).otherwise(1.0 - F.levenshtein(a, b).cast("double") / longer)


def stated_at(date: Column | str, seconds: Column | str) -> Column:
    """Midnight of an ISO date plus seconds; null for a blank or invalid date."""
    day = F.try_to_date(col(date), "yyyy-MM-dd").cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(seconds).cast("decimal(18,6)"))


def confidence_bucket(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 0.9, "high (≥0.9)").when(c >= 0.7, "medium (0.7-0.9)").when(c >= 0.5, "low (0.5-0.7)").otherwise("very low (<0.5)")


def cited_time(cited: Column | str, first: Column | str, last: Column | str) -> Column:
    """A cited time that lies in its window (with a second to spare), else the window's start."""
    t = col(cited).cast("string").try_cast("double")
    return F.when(t.between(col(first), col(last) + 1.0), t).otherwise(col(first))


def iso_date(c: Column | str) -> Column:
    return F.when(strip(c).rlike(schema.ISO_DATE), strip(c)).otherwise("")


def node_label_ok(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(schema.NODE_LABEL), F.lit(False))


def is_placeholder(c: Column | str) -> Column:
    return strip(c).rlike(schema.PLACEHOLDER)


def strip_fences(c: Column | str) -> Column:
    """Lines that begin a Markdown code fence go."""
    return F.array_join(F.filter(F.split(col(c), "\n"), lambda line: ~F.ltrim(line).startswith("```")), "\n")


def gold_label(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(col(c), F.lit(1)), F.lit("unanswerable"))


def is_multilabel(c: Column | str) -> Column:
    return F.coalesce(F.size(col(c)) > 1, F.lit(False))


def cache_key(text: Column, pairs: Column, model: Column, version: Column) -> Column:
    """sha256 over text, pairs (array of structs x, y), model and version, a line each."""
    return F.sha2(F.concat_ws("\n", text, F.array_join(F.transform(pairs, lambda p: F.concat(p["x"], F.lit("::"), p["y"])), "|"), model, version), 256)


def label_hash(labels: Column | str) -> Column:
    """16 hex digits over an array of integer labels."""
    return F.left(F.sha2(F.array_join(col(labels).cast("array<string>"), ","), 256), F.lit(16))


def base_url(model: Column | str) -> Column:
    return F.when(col(model).startswith("gemini"), "gemini").otherwise("openai")


def norm_text(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"\s+", " ")


def is_non_answer(c: Column | str) -> Column:
    a = norm_text(c)
    out = F.lit(False)
    for phrase in schema.NON_ANSWERS:
        out = out | a.contains(phrase)
    return out


def grade(answer: Column | str, groups: list[list[str]]) -> Column:
    """True if the answer answers, and has an alternative of every group."""
    a, ok = norm_text(answer), ~is_non_answer(answer)
    for group in groups:
        hit = F.lit(False)
        for alternative in group:
            hit = hit | a.contains(" ".join(alternative.lower().split()))
        ok = ok & hit
    return ok


# --- arrays of numbers

def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(F.transform(a, lambda y: F.exp(y - top))))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    return F.transform(a, lambda x: x - top - F.log(total(F.transform(a, lambda y: F.exp(y - top)))))


def masked(a: Column, mask: Column) -> Column:
    """Entries outside the mask get the least double, so that they never win and weigh nothing."""
    return F.zip_with(a, mask, lambda x, m: F.when(m, x).otherwise(F.lit(-1.7976931348623157e308)))


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(1e-300)))))


def entropy_fraction(p: Column) -> Column:
    return entropy(p) / F.log(F.size(p).cast("double"))


def features(*parts: Column) -> Column:
    """The parts of a feature vector, one after the other; null if a part is null."""
    return F.concat(*[p.cast("array<double>") for p in parts])


def pick(a: Column, index: list[int]) -> Column:
    return F.array(*[F.element_at(a, i + 1) for i in index])


def distillation_loss(student: Column, teacher: Column, weight: Column, focal: Column, old: list[int]) -> Column:
    """A sample's -sum_j w_j * focal * teacher_j * log student_j over the old classes; average it over the batch."""
    t, q = softmax(pick(teacher, old)), log_softmax(pick(student, old))
    return -total(F.zip_with(F.zip_with(weight, t, lambda w, x: w * x), q, lambda wt, x: wt * x)) * focal


def focal_factor(student: Column, label: Column, gamma: float) -> Column:
    return F.pow(1.0 - F.element_at(softmax(student), label.cast("int") + 1), gamma)

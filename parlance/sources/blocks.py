"""Typed key-value blocks in texts: what a block says, and every way in which it is wrong, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx

PAIR = r"^\s*([A-Za-z0-9_]+)\s*=\s*(.+?)\s*$"


def block_spec(spark: SparkSession, keys: list[tuple] = schema.SCORING_KEYS) -> DataFrame:
    """key, kind, allowed, low, high of each key.  Kinds: number, flag (yes or no), word (one of ``allowed``),
    partly (one of ``allowed``, or ``partly:`` and a list of names of ``schema.SCORED_CONDITIONS``)."""
    return spark.createDataFrame(keys, "key string, kind string, allowed array<string>, low double, high double")


def block_lines(texts: DataFrame, section: str = schema.SCORING_SECTION) -> DataFrame:
    """doc, found, pos, key, value: the pairs that follow the line ``section:`` up to the first line that is none.

    ``texts``: doc, text.  A text without the section keeps a row of its own with found = false; one whose
    section is empty has a row without a key."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    start = F.array_position(F.transform(lines, lambda x: F.trim(x) == f"{section}:"), True)
    rest = F.slice(lines, F.greatest(start + 1, F.lit(1)).cast("int"), F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(PAIR)), False)
    body = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
    rows = texts.select("doc", (start > 0).alias("found"), F.posexplode_outer(F.when(start > 0, body)).alias("pos", "line"))
    return rows.select("doc", "found", "pos", F.regexp_extract("line", PAIR, 1).alias("key"), F.regexp_extract("line", PAIR, 2).alias("value"))


def _number(value: Column) -> Column:
    """A number; a minus sign of typesetting and a percent sign at the end are taken."""
    text = F.regexp_replace(F.replace(value, F.lit("−"), F.lit("-")), "%+$", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def read_blocks(texts: DataFrame, spec: DataFrame, section: str = schema.SCORING_SECTION) -> tuple[DataFrame, DataFrame]:
    """(values, problems) of the blocks of ``texts``.

    values: doc, key, kind, number, flag, word, names (sorted) of the pairs that are right.  problems: doc, key,
    problem, value, a row for each; key is null for ``no block``.  Of a key that is given twice the first
    value is checked too.  ``spec`` is a row a key, and is sent to the texts."""
    rows = block_lines(texts, section)
    seen = rows.where("key <> ''").groupBy("doc", "key").agg(F.min_by("value", "pos").alias("value"), F.count("*").alias("n"))
    docs = rows.where("found").select("doc").distinct()
    want = docs.crossJoin(F.broadcast(spec))  # a row a key of the block
    met = want.join(seen, ["doc", "key"], "left")
    number = _number(F.col("value"))
    names = F.array_sort(F.transform(F.split(F.regexp_extract("value", r"^partly:\s*(.+)$", 1), ","), lambda n: fx.strip(n)))
    listed = F.forall(names, lambda n: n.isin(schema.SCORED_CONDITIONS))
    kind, word = F.col("kind"), F.array_contains("allowed", F.col("value"))
    bad = (
        F.when(F.col("n").isNull(), "missing")
        .when((kind == "number") & number.isNull(), "not a number")
        .when((kind == "number") & ((number < F.col("low")) | (number > F.col("high"))), "out of range")
        .when((kind == "flag") & ~F.col("value").isin("yes", "no"), "not yes or no")
        .when((kind == "word") & ~word, "not allowed")
        .when((kind == "partly") & ~word & ~F.col("value").rlike(r"^partly:\s*\S"), "not allowed")
        .when((kind == "partly") & ~word & ~listed, "no such condition")
    )
    checked = met.withColumn("bad", bad)
    values = checked.where("bad IS NULL").select(
        "doc", "key", "kind", F.when(kind == "number", number).alias("number"), F.when(kind == "flag", F.col("value") == "yes").alias("flag"),
        F.when((kind == "partly") & ~word, "partly").when(kind.isin("word", "partly"), F.col("value")).alias("word"), F.when((kind == "partly") & ~word, names).alias("names"),
    )
    problems = checked.where("bad IS NOT NULL").select("doc", "key", F.col("bad").alias("problem"), "value")
    problems = problems.union(seen.where("n > 1").select("doc", "key", F.lit("given twice"), "value"))
    problems = problems.union(seen.join(F.broadcast(spec.select("key")), "key", "left_anti").select("doc", "key", F.lit("unknown"), "value"))
    lost = rows.where("NOT found").select("doc", F.lit(None).cast("string"), F.lit("no block"), F.lit(None).cast("string"))
    return values, problems.union(lost)


def blanks(texts: DataFrame, marks: list[str] = schema.BLANKS) -> DataFrame:
    """doc, mark: the places left to fill in that a text still has."""
    return texts.select("doc", F.explode(F.filter(F.array(*map(F.lit, marks)), lambda m: F.col("text").contains(m))).alias("mark"))

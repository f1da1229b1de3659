"""A dictionary tagger, and the prompts that an external extractor would get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TAGGER_TYPES


def tag_words(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """key, pos, text, type: the words of a text that the dictionary (word, type) knows, cases aside."""
    words = texts.select(key, F.posexplode(F.split(F.col(text), r"\s+")).alias("pos", "raw"))
    words = words.select(key, "pos", F.regexp_replace("raw", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("text")).where("text <> ''")
    known = dictionary.select(F.lower("word").alias("_w"), F.col("type"))
    return words.join(known, F.lower("text") == F.col("_w")).select(key, "pos", "text", "type")


def map_type(tag: Column | str) -> Column:
    """Tagger types -> entity types; others are topics."""
    out = F.lit("TOPIC")
    for source, target in TAGGER_TYPES.items():
        out = F.when((F.col(tag) if isinstance(tag, str) else tag) == source, target).otherwise(out)
    return out


def extraction_prompt(meeting_date: Column, window_text: Column) -> Column:
    """The window, after a line with the meeting's date where there is one."""
    date = F.when(F.coalesce(meeting_date, F.lit("")) != "", F.concat(F.lit("Meeting date: "), meeting_date))
    return F.concat_ws("\n", date, F.lit("Transcript:"), window_text)


def labelling_prompt(text: Column, pairs: Column, relations: Column) -> Column:
    """The dialogue, its numbered pairs and the legal relations."""
    lines = F.transform(pairs, lambda p, i: F.format_string("%d. %s -> %s", i, p["x"], p["y"]))
    return F.concat_ws("\n", text, F.lit("Pairs:"), F.array_join(lines, "\n"), F.concat(F.lit("Relations: "), F.array_join(relations, ", ")))

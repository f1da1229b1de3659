"""Template questions asked of the graph in sets: checked, repaired, broadened, searched and answered.

A question is keywords with the relations and meetings it is limited to.  It has a budget of attempts.  A
limit that the graph does not know is an error, which costs an attempt and is mended to the nearest known
name, relations first; a valid question without rows is broadened, step by step.  All attempts of all
questions are laid out as a table of rungs, and one pass over the edges finds the rows of every rung.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources.scratch import stored

# fixed values: what an answer says of results that are absent, wrong or cut
NO_RESULTS, ERROR, MORE = "No results found.", "Query error: ", "NOTE: these are the first %d matching facts, oldest first, and there are more; the most recent are missing."


def nearest_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(name, nearest) for each distinct ``wanted`` name that is not ``known``: the known name at the least edit
    distance, cases aside, the smallest of equals.  The few unknown names meet all known ones; the least is kept map-side."""
    lost = wanted.select("name").distinct().join(known.select("name"), "name", "left_anti")
    met = lost.crossJoin(known.select(F.col("name").alias("other")).distinct())
    return met.groupBy("name").agg(F.min(F.struct(F.levenshtein(F.lower("name"), F.lower("other")), "other")).alias("m")).select("name", F.col("m.other").alias("nearest"))


def _mend(questions: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """question_id, the names of ``column`` mended, and ``unknown``: the first name, in order, that is not known."""
    asked = questions.select("question_id", F.posexplode(column).alias("pos", "name"))
    rows = asked.join(nearest_names(asked, known), "name", "left")
    cell = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("nearest", "name").alias("n"))))
    return rows.groupBy("question_id").agg(F.transform(cell, lambda c: c["n"]).alias(f"{column}_mended"), F.min_by("name", F.when(F.col("nearest").isNotNull(), F.col("pos"))).alias(f"{column}_unknown"))


def ladder(questions: DataFrame, edges: DataFrame, attempts: int = schema.MAX_ATTEMPTS) -> DataFrame:
    """A row an attempt: question_id, attempt, action, error, keywords, relations, meetings.

    ``questions``: question_id (unique), keywords, relations, meetings, arrays of text; null or empty limits
    are none.  action: asked, repaired or broadened.  Rungs with an error are not searched.  Broadening drops
    the relations, then asks for single words of the keywords in all meetings.  In an empty graph no name is
    near, so names stay as they are."""
    empty = F.array().cast("array<string>")
    q = questions.select("question_id", *[F.coalesce(F.col(c).cast("array<string>"), empty).alias(c) for c in ("keywords", "relations", "meetings")])
    q = q.join(_mend(q, "relations", edges.select(F.col("type").alias("name")).distinct()), "question_id", "left")
    q = q.join(_mend(q, "meetings", edges.select(F.col("source_meeting").alias("name")).distinct()), "question_id", "left")
    told = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"unknown {kind} "), F.col(c)))
    q = q.withColumn("errors", F.array_compact(F.array(told("relation", "relations_unknown"), told("meeting", "meetings_unknown"))))
    r = q.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("level", F.col("attempt") - F.size("errors") - 1)
    wrong = F.col("level") < 0
    mended = lambda c, once: F.when(once, F.coalesce(f"{c}_mended", empty)).otherwise(F.col(c))
    relations = mended("relations", ~wrong | (F.col("attempt") > F.when(F.col("relations_unknown").isNotNull(), 1).otherwise(0)))
    words = F.array_distinct(F.flatten(F.transform("keywords", lambda k: F.split(F.trim(k), " +"))))
    action = F.when(F.col("attempt") == 1, "asked").when(F.col("level") >= 1, "broadened").otherwise("repaired")
    return r.select(
        "question_id", "attempt", action.alias("action"), F.try_element_at("errors", F.col("attempt")).alias("error"),
        F.when(F.col("level") >= 2, words).otherwise(F.col("keywords")).alias("keywords"),
        F.when(F.col("level") >= 1, empty).otherwise(relations).alias("relations"),
        F.when(F.col("level") >= 2, empty).otherwise(mended("meetings", ~wrong)).alias("meetings"),
    )


def _holds(words: Column, a: str, b: str) -> Column:
    """Either name contains a word, cases aside."""
    return F.exists(words, lambda w: F.lower(a).contains(F.lower(w)) | F.lower(b).contains(F.lower(w)))


def search(edges: DataFrame, rungs: DataFrame, cap: int = schema.ROW_CAP) -> DataFrame:
    """question_id, attempt, place (from 1) and the edge: the first ``cap`` rows in time of each question's first rung that has any.

    ``rungs`` should be stored: Spark then knows its size and sends it to the edges, or deals both.  Rows
    beyond the cap are dropped in each task before they move."""
    live = rungs.where("error IS NULL").select("question_id", "attempt", "keywords", F.col("relations").alias("only"), F.col("meetings").alias("within"))
    limited = lambda c, value: (F.size(c) == 0) | F.array_contains(c, F.col(value))
    met = edges.join(live, _holds(F.col("keywords"), "src", "dst") & limited("only", "type") & limited("within", "source_meeting"))
    w = Window.partitionBy("question_id", "attempt").orderBy(F.col("stated_at").asc_nulls_last(), "utterance_time", "edge_id")
    top = met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    first = F.min("attempt").over(Window.partitionBy("question_id"))  # ``cap`` rows an attempt
    return top.withColumn("first", first).where("attempt = first").select("question_id", "attempt", "place", "edge_id", "src", "dst", "type", "source_meeting", "stated_at")


def outcomes(rungs: DataFrame, found: DataFrame, cap: int = schema.ROW_CAP) -> DataFrame:
    """``rungs`` with rows_found (null: not tried), chosen and truncated; exactly ``cap`` rows count as truncated.

    Attempts after the chosen one are not made; if none finds a row, the last one is the chosen one."""
    n = found.groupBy("question_id", F.col("attempt").alias("at")).agg(F.count("*").alias("n"))
    last = F.max("attempt").over(Window.partitionBy("question_id"))
    r = rungs.withColumn("last", last).join(n, "question_id", "left").withColumn("at", F.coalesce("at", "last"))
    rows = F.when(F.col("attempt") > F.col("at"), F.lit(None)).when(F.col("error").isNotNull(), F.lit(None)).when(F.col("attempt") == F.col("at"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    chosen = F.col("attempt") == F.col("at")
    return r.select(*rungs.columns, rows.alias("rows_found"), chosen.alias("chosen"), (chosen & (F.coalesce("n", F.lit(0)) >= cap)).alias("truncated"))


def answers(tried: DataFrame, found: DataFrame, cap: int = schema.ROW_CAP) -> DataFrame:
    """question_id, attempt, n_rows, truncated, answer: a question's rows as one text, a line a fact in time order.

    The text tells what stands between it and a full answer: no rows, an error in the last attempt, a cut at
    the cap; ``history`` has what became of each earlier attempt.  A question has ``cap`` rows at most."""
    when = F.coalesce(F.concat(F.lit(", "), F.col("stated_at").cast("string")), F.lit(""))
    line = F.concat(F.format_string("%s -[%s]-> %s (%s", "src", "type", "dst", "source_meeting"), when, F.lit(")"))
    text = found.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("facts"))
    fate = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error"))).otherwise("no rows")
    earlier = F.when(~F.col("chosen") & (F.col("error").isNotNull() | F.col("rows_found").isNotNull()), F.struct("attempt", F.format_string("attempt %d %s", "attempt", fate).alias("t")))
    of = tried.groupBy("question_id").agg(
        F.max_by("attempt", F.col("chosen").cast("int")).alias("attempt"), F.coalesce(F.max(F.when(F.col("chosen"), F.col("rows_found"))), F.lit(0)).alias("n_rows"), F.max(F.when(F.col("chosen"), F.col("error"))).alias("error"),
        F.bool_or("truncated").alias("truncated"), F.array_join(F.transform(F.array_sort(F.collect_list(earlier)), lambda x: x["t"]), "; ").alias("history"),
    )
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR), "error")).otherwise(F.coalesce("facts", F.lit(NO_RESULTS)))
    note = F.when(F.col("truncated"), F.lit(MORE % cap))
    return of.join(text, "question_id", "left").select("question_id", "attempt", "n_rows", "truncated", "history", F.concat_ws("\n", body, note).alias("answer"))


def ask_all(edges: DataFrame, questions: DataFrame, cap: int = schema.ROW_CAP, attempts: int = schema.MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rungs with their outcome, rows, answers) of a table of questions."""
    rungs = stored(ladder(questions, edges, attempts), "rungs")
    found = stored(search(edges, rungs, cap), "found")
    tried = outcomes(rungs, found, cap)
    return tried, found, answers(tried, found, cap)

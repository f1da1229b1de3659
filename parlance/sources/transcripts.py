"""Transcript, dialogue and side-table scans.  Files are read whole by Spark's own readers and parsed
with column expressions; every row carries its file and position, so order is never implicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar as fx

# fixed values: the line formats, as the transcripts are written
LEGACY = r"(?i)^(SPEAKER[\s_]*\d+)\s*\(([^)]+?)\s*-\s*([^)]+?)\)\s*:\s*(.+)"
PLAIN = r"(?i)^speaker[\s_]*(\d+)\s*:\s*(.+)$"
SRT_SPEAKER = r"(?i)^\[?(SPEAKER[_ ]?\d+)\]?:?\s*"
#: A cue's two clocks: hours, minutes, seconds and a fraction after a comma or point.
CLOCK = r"(\d{1,2}(?::\d{2}){2}[.,]\d{1,3})"
SRT_TIME = CLOCK + r"\s*-->\s*" + CLOCK
#: A speaker's token has 12 characters at most, and text follows it on its line.
AMI_TURN = r"(?i)^(speaker\s+)?(\w{1,12})\s*:\s*(\S.*)$"
#: Folders of written transcripts.
FOLDERS = 64


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, stem, format, content (BOM removed) of text files."""
    df = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))
    return df.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("format"), "content")


def lines_of(files: DataFrame) -> DataFrame:
    """meeting_id, pos, line: stripped, non-empty lines."""
    rows = files.select(F.col("stem").alias("meeting_id"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw"))
    return rows.select("meeting_id", "pos", fx.strip("raw").alias("line")).where("line <> ''")


def _numbered(df: DataFrame) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("meeting_id").orderBy("pos")) - 1
    return df.select("meeting_id", seq.cast("int").alias("seq"), "speaker_id", "text", "start_time", "end_time")


def parse_legacy(lines: DataFrame) -> DataFrame:
    """``SPEAKER 00 (0:00:01 - 0:00:05): text``; other lines are skipped."""
    part = lambda i: F.regexp_extract("line", LEGACY, i)
    speaker = F.regexp_replace(F.upper(fx.strip(part(1))), " ", "_")
    rows = lines.where(F.col("line").rlike(LEGACY)).select("meeting_id", "pos", speaker.alias("speaker_id"), fx.strip(part(4)).alias("text"), fx.parse_timestamp(part(2)).alias("start_time"), fx.parse_timestamp(part(3)).alias("end_time"))
    return _numbered(rows.where("text <> ''"))


def _turns(lines: DataFrame, starts: Column, speaker: Column, text: Column, seconds: float) -> DataFrame:
    """Turns with a synthetic clock; a line that starts none joins the turn before, leading lines go."""
    w = Window.partitionBy("meeting_id").orderBy("pos")
    rows = lines.withColumn("starts", starts).withColumn("turn", F.sum(F.col("starts").cast("int")).over(w)).where("turn > 0")
    piece = F.struct("pos", F.when(F.col("starts"), text).otherwise(F.col("line")).alias("t"))
    out = rows.groupBy("meeting_id", "turn").agg(F.max(F.when(F.col("starts"), speaker)).alias("speaker_id"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    clock = (F.col("turn") - 1) * F.lit(seconds)
    return out.select("meeting_id", (F.col("turn") - 1).cast("int").alias("seq"), "speaker_id", F.array_join(F.transform("pieces", lambda p: p["t"]), " ").alias("text"), clock.alias("start_time"), (clock + seconds).alias("end_time"))


def parse_plain(lines: DataFrame, seconds: float = schema.SECONDS_PER_TURN) -> DataFrame:
    """``Speaker 0: text`` with a synthetic clock."""
    number = F.regexp_extract("line", PLAIN, 1).cast("int")
    text = fx.strip(F.regexp_extract("line", PLAIN, 2))
    return _turns(lines, F.col("line").rlike(PLAIN) & (text != ""), F.format_string("SPEAKER_%02d", number), text, seconds)


def parse_text(files: DataFrame, strict: bool = True) -> DataFrame:
    """Legacy layout where a file has any legacy line, else the plain one.

    A file without utterances raises in strict mode and gives no rows otherwise."""
    lines = lines_of(files)
    kind = lines.groupBy("meeting_id").agg(F.bool_or(F.col("line").rlike(LEGACY)).alias("legacy"))
    lines = lines.join(kind, "meeting_id")
    out = parse_legacy(lines.where("legacy")).union(parse_plain(lines.where("NOT legacy")))
    return _all_files(files, out) if strict else out


def _all_files(files: DataFrame, out: DataFrame) -> DataFrame:
    missing = [r["stem"] for r in files.select("stem").join(out.select(F.col("meeting_id").alias("stem")).distinct(), "stem", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"no utterances in {', '.join(missing)}")
    return out


def parse_srt(files: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks apart by blank lines; the first line with a time range gives the clock."""
    blocks = files.select(F.col("stem").alias("meeting_id"), F.posexplode(F.split(fx.strip("content"), r"\r?\n\s*\n")).alias("pos", "block"))
    block_lines = F.filter(F.transform(F.split("block", r"\r?\n"), fx.strip), lambda x: x != "")
    blocks = blocks.withColumn("lines", block_lines).where("size(lines) >= 2")
    timed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.rlike(SRT_TIME).alias("hit"))), lambda s: s["hit"])
    at = F.try_element_at(timed, F.lit(1))["i"]
    blocks = blocks.withColumn("at", at).where("at IS NOT NULL")
    time = F.element_at("lines", F.col("at") + 1)
    seconds = lambda i: fx.parse_timestamp(F.regexp_replace(F.regexp_extract(time, SRT_TIME, i), ",", "."))
    whole = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), " ")
    rows = blocks.select("meeting_id", "pos", whole.alias("whole"), seconds(1).alias("start_time"), seconds(2).alias("end_time"))
    label = F.regexp_replace(F.upper(F.regexp_extract("whole", SRT_SPEAKER, 1)), " ", "_")
    rows = rows.select("meeting_id", "pos", F.when(label == "", "UNKNOWN").otherwise(label).alias("speaker_id"), fx.strip(F.regexp_replace("whole", SRT_SPEAKER, "")).alias("text"), "start_time", "end_time")
    out = _numbered(rows.where("text <> ''"))
    return _all_files(files, out) if strict else out


def read_json_transcripts(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """Utterances of JSON files of one transcript each, on one line or several; ``lines``: of files with a transcript a line."""
    kind = "meeting_id STRING, audio_file STRING, duration DOUBLE, utterances ARRAY<STRUCT<speaker_id STRING, text STRING, start_time DOUBLE, end_time DOUBLE>>"
    rows = spark.read.schema(kind).json(paths, multiLine=not lines)
    return rows.select("meeting_id", F.posexplode("utterances").alias("seq", "u")).select("meeting_id", "seq", "u.speaker_id", "u.text", "u.start_time", "u.end_time")


def write_json_transcripts(utterances: DataFrame, path: str, lines: bool = False, folders: int = FOLDERS) -> None:
    """A file a meeting, in ``folders`` folders under ``path`` by a hash of the meeting; ``lines``: a line a meeting, in as many files as tasks.

    One task writes a folder, so that few folders are moved at the end and listed by readers.  Files themselves cost
    time, so that many meetings are better written as lines."""
    row = F.struct("seq", "speaker_id", "text", "start_time", "end_time")
    out = utterances.groupBy("meeting_id").agg(F.coalesce(F.max("end_time"), F.lit(0.0)).alias("duration"), F.array_sort(F.collect_list(row)).alias("utterances"))
    if lines:
        out.write.mode("overwrite").json(path)
        return
    dealt = out.withColumn("_folder", F.pmod(F.xxhash64("meeting_id"), F.lit(folders)).cast("int")).repartitionById(folders, "_folder")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("_folder").json(path)


def read_transcripts(spark: SparkSession, paths, prefer_srt: bool = True, strict: bool = True) -> DataFrame:
    """Dispatch by format: of a stem's files, ``.json`` first, then ``.srt`` (if preferred), then text."""
    files = read_files(spark, paths)
    rank = F.when(F.col("format") == "json", 0).when(F.col("format") == "srt", 1 if prefer_srt else 3).otherwise(2)
    best = files.withColumn("rank", F.row_number().over(Window.partitionBy("stem").orderBy(rank, "path"))).where("rank = 1").drop("rank")
    json_kind = "struct<meeting_id: string, utterances: array<struct<speaker_id: string, text: string, start_time: double, end_time: double>>>"
    js = best.where("format = 'json'").select(F.from_json("content", json_kind).alias("j")).select("j.meeting_id", F.posexplode("j.utterances").alias("seq", "u"))
    out = js.select("meeting_id", "seq", "u.speaker_id", "u.text", "u.start_time", "u.end_time")
    return out.union(parse_srt(best.where("format = 'srt'"), strict)).union(parse_text(best.where("format NOT IN ('json', 'srt')"), strict))


def parse_ami(lines: DataFrame, seconds: float = schema.SECONDS_PER_TURN) -> DataFrame:
    """``Speaker A: text`` or a short upper-case code; any other ``word:``, and a token without text, is prose."""
    token, said = F.regexp_extract("line", AMI_TURN, 2), F.regexp_extract("line", AMI_TURN, 1)
    code = (F.length(token) <= 4) & (token.rlike("^[^a-z]*[A-Z][^a-z]*$") | token.rlike("^[0-9]+$") | (F.length(token) == 1))
    starts = F.col("line").rlike(AMI_TURN) & ((said != "") | code)
    out = _turns(lines, starts, F.concat(F.lit("SPEAKER_"), F.upper(token)), fx.strip(F.regexp_extract("line", AMI_TURN, 3)), seconds)
    return out.withColumn("text", fx.strip("text")).where("text <> ''")


def parse_ami_files(files: DataFrame, strict: bool = True, seconds: float = schema.SECONDS_PER_TURN) -> DataFrame:
    """The dialogues of ``files`` (stem, content); with ``strict`` a file without a single turn is an error, which names it."""
    out = parse_ami(lines_of(files), seconds)
    return _all_files(files, out) if strict else out


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, no (from 1), line of text files of any size: files are read in splits, line by line.

    A split's lines come in order; a line's number is its place in its split, and the lines of the splits
    before it.  Only a row a split is counted, so no task and no string holds a file."""
    raw = spark.read.text(paths)
    meta = raw.metadataColumn("_metadata")
    rows = raw.select(meta.getField("file_path").alias("path"), meta.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("path").alias("of"), F.col("block").alias("from"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    met = rows.join(splits, (F.col("path") == F.col("of")) & (F.col("block") == F.col("from")))
    no = F.col("at") + F.col("shift")
    return met.select("path", no.alias("no"), F.when(no == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line"))


def read_ami_jsonl(spark: SparkSession, path: str, prefix: str = "ami_", limit: int | None = None, dialogue: str = "dialogue", id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(utterances, rejects) of one JSON object a line; malformed lines are set aside, not fatal.

    Files are read line by line.  A line is known by its file and number, counted from 1; an object without id is
    named by its number.  ``limit`` takes the first good lines by file and number.  Lines that do not fit one
    object, and those without a turn, are rejects."""
    raw = numbered_lines(spark, path).where(fx.strip("line") != "")
    rows = raw.withColumn("j", F.from_json("line", f"struct<`{id_}`: string, `{dialogue}`: string>"))
    rows = rows.withColumn("meeting_id", F.concat(F.lit(prefix), F.coalesce(F.col("j").getField(id_), F.col("no").cast("string"))))
    key = F.struct("path", "no")
    lines = rows.select(key.alias("meeting_id"), F.posexplode(F.split(F.coalesce(F.col("j").getField(dialogue), F.lit("")), r"\r?\n")).alias("pos", "raw")).select("meeting_id", "pos", fx.strip("raw").alias("line")).where("line <> ''")
    out = parse_ami(lines).withColumnRenamed("meeting_id", "of")
    good = out.select("of.path", "of.no").distinct()
    taken = good if limit is None else good.orderBy("path", "no").limit(limit)
    names = rows.join(taken, ["path", "no"], "left_semi").select(key.alias("of"), "meeting_id")
    return out.join(names, "of").select("meeting_id", "seq", "speaker_id", "text", "start_time", "end_time"), raw.join(good, ["path", "no"], "left_anti").select("path", "no", "line")


def read_nxt_words(spark: SparkSession, paths, max_gap: float = 1.0) -> DataFrame:
    """``{meeting}.{speaker}.words.xml``: words of one speaker join while gaps stay within ``max_gap``."""
    kind = "_starttime DOUBLE, _endtime DOUBLE, _punc STRING, _VALUE STRING"
    raw = spark.read.format("xml").option("rowTag", "w").schema(kind).load(paths).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("pos"), "*")
    words = raw.where("_starttime IS NOT NULL AND _endtime IS NOT NULL").select(F.regexp_extract("path", r"([^/]+?)\.([^./]+)\.words\.xml$", 1).alias("meeting_id"), F.regexp_extract("path", r"([^/]+?)\.([^./]+)\.words\.xml$", 2).alias("spk"), F.col("_starttime").alias("s"), F.col("_endtime").alias("e"), (F.col("_punc") == "true").alias("punc"), F.col("_VALUE").alias("word"), "pos")
    from ..operators.windows import gap_sessions

    groups = gap_sessions(words, ["meeting_id", "spk"], "s", "e", max_gap, "pos")
    w = F.struct("s", "pos", F.concat(F.when(F.coalesce("punc", F.lit(False)), "").otherwise(" "), F.coalesce("word", F.lit(""))).alias("t"))
    out = groups.groupBy("meeting_id", "spk", "session_no").agg(F.min("s").alias("start_time"), F.max("e").alias("end_time"), F.array_sort(F.collect_list(w)).alias("ws"))
    text = fx.strip(F.array_join(F.transform("ws", lambda x: x["t"]), ""))
    seq = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_time", "spk", "session_no")) - 1
    return out.select("meeting_id", seq.cast("int").alias("seq"), F.concat(F.lit("SPEAKER_"), F.upper("spk")).alias("speaker_id"), text.alias("text"), "start_time", "end_time").where("text <> ''")


def parse_dialogue_pairs(files: DataFrame, limit: int | None = None, drop_unanswerable: bool = False) -> DataFrame:
    """Pairs of a JSON array of ``[lines, annotations]``; the id names the source position."""
    rows = files.select("stem", F.posexplode(F.from_json("content", "array<array<string>>")).alias("i", "unit"))
    kind = "array<struct<x: string, x_type: string, y: string, y_type: string, r: array<string>, t: array<string>>>"
    rows = rows.where("size(unit) = 2").select(F.format_string("%s_%04d", "stem", "i").alias("dialogue_id"), "i", F.from_json(F.try_element_at("unit", F.lit(1)), "array<string>").alias("lines"), F.from_json(F.try_element_at("unit", F.lit(2)), kind).alias("pairs"))
    rows = rows.where("size(lines) > 0 AND size(pairs) > 0")
    if drop_unanswerable:
        rows = rows.where("exists(pairs, p -> size(p.r) > 0 AND NOT forall(p.r, r -> r = 'unanswerable'))")
    if limit is not None:
        rows = rows.orderBy("stem" if "stem" in rows.columns else "dialogue_id", "i").limit(limit)
    out = rows.select("dialogue_id", F.array_join("lines", "\n").alias("window_text"), F.posexplode("pairs").alias("pair_index", "p"))
    trim = lambda c: fx.strip(F.coalesce(F.col(c), F.lit("")))
    out = out.select("dialogue_id", "window_text", "pair_index", trim("p.x").alias("x"), trim("p.x_type").alias("x_type"), trim("p.y").alias("y"), trim("p.y_type").alias("y_type"), F.coalesce("p.r", F.array()).alias("gold_relations"), F.coalesce(F.try_element_at("p.t", F.lit(1)), F.lit("")).alias("trigger"))
    return out.where("x <> '' AND y <> ''")


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id, pos, name of ``{meeting: [names]}``; an unreadable file gives no rows."""
    m = read_files(spark, path).select(F.from_json("content", "map<string, array<string>>").alias("m")).select(F.explode("m").alias("meeting_id", "names"))
    out = m.select("meeting_id", F.posexplode("names").alias("pos", "raw")).select("meeting_id", "pos", fx.strip("raw").alias("name"))
    return out.where("name <> ''")


def read_meeting_dates(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id, date of ``{meeting: {date}}``; entries that are no object are ignored."""
    m = read_files(spark, path).select(F.from_json("content", "map<string, string>").alias("m")).select(F.explode("m").alias("meeting_id", "raw"))
    return m.select("meeting_id", F.from_json("raw", "struct<date: string>")["date"].alias("date")).where("date IS NOT NULL")


def read_triples(spark: SparkSession, glob: str) -> DataFrame:
    """All ``triples_*.json``; the meeting is named by the file, the position by file and item."""
    kind = "array<struct<subject: string, subject_type: string, relation: string, object: string, object_type: string, confidence: double, timestamp: double, source_utterance: string, deadline_date: string>>"
    files = read_files(spark, glob)
    rows = files.select(F.regexp_extract("path", r"triples_(.+)\.json$", 1).alias("source_meeting"), F.posexplode(F.from_json("content", kind)).alias("pos", "t"))
    return rows.select("source_meeting", "pos", "t.*").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def parse_script(files: DataFrame) -> DataFrame:
    """``NAME: text`` with upper-case names; blank lines, ``---`` and ``===`` end a turn."""
    rows = files.select(F.col("stem").alias("meeting_id"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw")).select("meeting_id", "pos", fx.strip("raw").alias("line"))
    name, w = r"^([A-Z][A-Z0-9 ._'-]*):\s*(.*)$", Window.partitionBy("meeting_id").orderBy("pos")
    stop = F.col("line").rlike("^(-{3,}.*|={3,}.*|)$")
    rows = rows.withColumn("starts", F.col("line").rlike(name)).withColumn("edge", F.sum((F.col("starts") | stop).cast("int")).over(w))
    first = F.first("starts").over(Window.partitionBy("meeting_id", "edge").orderBy("pos"))
    rows = rows.withColumn("in_turn", first & ~stop).where("in_turn")
    text = F.when(F.col("starts"), F.regexp_extract("line", name, 2)).otherwise(F.col("line"))
    out = rows.groupBy("meeting_id", "edge").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("starts"), F.regexp_extract("line", name, 1))).alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("ts"))
    return out.select("meeting_id", "pos", "speaker", fx.strip(F.array_join(F.transform("ts", lambda t: t["t"]), " ")).alias("text")).where("text <> ''")

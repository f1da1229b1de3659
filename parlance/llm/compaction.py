"""Executed bin-packed compaction of a folder of Parquet files.

``write_lots`` lays a table out as one sorted file a (day, lot, piece); ``compact`` joins a day's small
files into larger ones, in place.  The plan is made per day by ``applyInPandas``: files in descending
size each descend a max-residual segment tree leftmost to the first open group that still holds them.
Rows of planned files join the plan, are dealt by group and sorted by joining ordinal and position, so
that one task streams each new file and no task holds one.  Files that stay are not opened for writing.

The plan is a row a file.  Only single totals (rows of the table, a path at a time for deletion) reach
the driver, and no broadcast is asked for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, read_table, stored

#: Shares of the table's rows: a lot of a day is split off every 1/LOTS, files under 1/SMALL are joined, up to 1/FULL.
LOTS, SMALL, FULL = 200, 750, 300


def share(rows: int, parts: int) -> int:
    """S(parts): a little over 1/parts of the rows."""
    return 1 + rows // parts


class Groups:
    """Open groups in the order of their opening, in a max-residual segment tree."""

    def __init__(self, count: int, room: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, rows: int) -> int:
        """The earliest group with room for so many rows; an unopened one follows all that are open."""
        at = 1
        if self.most[at] < rows:
            raise ValueError("more rows than a group holds")
        while at < self.leaves:
            at *= 2
            at += self.most[at] < rows
        self.most[at] -= rows
        group = at - self.leaves
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])
        return group


def _fresh(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores added where a column of the table has one of them."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


class Lots:
    """A table in a folder: a file a (day, lot, piece), named by its partition folders."""

    def __init__(self, root: str, schema: T.StructType):
        self.root, self.schema, self.empty = root, schema, False
        self.keys = _fresh(["day", "lot", "piece"], schema.names)
        self.path, self.index = _fresh(["file_path", "row_index"], schema.names + self.keys)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of the folder as it is now, with day, lot, piece, file path and place in the file."""
        reader = spark.read
        if self.empty:  # there is no file to take the columns from
            reader = reader.schema(T.StructType(self.schema.fields + [T.StructField(k, T.LongType()) for k in self.keys]))
        df = reader.parquet(self.root)
        df = df.withColumns({k: F.col(k).cast("long") for k in self.keys})
        meta = df.metadataColumn("_metadata")
        return df.select("*", meta.getField("file_path").alias(self.path), meta.getField("row_index").alias(self.index))

    def write(self, rows: DataFrame, order: list, mode: str) -> None:
        """One file a (day, lot, piece), in the given order, with the table's columns only."""
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as tasks are merged by bytes else, but opening files is the work
        dealt = rows.repartition(tasks, *self.keys).sortWithinPartitions(*self.keys, *order).select(*self.schema.names, *self.keys)
        dealt.write.mode(mode).option("maxRecordsPerFile", 0).partitionBy(*self.keys).parquet(self.root)


def write_lots(rows: DataFrame, root: str, time_col: str, id_col: str, lots: int = LOTS) -> Lots:
    """Write ``rows`` to the new folder ``root``: a file a (day, lot, piece), sorted by time, then id, nulls first.

    A day is whole days since 1970 of ``time_col`` (null: a day of its own); h is the CRC-32 of the decimal
    id (null counts as empty); lot = h / 16 modulo 1 + rows of the day / S(lots); piece = the lesser of
    h % 4 and h / 4 % 4.  Rows that tie in time and id, and repeated rows, stay in no stated order.  All
    columns are kept in table order, whatever their names; an empty table writes no file.

    The table of days (a row a day) is stored and joined without a hint, so that Spark compares its true
    size with its own limit before it sends it to all tasks."""
    spark, out = rows.sparkSession, Lots(root, rows.schema)
    day, lot, piece = out.keys
    of, size = _fresh(["of_day", "day_rows"], rows.columns + out.keys)
    dated = rows.withColumn(day, F.unix_date(F.col(time_col).cast("date")).cast("long"))
    days = stored(dated.groupBy(F.col(day).alias(of)).agg(F.count("*").alias(size)))
    total = days.agg(F.sum(size)).first()[0] or 0
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    split = F.lit(1) + F.floor(F.col(size) / F.lit(share(total, lots)))
    placed = dated.join(days, F.col(day).eqNullSafe(F.col(of)))
    placed = placed.withColumn(lot, F.floor(h / 16) % split).withColumn(piece, F.least(h % 4, F.floor(h / 4) % 4))
    out.write(placed, [time_col, id_col], "errorifexists")
    out.empty = not total
    return out


def plan(files: DataFrame, least: int, room: int) -> DataFrame:
    """(path, first_lot, first_piece, place, members) for each of ``files`` (day, lot, piece, path, n).

    In a day, files under ``least`` rows, by descending rows, then lot, then piece, each join the
    earliest-opened group that, with it, holds at most ``room`` rows.  place: ordinal in the group; members: files of
    the group.  Files of ``least`` rows or more, or of more than ``room``, are alone.  A day's files fit
    into one task: there are at most four a lot."""

    def day(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values(["n", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
        small = (files["n"] < least) & (files["n"] <= room)
        tree, group = Groups(int(small.sum()), room), []
        for k, n in enumerate(files["n"]):
            group.append(tree.place(int(n)) if small[k] else -1 - k)
        by = files.assign(group=group).groupby("group", sort=False)
        return pd.DataFrame({"path": files["path"], "first_lot": by["lot"].transform("first"), "first_piece": by["piece"].transform("first"), "place": by.cumcount(), "members": by["path"].transform("size")})

    return files.groupBy("day").applyInPandas(day, "path string, first_lot long, first_piece long, place long, members long")


def compact(spark: SparkSession, lots: Lots, small: int = SMALL, full: int = FULL) -> DataFrame:
    """Join the small files of the folder, and return (day, lot, piece, sources, rewritten) a final file.

    The plan is stored first, then the new files are added beside their first source, and the joined
    files are deleted last: if the job dies, ``retire`` with the stored plan finishes it.  Readers must
    wait for the end.  A group of one file is left as it is."""
    day, lot, piece = lots.keys
    table = lots.read(spark)
    files = stored(table.groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col(lots.path).alias("path")).agg(F.count("*").alias("n")))
    total = files.agg(F.sum("n")).first()[0] or 0
    planned = plan(files, share(total, small), share(total, full))
    planned = stored(files.join(planned, "path"))
    to_path, to_lot, to_piece, place = _fresh(["to_path", "to_lot", "to_piece", "place"], table.columns)
    moved = planned.where("members > 1").select(F.col("path").alias(to_path), F.col("first_lot").alias(to_lot), F.col("first_piece").alias(to_piece), F.col("place").alias(place))
    rows = table.join(moved, F.col(lots.path) == F.col(to_path)).withColumns({lot: F.col(to_lot), piece: F.col(to_piece)})
    lots.write(rows, [place, lots.index], "append")
    retire(spark, planned)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "lot", "piece"))), lambda s: F.concat_ws("-", s["lot"], s["piece"]))
    return planned.groupBy("day", "first_lot", "first_piece").agg(F.concat_ws(",", names).alias("sources"), (F.count("*") > 1).alias("rewritten"))


def retire(spark: SparkSession, planned: DataFrame) -> None:
    """Delete the files that were joined, a few paths at a time; done before, it does nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in planned.where("members > 1").select("path").toLocalIterator():
        file = path(row["path"])
        file.getFileSystem(conf).delete(file, False)


def file_facts(spark: SparkSession, lots: Lots, id_col: str, cents: Column) -> DataFrame:
    """A row a file of the folder as it is now: day, lot, piece, path, n_rows, min_id, max_id, cents, ids_sha256, columns.

    The ids of a file (null: empty) meet in one task in file order and are hashed as they stream by."""
    day, lot, piece = lots.keys
    table = lots.read(spark)
    names = [c for c in table.columns if c not in (*lots.keys, lots.path, lots.index)]
    ids = table.select(F.col(lots.path).alias("path"), F.col(lots.index).alias("at"), F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col(id_col).cast("long").alias("id"), cents.cast("long").alias("cents"))
    fields = "day long, lot long, piece long, path string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string"

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = [pa.string() if n in ("path", "ids_sha256") else pa.int64() for n in names]
        now, ended = None, []

        def close() -> None:
            ended.append((*now["key"], now["n"], now["min"], now["max"], now["cents"], now["sha"].hexdigest()))

        for b in batches:
            path, all_ids, all_cents = (b.column(c).to_pylist() for c in ("path", "id", "cents"))
            lo = 0
            while lo < len(path):
                hi = lo + 1
                while hi < len(path) and path[hi] == path[lo]:
                    hi += 1
                if now is None or now["key"][3] != path[lo]:
                    if now is not None:
                        close()
                    key = tuple(b.column(c)[lo].as_py() for c in ("day", "lot", "piece")) + (path[lo],)
                    now = {"key": key, "n": 0, "min": None, "max": None, "cents": 0, "sha": hashlib.sha256()}
                part = all_ids[lo:hi]
                now["sha"].update((("," if now["n"] else "") + ",".join("" if i is None else str(i) for i in part)).encode())
                known = [i for i in part if i is not None]
                if known:
                    now["min"] = min(known) if now["min"] is None else min(now["min"], *known)
                    now["max"] = max(known) if now["max"] is None else max(now["max"], *known)
                now["n"] += hi - lo
                now["cents"] += sum(all_cents[lo:hi])
                lo = hi
            if len(ended) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ended), kinds)], names=names)
                ended.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ended), kinds)], names=names)

    return map_arrow(ids.repartition("path").sortWithinPartitions("path", "at"), facts, fields).withColumn("columns", F.lit(",".join(names)))


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks, written by day, lot and piece, then compacted.

    Null click_ids count as empty in the hash and in the list of ids, and min and max skip them; a null
    arrived_at is a day of its own; a null or NaN value adds 0 cents."""
    clicks = read_table(spark, sf_dir, "clicks")
    lots = write_lots(clicks, new_folder(spark, "clicks"), "arrived_at", "click_id")
    made = compact(spark, lots)
    cents = F.coalesce(F.floor(F.lit(100) * F.col("value") + F.lit(0.5)), F.lit(0))
    found = file_facts(spark, lots, "click_id", cents).withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"})
    made = made.select(F.col("day").alias("of_day"), "first_lot", "first_piece", "sources", "rewritten")
    on = F.col("day").eqNullSafe(F.col("of_day")) & (F.col("lot") == F.col("first_lot")) & (F.col("piece") == F.col("first_piece"))
    return found.join(made, on).select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "path", "rewritten")

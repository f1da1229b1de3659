"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Codes are signs of rotated vectors; the rotation is learnt on a bounded sample (Gong & Lazebnik,
2011), several times from different starts when more bits are needed.  Each table indexes one piece
of the code.  The pieces grow with the logarithm of the number of vectors, so that a bucket of
unrelated vectors keeps its size (BUCKET); the number of tables grows with them, until pairs at the
threshold meet in some table with probability RECALL.  Comparing a bucket is cheap and shuffling a
vector to one more table is not, so buckets are large and tables few.  Vectors of one bucket are
compared tile by tile by their original coordinates in double precision; a pair counts in the first
table where it meets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Forest, by_runs, connected_components, map_arrow, prepare, read_table, stored

COSINE, TABLES = 0.93, 4
#: Vectors that the rotation is learnt on, its rounds, vectors that one task compares with each other at
#: most (a larger bucket is dealt in blocks of so many, fewer for vectors longer than WIDE), and of one
#: tile of such a block.
SAMPLE, ROUNDS, BLOCK, WIDE, TILE = 4096, 40, 8192, 64, 512
#: Unrelated vectors that a bucket should hold.
BUCKET = 2048
#: Longest list of large buckets that is sent to every task; a longer one is joined in a shuffle.
SEND_ROWS = 100_000
#: Expected share of the pairs at the threshold that meet; made pairs it is measured on; most tables, beyond
#: which pieces get shorter instead.
RECALL, MADE, MOST_TABLES = 0.95, 2048, 192


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation that brings the vectors nearest to the corners of a cube (alternating Procrustes)."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds if len(x) >= d else 0):
        z = x @ r
        u, _, vt = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def piece_bits(n: int) -> int:
    """Bits of a code piece for ``n`` vectors: as many as cut them into buckets of about BUCKET."""
    return min(30, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))


def tables_for(bits: int, cosine: float, recall: float = RECALL) -> int:
    """Tables in which a pair at the threshold meets with probability ``recall``, if hyperplanes are random."""
    meets = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meets))


def made_pairs(x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and partners at exactly ``cosine``: away in any direction, and in directions of the data."""
    r = np.random.default_rng(9)
    x = x[r.integers(len(x), size=MADE)]
    out = []
    for away in (r.standard_normal(x.shape), x[r.permutation(len(x))] - x):
        away = away - (away * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1)
        good = length > 1e-9
        if good.sum() >= MADE // 4:
            a, u = x[good], away[good] / length[good, None]
            out.append((a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * u))
    return out


def fit_tables(learnt: np.ndarray, d: int, mean: np.ndarray, bits: int, tables: int, cosine: float) -> tuple[np.ndarray, int, int]:
    """(hyperplanes as columns, bits, tables): so many tables, of at least ``tables``, that RECALL is met on made pairs.

    Hyperplanes that do not tell the made pairs apart well enough in MOST_TABLES get shorter pieces."""
    base = learnt if len(learnt) else np.random.default_rng(8).standard_normal((MADE, d))
    pairs = made_pairs(base / np.linalg.norm(base, axis=1, keepdims=True), cosine)
    parts: list[np.ndarray] = []
    while True:
        need = max(tables, tables_for(bits, cosine))
        most = max(need, MOST_TABLES)
        met = [np.zeros(len(a), dtype=bool) for a, _ in pairs]
        done = 0
        while done < need or (done < most and any(m.mean() < RECALL for m in met)):
            while len(parts) * d < (done + 1) * bits:
                parts.append(learn_rotation(learnt - mean, 100 + len(parts)))
            planes = np.concatenate(parts[done * bits // d : -(-(done + 1) * bits // d)], axis=1)
            at = done * bits % d
            for m, (a, b) in zip(met, pairs):
                m |= (((a - mean) @ planes[:, at : at + bits] >= 0) == ((b - mean) @ planes[:, at : at + bits] >= 0)).all(1)
            done += 1
        if bits == 1 or all(m.mean() >= RECALL for m in met):
            return np.concatenate(parts, axis=1)[:, : done * bits], bits, done
        bits = max(1, bits - 2)


def _unit(v: list | None) -> np.ndarray | None:
    if v is None or not len(v) or any(c is None for c in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    n = np.linalg.norm(x)
    return x / n if n > 0 and np.isfinite(n) else _unit((x / np.abs(x).max()).tolist()) if n > 0 or x.any() else None


def _fp(label: int, raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, key=str(label).encode()).digest()


def _units(raw, number: str) -> np.ndarray:
    """The unit vectors, in double precision, of vectors of one length, from the numbers as they came."""
    x = np.stack([np.frombuffer(r, dtype=number) for r in raw]).astype(np.float64)
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        out = x / n
    for i in np.flatnonzero(~np.isfinite(n[:, 0]) | (n[:, 0] < 1e-150)):
        out[i] = _unit(x[i].tolist())
    return out


def _compare(groups, cosine: float, number: str):
    """Within each seat: links of its own rows, or between its two halves, tile by tile."""
    for table, bound in groups:
        node, part, weight = (table.column(c).to_numpy() for c in ("node", "part", "weight"))
        t, side = table.column("t").to_numpy(), table.column("side").to_numpy()
        seat_x, seat_y = table.column("x").to_numpy(), table.column("y").to_numpy()
        raw, codes = (table.column(c).combine_chunks() for c in ("vector", "codes"))
        for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
            n, both = hi - lo, seat_x[lo] != seat_y[lo]
            # pair (i, j): i < j of one half, or i of the first half and j of the second
            a = np.flatnonzero(side[lo:hi] == 0)
            b = np.flatnonzero(side[lo:hi] == 1) if both else a
            if n < 2 or not len(a) or not len(b):
                continue
            x = _units([raw[i].as_buffer() for i in range(lo, hi)], number)
            c = np.stack([np.frombuffer(codes[i].as_buffer(), dtype=np.int32) for i in range(lo, hi)])[:, : t[lo]]
            w, links, forest = weight[lo:hi], np.zeros(n), Forest(n)
            for p in range(0, len(a), TILE):
                for q in range(0 if both else p, len(b), TILE):
                    one, two = a[p : p + TILE], b[q : q + TILE]
                    hit = x[one] @ x[two].T >= cosine
                    if not both and p == q:
                        hit = np.triu(hit, 1)
                    i, j = np.nonzero(hit)
                    i, j = one[i], two[j]
                    if t[lo] and len(i):
                        new = ~(c[i] == c[j]).any(1)
                        i, j = i[new], j[new]
                    if not len(i):
                        continue
                    links += np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
                    for u, v in zip(i.tolist(), j.tolist()):
                        forest.join(u, v)
            at = np.flatnonzero(links)
            if len(at):
                root = [node[lo + forest.find(k)] for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + at]), pa.array(part[lo + at]), pa.array(links[at].astype(np.int64)), pa.array(root, pa.int64())], names=["node", "part", "links", "root"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Vectors are compared only within one non-null label and one length.  Null or zero vectors and
    those with null or non-finite components link with nothing.  Copies of a vector meet as one row
    with a weight, and count as links of each other.  Rows with a null id take no part: 0 links and
    null component.  Rows that repeat an id are one vector if their vectors are the same; if not, each
    vector counts its own links, and as one id they share a component.  Other columns are not read.  An empty table gives no rows.  There are at least ``tables`` tables, and as
    many more as RECALL takes at the length of code pieces that the number of vectors asks for."""
    spark = vectors.sparkSession
    prepare(spark)
    number = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"  # vectors travel as they came
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))

    def normalise(batches):
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(2).to_pylist()
            fp, raw, dim = [], [], []
            for i, v, label in zip(ids, b.column(1).to_pylist(), labels):
                x = None if i is None or label is None else _unit(v)
                raw.append(None if x is None else np.asarray(v, dtype=number).tobytes())
                fp.append(None if x is None else _fp(label, raw[-1]))
                dim.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.binary()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=["id", "label", "fp", "dim", "vector"])

    rows = map_arrow(src, normalise, "id long, label long, fp binary, dim int, vector binary")
    ids = rows.select("id", "label", "fp").checkpoint()
    # rows that repeat an id and its vector count once; an id's vectors are numbered (nearly all are number 0)
    groups = ids.where("fp IS NOT NULL").distinct().groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    groups = groups.withColumn("part", (F.row_number().over(Window.partitionBy("node").orderBy("fp")) - 1).cast("int")).checkpoint()
    reps = rows.where("fp IS NOT NULL").withColumnRenamed("fp", "own").join(groups, (F.col("own") == F.col("fp")) & (F.col("id") == F.col("node")))
    reps = stored(reps.select("node", "part", "label", "weight", "dim", "vector").dropDuplicates(["node", "part"]))
    total = max(2, reps.count())
    bits = piece_bits(total)
    sample = reps.orderBy(F.xxhash64("node", "part", F.lit(7)), "node", "part").limit(SAMPLE).select("dim", "vector").collect()
    dims = [r["dim"] for r in sample]
    main = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 1
    held = [r["vector"] for r in sample if r["dim"] == main]
    learnt = _units(held, number) if held else np.zeros((0, main))
    mean = learnt.mean(0) if len(learnt) else np.zeros(main)

    def fit(d: int) -> tuple[np.ndarray, int, int]:
        return fit_tables(learnt if d == main else np.zeros((0, d)), d, mean if d == main else np.zeros(d), bits, tables, cosine)

    fitted = fit(main)

    def index(batches):
        known = {main: fitted}
        for b in batches:
            raw, dim = b.column(5), b.column(4).to_pylist()
            codes: list = [None] * len(dim)
            for d in set(dim):
                if d not in known:
                    known[d] = fit(d)
                planes, width, count = known[d]
                at = [k for k, other in enumerate(dim) if other == d]
                x = _units([raw[k].as_buffer() for k in at], number)
                sign = (x - mean if d == main else x) @ planes >= 0
                code = (sign.reshape(-1, count, width) @ (1 << np.arange(width, dtype=np.int64))).astype(np.int32)
                for k, c in zip(at, code):
                    codes[k] = c
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            for t in range(max((len(c) for c in codes), default=0)):
                at = pa.array([k for k, c in enumerate(codes) if len(c) > t], pa.int64())
                key = pa.array([int(c[t]) for c in codes if len(c) > t], pa.int32())
                label, size, node, part, weight, vector = (b.column(k).take(at) for k in (2, 4, 0, 1, 3, 5))
                seen = packed.take(at) if t else pa.array([b""] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), label, size, key, node, part, weight, seen, vector], names=["t", "label", "dim", "key", "node", "part", "weight", "codes", "vector"])

    indexed = map_arrow(reps, index, "t int, label long, dim int, key int, node long, part int, weight long, codes binary, vector binary")
    # buckets of more than one block are compared block by block, each pair of blocks a seat of its own
    bucket = ["t", "label", "dim", "key"]
    block = F.greatest(F.lit(min(TILE, BLOCK)), F.floor(F.lit(BLOCK * WIDE) / F.greatest("dim", F.lit(WIDE))))
    large = indexed.groupBy(*bucket).count().where(F.col("count") > block).select(*bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks")).checkpoint()
    dealt = indexed.join(F.broadcast(large) if large.count() <= SEND_ROWS else large, bucket, "left")
    own = F.pmod(F.xxhash64("node", "part"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    seat = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y"), F.when(k < F.col("own"), 1).otherwise(0).alias("side")))
    rest = ["node", "part", "weight", "codes", "vector"]
    dealt = dealt.select(*bucket, *rest, F.explode(seat).alias("seat")).select(*bucket, "seat.x", "seat.y", "seat.side", *rest)
    found = by_runs(dealt, [*bucket, "x", "y"], ["node", "part"], lambda g: _compare(g, cosine, number), "node long, part int, links long, root long").checkpoint()

    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "of_node")
    links = found.groupBy("node", "part").agg(F.sum("links").alias("links")).select(F.col("node").alias("at"), F.col("part").alias("at_part"), "links")
    answer = groups.join(links, (F.col("node") == F.col("at")) & (F.col("part") == F.col("at_part")), "left").join(comps, F.col("node") == F.col("of_node"), "left")
    answer = answer.select(F.col("fp").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("comp")).checkpoint()
    out = ids.join(answer, F.col("fp") == F.col("of"), "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))

"""N-gram Jaccard self-join of documents through count-vector R-trees.

Plan
----
1. One pass reduces each text to (doc_id, number of distinct shingles, set fingerprint) and to the
   keys of step 2.  A task gives the keys of equal sets once, and equal sets meet in one row (partial
   aggregation), so copies never meet as pairs and a key's run has a row a task and set, not a copy.
2. *Dealing.*  A pair with Jaccard >= t and larger size s differs in at most D(s) shingles.  The hash
   space is cut into more than D parts, so some part holds the very same shingles in both sets
   (pigeonhole; Arasu, Ganti, Kaushik 2006).  Each set emits a 64-bit key per part; sets that share a
   key are chained, and the chains' connected components are the *candidate clusters*.  No link can
   cross two clusters.
3. *R-tree.*  Each cluster is dealt in chunks of bounded weight.  Every chunk hashes shingles into
   groups, takes the group counts as points of a packed R-tree, prunes nodes and points whose summed
   coordinate minima cannot reach the required overlap, and verifies the pairs that survive on the
   shingle sets.  Pairs already joined within the chunk need no test.
4. Clusters of several chunks share pivots with every chunk.  Sets that are not joined to the cluster's
   largest component afterwards probe every chunk.  Where that is more work than new keys are (many texts
   that share a passage chain into one cluster without being alike), the cluster is dealt again by the keys
   of an independent partition: a linked pair shares one of those too, so the cluster falls apart into the
   runs of the new keys, and so on; no pair goes untested or unjoined, and no run is quadratic but where
   its sets agree in parts of every partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, by_runs, connected_components, map_arrow, prepare, read_table, stored

#: 100 * intersection >= PERCENT * union
WORDS, PERCENT = 4, 85
#: Coordinates of a count vector, points of a leaf, members and summed set sizes of a chunk, pivots.
GROUPS, LEAF, CHUNK_MEMBERS, CHUNK_SHINGLES, PIVOTS = 64, 8, 64, 2_000_000, 8
#: There are 1 + D / SPARE parts more than needed.  Equal parts are equal in size and hash, so both sets
#: of a pair rank their common parts alike, and each may leave out its weakest ones: of D + 1 + x parts
#: in all, at least 1 + x are common, and the strongest of those is not among the x weakest of either.
SPARE = 3
#: Bits for each member, and most bits (64 MB), of the bitmap that keeps sets outside clusters from being shuffled.
BITS_EACH, BITMAP = 32, 1 << 29
#: A cluster is dealt again, DEALS times at most, if probing all its chunks takes over GAIN times the rows that
#: its new keys take, and more than PROBES sets are outside its largest component; else those sets probe.
PROBES, GAIN, DEALS = 64, 4, 4
#: Sets that a task remembers so as to give the keys of copies once.
REMEMBERED = 500_000
#: Largest placement table (a few numbers a row) that is sent to every task; beyond it the join is shuffled.
SEND_ROWS = 300_000

_U = np.uint64
_BASE, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are hashed at once, and the longest word (in 8-byte pieces) that goes with the others.
_BLOCK, _LONG = 1 << 17, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _pieces(n: int) -> np.ndarray:
    """A salt for each 8-byte piece of a word."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE)


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block of bytes, and where they begin.

    A hash is the mixed sum of mixed, salted 8-byte pieces: no polynomial, so no texts are known that
    collide by their form."""
    data = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    space = _SPACE[data]
    space[len(raw) :] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    begin, size = edge[0::2], edge[1::2] - edge[0::2]
    lower = _LOWER[data]
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=lower, strides=(1,))
    out = _mix(size.astype(np.uint64) + _BASE)
    for i in np.flatnonzero(size > 8 * _LONG).tolist():
        word = lower[begin[i] : begin[i] + size[i]].tobytes()
        v = np.frombuffer(word + bytes(-len(word) % 8), dtype="<u8")
        out[i : i + 1] += _mix(v ^ _pieces(len(v))).sum(dtype=np.uint64, keepdims=True)
    live, salt = np.flatnonzero(size <= 8 * _LONG), _pieces(_LONG)
    for j in range(_LONG):
        left = size[live] - 8 * j
        v = eight[begin[live] + 8 * j]
        unused = np.maximum(64 - 8 * left, 0).astype(np.uint64)
        out[live] += _mix(((v << unused) >> unused) ^ salt[j])
        live = live[left > 8]
        if not len(live):
            break
    return _mix(out), begin


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As _hash_words; a long text is cut at white space, so that memory stays bounded."""
    if len(raw) <= 8 * _BLOCK:
        return _hash_words(raw)
    found, at = [], 0
    while at < len(raw):
        end = at + 8 * _BLOCK
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, min(_BLOCK, len(raw) - end), end)])
            if len(gap):
                end += int(gap[0])
                break
            end += _BLOCK
        h, begin = _hash_words(raw[at:end])
        found.append((h, begin + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _shingles(raw: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a block."""
    word, begin = _words(b" ".join(raw))
    first = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))))
    many = max(0, len(word) - words + 1)
    grams = np.zeros(many, dtype=np.uint64)
    for k in range(words if many else 0):
        grams = grams * _M2 + _mix(word[k : k + many] + _U(k + 1))
    grams = _mix(grams)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:  # the whole sequence is one shingle, unlike any of ``words`` words
            h = np.full(1, hi - lo, dtype=np.uint64)
            for k in range(lo, hi):
                h = _mix(h * _BASE + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Lower-cases A-Z, cuts at [\\x20\\x09-\\x0D] and hashes each ``words``-word shingle to 64 bits."""
    out, block, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        block.append(raw)
        size += len(raw)
        if size > _BLOCK:
            out += _shingles(block, words)
            block, size = [], 0
    return out + (_shingles(block, words) if block else [])


def _fingerprint(s: np.ndarray) -> int:
    if not len(s):
        return 0
    sums = np.array([_mix(s ^ _BASE).sum(dtype=np.uint64), _mix(s + _U(len(s))).sum(dtype=np.uint64)])
    return int((_mix(sums) * np.array([_M1, _M2])).sum(dtype=np.uint64).view(np.int64))


def _levels(percent: int, top: int) -> np.ndarray:
    """Lower bounds of the size classes: the smaller set of a pair is in its larger set's class or the one below."""
    low = [1]
    while low[-1] <= top:
        low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
    return np.array(low)


def _part_keys(s: np.ndarray, level: int, low: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's parts in the scheme for pairs whose larger set is in ``level``."""
    most = int(low[level + 1]) - 1
    differ = (100 - percent) * 2 * most // (100 + percent)
    if differ == 0:
        return np.zeros(0, dtype=np.uint64)  # only equal sets can link, and those are one row already
    spare = 1 + differ // SPARE
    parts = differ + 1 + spare
    part = ((s >> _U(32)) * _U(parts)) >> _U(32)
    start = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
    salt = np.full(1, level, dtype=np.uint64) * _M1
    key = _mix(np.add.reduceat(_mix(s), start) ^ _mix(part[start] + salt))
    many = np.diff(np.append(start, len(s)))
    if parts - len(start) > spare:  # so few shingles that empty parts must count
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[start], assume_unique=True)
        key, many = np.concatenate([_mix(_mix(empty + salt) ^ _M2), key]), np.concatenate([np.zeros(len(empty), dtype=np.int64), many])
    return key[np.lexsort((key, many))[len(key) - differ - 1 :]]


def set_keys(s: np.ndarray, percent: int = PERCENT, low: np.ndarray | None = None) -> np.ndarray:
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    low = _levels(percent, len(s) * 2 + 4) if low is None else low
    level = int(np.searchsorted(low, len(s), "right")) - 1
    # the partner may be larger, in the next class; or even one class further where classes are narrow
    keys, k = [], level
    while k == level or low[k] * percent <= len(s) * 100:
        keys.append(_part_keys(s, k, low, percent))
        k += 1
    return np.concatenate(keys)


class CountTree:
    """A packed R-tree over count vectors that answers "which points may overlap enough?"."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, groups: int = GROUPS):
        self.percent, self.groups = percent, groups
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.points = np.stack([self.point(s) for s in sets]) if sets else np.zeros((0, groups), dtype=np.int64)
        # packed by size, then by the heaviest coordinate: points of a leaf are alike
        self.order = np.lexsort((self.points.argmax(1), self.size)) if sets else np.zeros(0, dtype=np.int64)
        self.levels = []
        low = high = self.size[self.order]
        box = self.points[self.order]
        while len(box) > 1:
            at = np.arange(0, len(box), LEAF)
            box, low, high = np.maximum.reduceat(box, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((box, low, high))

    def point(self, s: np.ndarray) -> np.ndarray:
        return np.bincount((s & _U(self.groups - 1)).astype(np.int64), minlength=self.groups)

    def _may(self, point, n, box, low, high) -> np.ndarray:
        least = np.maximum(low, -(-n * self.percent // 100))
        bound = np.minimum(point, box).sum(1)
        return (high * 100 >= n * self.percent) & (low * self.percent <= n * 100) & (bound * (100 + self.percent) >= self.percent * (n + least))

    def search(self, point: np.ndarray, n: int) -> np.ndarray:
        """Positions of the points that the bound cannot rule out."""
        nodes = None
        for k in range(len(self.levels) - 1, -1, -1):
            box, low, high = self.levels[k]
            nodes = np.arange(len(box)) if nodes is None else nodes
            nodes = nodes[self._may(point, n, box[nodes], low[nodes], high[nodes])]
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        at = self.order if nodes is None else self.order[nodes]
        return at[self._may(point, n, self.points[at], self.size[at], self.size[at])] if len(at) else at


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


class Chunk:
    """The members of a chunk in a tree, past which its probes stream; sets that are known to be one component are joined already."""

    def __init__(self, percent: int):
        self.percent, self.members, self.forest, self.known, self.tree = percent, [], Forest(0), {}, None

    def _seat(self, comp: int) -> int:
        """A place in the forest, joined to what an earlier round has joined it with."""
        at = len(self.forest.up)
        self.forest.up.append(at)
        self.forest.join(at, self.known.setdefault(comp, at))
        return at

    def _search(self, at: int, node: int, grams: np.ndarray, before: int) -> Iterator[tuple[int, int]]:
        for j in self.tree.search(self.tree.point(grams), len(grams)):
            other, seat, theirs = self.members[j]
            if j < before and self.forest.find(at) != self.forest.find(seat) and linked(grams, theirs, self.percent):
                self.forest.join(at, seat)
                yield node, other

    def add(self, node: int, comp: int, grams: np.ndarray) -> None:
        self.members.append((node, self._seat(comp), grams))

    def close(self) -> Iterator[tuple[int, int]]:
        """Build the tree when all members are there, and join them with one another."""
        if self.tree is None and len(self.members):
            self.tree = CountTree([g for *_, g in self.members], self.percent)
            for i, (node, seat, grams) in enumerate(self.members):
                yield from self._search(seat, node, grams, i)

    def probe(self, node: int, comp: int, grams: np.ndarray) -> Iterator[tuple[int, int]]:
        yield from self.close()
        if self.tree is not None:
            yield from self._search(self._seat(comp), node, grams, len(self.members))


def _join_stream(batches, percent: int):
    """Self-join of each chunk's members, and of its probes with its members, inside one task.

    Rows come by chunk, members before probes: a chunk's members are held, which are bounded, and its probes,
    which are not, are dropped one by one."""
    now, chunk, pairs = None, Chunk(percent), []
    for b in batches:
        component, number, probe, node, comp = (b.column(c).to_pylist() for c in ("component", "chunk", "probe", "node", "comp"))
        grams = b.column("grams")
        for i, key in enumerate(zip(component, number)):
            if key != now:
                pairs.extend(chunk.close())
                now, chunk = key, Chunk(percent)
            s = np.frombuffer(grams[i].as_buffer(), dtype=np.uint64)
            if probe[i]:
                pairs.extend(chunk.probe(node[i], comp[i], s))
            else:
                chunk.add(node[i], comp[i], s.copy())
        if len(pairs) >= 10_000:
            yield _emit(pairs)
            pairs = []
    pairs.extend(chunk.close())
    if pairs:
        yield _emit(pairs)


def _deal_again(batches, salt: int, percent: int):
    """A row (run, fp, rep, comp) for each key of a set under the partition of ``salt``; runs lie within a component."""
    low = _levels(percent, 1 << 40)
    turn = _mix(np.full(1, salt, dtype=np.uint64))
    for b in batches:
        group = b.column(0).to_numpy().view(np.uint64)
        keys = [set_keys(np.sort(_mix(np.frombuffer(g.as_buffer(), dtype=np.uint64) ^ turn)), percent, low) for g in b.column(4)]
        many = [len(k) for k in keys]
        run = _mix(np.concatenate(keys) ^ _mix(np.repeat(group, many) + turn)).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
        rest = [pa.array(np.repeat(b.column(k).to_numpy(), many)) for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(run), *rest], names=["component", "fp", "rep", "comp"])


def _summed(rows: DataFrame) -> DataFrame:
    """Of each ``component``: members, kinds (connected components so far), the largest of those (main) and its members; shingles if there are sets."""
    more = [F.sum("n").alias("shingles")] if "n" in rows.columns else []
    kinds = rows.groupBy("component", "comp").agg(F.count("*").alias("count"), *more)
    more = [F.sum("shingles").alias("shingles")] if more else []
    return kinds.groupBy("component").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("kinds"), F.sum("count").alias("members"), *more).select("component", F.col("top.comp").alias("main"), F.col("top.count").alias("largest"), "kinds", "members", *(["shingles"] if more else []))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: the id, n_shingles and component_id (smallest id reachable by links).

    Null, empty or blank texts have no shingles and link with nothing.  Rows that share an id are one
    document: they share a component.  A null id links with nothing and has a null component.  Other
    columns of ``docs``, whatever their names, are not read.  An empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def keys(batches):
        """A row of features for each document (n is set), and a row for each key of its set (n is null)."""
        low = _levels(percent, 1 << 40)
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            sets = shingle_sets(b.column(1).to_pylist(), words)
            fps = np.array([_fingerprint(s) for s in sets], dtype=np.int64)
            have = []
            for i, (s, fp) in enumerate(zip(sets, fps.tolist())):
                if len(s) and ids[i] is not None and fp not in seen:
                    have.append(i)
                    seen.add(fp)
            if len(seen) > REMEMBERED:
                seen.clear()
            found = [set_keys(sets[i], percent, low) for i in have]
            many = [len(k) for k in found]
            key = np.concatenate([_mix(np.arange(len(ids), dtype=np.uint64) ^ fps.view(np.uint64)), *found]).view(np.int64)
            fp = np.concatenate([fps, np.repeat(fps[have], many)])
            rest = [None] * sum(many)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array([len(s) for s in sets] + rest, pa.int64()), pa.array(ids + rest, pa.int64())], names=["key", "fp", "n", "id"])

    def chains(groups):
        """Features pass through; sets that share a key become pairs (a, b), one after the other."""
        for table, _ in groups:
            n = table.column("n").combine_chunks()
            own = np.asarray(n.is_valid())
            if own.any():
                f = table.filter(pa.array(own))
                none = pa.nulls(f.num_rows, pa.int64())
                yield from pa.table([f.column("id"), f.column("n"), f.column("fp"), none, none], names=["id", "n", "fp", "a", "b"]).to_batches()
            key, fp = table.column("key").to_numpy()[~own], table.column("fp").to_numpy()[~own]
            at = np.flatnonzero((key[1:] == key[:-1]) & (fp[1:] != fp[:-1]))
            if len(at):
                pairs = np.unique(np.stack([fp[at], fp[at + 1]], 1), axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n", "fp", "a", "b"])

    dealt = map_arrow(src, keys, "key long, fp long, n long, id long")
    first = by_runs(dealt, ["key"], ["fp"], chains, "id long, n long, fp long, a long, b long").checkpoint()
    feats = first.where("n IS NOT NULL").select("id", "n", "fp")
    reps = feats.where("n > 0 AND id IS NOT NULL").groupBy("fp", "n").agg(F.min("id").alias("rep")).checkpoint()
    found = connected_components(first.where("n IS NULL").select("a", "b").distinct())
    cluster = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    cluster = cluster.join(reps, F.col("node") == F.col("fp")).select("component", "fp", "rep", "n").checkpoint()
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    weight = cluster.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    weight = weight.select("component", "members", chunks.alias("chunks")).checkpoint()
    placed = cluster.join(weight, "component").select("component", "fp", "rep", "members", "chunks", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("own")).checkpoint()

    def with_sets(rows: DataFrame) -> DataFrame:
        """Add the shingle sets to rows (fp, rep, ...).  A bitmap keeps the sets of most other documents
        where they are; what it lets through in error, the join drops."""
        many = rows.count()
        size = min(BITMAP, max(1 << 20, 1 << (many * BITS_EACH).bit_length()))
        bit = F.pmod("fp", F.lit(size)) + 1  # bucket numbers count from 1
        bits = rows.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
        held = spark.sparkContext.broadcast({int(r["at"]): bytes(r["bits"]) for r in bits.collect()})  # BITMAP bits at most

        def sets(batches):
            have = held.value
            for b in batches:
                keep, fps, out = [], [], []
                for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), words)):
                    fp = _fingerprint(s)
                    bit = fp % size
                    part = have.get(bit // 32768 + 1)
                    if part is not None and i is not None and len(s) and part[bit % 32768 // 8] >> (bit % 8) & 1:
                        keep.append(i)
                        fps.append(fp)
                        out.append(s.tobytes())
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(fps, pa.int64()), pa.array(out, pa.binary())], names=["set_id", "set_fp", "grams"])

        rows = F.broadcast(rows) if many <= SEND_ROWS else rows
        texts = map_arrow(src, sets, "set_id long, set_fp long, grams binary")
        texts = texts.join(rows, (F.col("set_fp") == F.col("fp")) & (F.col("set_id") == F.col("rep"))).drop("set_fp", "set_id")
        return texts.dropDuplicates(["fp"])  # a row that repeats an id and its text

    def join_chunks(rows: DataFrame, seat) -> DataFrame:
        """Deal rows with their sets to seats (chunk, probe) and join each chunk with itself and its probes."""
        rows = rows.select("component", F.explode(seat).alias("seat"), F.col("rep").alias("node"), "comp", "grams")
        rows = rows.select("component", "seat.chunk", "seat.probe", "node", "comp", "grams")
        rows = rows.repartition("component", "chunk").sortWithinPartitions("component", "chunk", "probe", "node")
        return map_arrow(rows, lambda batches: _join_stream(batches, percent), "a long, b long")

    at = lambda chunk, probe: F.struct(chunk.cast("int").alias("chunk"), F.lit(probe).alias("probe"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("fp", F.lit(7)), "members") < PIVOTS)
    links = join_chunks(with_sets(placed.withColumn("comp", F.col("rep"))), F.when(pivot, F.transform(every, lambda c: at(c, False))).otherwise(F.array(at(F.col("own"), False)))).checkpoint()

    # clusters of several chunks that are not one component yet
    comps = connected_components(links).withColumnRenamed("component", "comp_")
    split = placed.where("chunks > 1").join(comps, F.col("rep") == F.col("node"), "left")
    split = split.select("component", "fp", "rep", F.coalesce("comp_", "rep").alias("comp")).checkpoint()
    open_ = _summed(split).where("kinds > 1").select("component")
    open_ = split.join(open_, "component", "left_semi").checkpoint()
    if not open_.isEmpty():
        sets = stored(with_sets(open_.select("fp", "rep").distinct()).select(F.col("fp").alias("set_fp"), "grams", (F.length("grams") / 8).cast("long").alias("n")))

        def find(rows: DataFrame) -> DataFrame:
            return rows.join(sets, F.col("fp") == F.col("set_fp")).drop("set_fp")

        for deal in range(DEALS + 1):
            groups = _summed(find(open_)).where("kinds > 1")
            groups = groups.withColumn("chunks", F.greatest(F.ceil(F.col("members") / CHUNK_MEMBERS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")).checkpoint()
            open_sets, keys_each = F.col("members") - F.col("largest"), 2.0 * (100 - percent) / (100 + percent)
            cheap = open_sets * F.col("chunks") <= GAIN * (F.col("shingles") * keys_each + F.col("members"))
            few = (F.col("chunks") == 1) | (open_sets <= PROBES) | cheap | F.lit(deal == DEALS)
            rows = open_.join(groups.where(few), "component").withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
            others = F.transform(F.filter(every, lambda c: c != F.col("own")), lambda c: at(c, True))
            own = F.array(at(F.col("own"), False))
            links = links.union(join_chunks(find(rows), F.when(F.col("comp") == F.col("main"), own).otherwise(F.concat(own, others))))
            open_ = open_.join(groups.where(~few), "component", "left_semi").checkpoint()
            if open_.isEmpty():
                break
            dealt = map_arrow(find(open_).select("component", "fp", "rep", "comp", "grams"), lambda batches: _deal_again(batches, deal + 1, percent), "component long, fp long, rep long, comp long").checkpoint()
            open_ = dealt.join(_summed(dealt).where("kinds > 1").select("component"), "component", "left_semi").checkpoint()
    # the sets of an id that has several texts are one document's
    several = feats.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select(F.col("id").alias("of_id")).checkpoint()
    own = feats.join(several, F.col("id") == F.col("of_id"), "left_semi").where("n > 0").join(reps, ["fp", "n"]).select(F.col("id").alias("of_id"), "rep").distinct().checkpoint()
    hubs = own.groupBy("of_id").agg(F.min("rep").alias("hub"))
    links = links.union(own.join(hubs, "of_id").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    final = connected_components(links).withColumnRenamed("component", "comp_")
    answer = reps.join(final, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.col("n").alias("of_n"), F.coalesce("comp_", "rep").alias("component_id")).checkpoint()
    out = feats.join(answer, (F.col("fp") == F.col("of")) & (F.col("n") == F.col("of_n")), "left")
    # a row without shingles whose id has other rows goes with them
    named = own.join(final, F.col("rep") == F.col("node"), "left").groupBy("of_id").agg(F.min(F.coalesce("comp_", "rep")).alias("id_component"))
    out = out.join(named, F.col("id") == F.col("of_id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id_component", "id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read_table(spark, sf_dir, "documents"))

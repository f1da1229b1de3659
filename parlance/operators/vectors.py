"""Labelled vectors: prototypes, similarity, prediction, memory selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx


def prototypes(rows: DataFrame, label: str = "label", vector: str = "x") -> DataFrame:
    """Mean vector of each label.  Sums are combined map-side: one row a label and dimension is shuffled."""
    parts = rows.select(F.col(label).alias("label"), F.posexplode(F.col(vector)).alias("d", "v")).groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("ms")).select("label", F.transform("ms", lambda m: m["m"]).alias("p"))


def mixed_prototypes(rows: DataFrame, memory: DataFrame, beta: float) -> DataFrame:
    """(1 - beta) * mean of all rows + beta * mean of the memory rows (row_id, label)."""
    kept = prototypes(rows.join(memory.select("row_id"), "row_id", "left_semi")).withColumnRenamed("p", "q")
    both = prototypes(rows).join(kept, "label")
    return both.select("label", F.zip_with("p", "q", lambda a, b: a * (1.0 - beta) + b * beta).alias("p"))


def similarities(rows: DataFrame, protos: DataFrame, keys: list[str], tau: float | None = None) -> DataFrame:
    """keys, proto, cos and, with ``tau``, the softmax weight over the prototypes.

    All prototypes (a row a class) travel as one array; a row's weights are summed in place, without a shuffle."""
    packed = protos.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("proto"), "p"))).alias("_ps"))
    x = F.col("x").cast("array<double>")
    out = rows.crossJoin(F.broadcast(packed)).select(*keys, F.transform("_ps", lambda q: F.struct(q["proto"].alias("proto"), fx.cosine(x, q["p"]).alias("cos"))).alias("_c"))
    if tau is None:
        return out.select(*keys, F.inline("_c"))
    e = lambda c: F.exp(c["cos"] / tau)
    total = F.aggregate("_c", F.lit(0.0), lambda s, c: s + e(c))
    out = out.withColumn("_t", total)
    return out.select(*keys, F.inline(F.transform("_c", lambda c: F.struct(c["proto"].alias("proto"), c["cos"].alias("cos"), (e(c) / F.col("_t")).alias("weight")))))


def nearest(rows: DataFrame, protos: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction: the prototype of highest cosine (smaller label on ties).

    All prototypes travel as one array, so each row is scored in place and no row is multiplied."""
    packed = protos.agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("protos"))
    x = F.col("x").cast("array<double>")
    rows = rows.join(F.broadcast(packed))
    scored = F.transform("protos", lambda q: F.struct(F.round(fx.cosine(x, q["p"]), 9).alias("cos"), (-q["label"]).alias("neg")))
    return rows.select(*keys, (-F.array_max(scored)["neg"]).alias("pred"))


def staged_predictions(rows: DataFrame, protos: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stage, pred: at each stage the nearest prototype of the classes seen so far.

    Cosines are computed once a row; the stages reuse them."""
    packed = protos.join(F.broadcast(tasks), "label").agg(F.array_sort(F.collect_list(F.struct("label", "task", "p"))).alias("protos"), (F.max("task") + 1).alias("stages"))
    x = F.col("x").cast("array<double>")
    cos = F.transform("protos", lambda q: F.struct(F.round(fx.cosine(x, q["p"]), 9).alias("cos"), (-q["label"]).alias("neg"), q["task"].alias("task")))
    scored = rows.join(F.broadcast(packed)).select(*keys, "stages", cos.alias("cos"))
    staged = scored.select(*keys, "cos", F.explode(F.sequence(F.lit(0), F.col("stages") - 1)).alias("stage"))
    return staged.select(*keys, "stage", (-F.array_max(F.filter("cos", lambda c: c["task"] <= F.col("stage")))["neg"]).alias("pred"))


#: Starts of k-means and most rounds of each, as in the reference; a start ends when its centres move by
#: less than this share of the mean variance.
STARTS, ROUNDS, STILL = 10, 300, 1e-4
#: Passes that draw candidate centres (2 m rows each), and rows of a class that one task fits by itself.
DRAWS, LOCAL_ROWS = 3, 20_000


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each id, by splitmix64."""
    z = ids.astype(np.int64).view(np.uint64)
    for k in salt:
        z = z + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _squares(x: np.ndarray, c: np.ndarray, xx: np.ndarray | None = None) -> np.ndarray:
    """Squared distances; those near zero are exact.  ``xx``: the squared lengths of x, if they are known."""
    xx = (x * x).sum(1) if xx is None else xx
    d = x @ c.T
    d *= -2
    d += xx[:, None]
    d += (c * c).sum(1)[None]
    np.maximum(0.0, d, out=d)
    i, j = np.nonzero(d <= 1e-9 * (1 + xx)[:, None])
    d[i, j] = ((x[i] - c[j]) ** 2).sum(1)
    return d


def _draw(ids: np.ndarray, x: np.ndarray, c: np.ndarray, want: int, *salt: int, xx: np.ndarray | None = None) -> np.ndarray:
    """Race values and vectors of ``want`` rows drawn by squared distance to the centres so far, without replacement."""
    d = _squares(x, c, xx).min(1) if len(c) else np.ones(len(x))
    with np.errstate(divide="ignore"):
        race = np.where(d > 0, -np.log(_uniform(ids, *salt)) / d, np.inf)
    at = np.argsort(race, kind="stable")[:want]
    at = at[np.isfinite(race[at])]
    return np.column_stack([race[at], x[at]])


def _moved(x: np.ndarray, c: np.ndarray, xx: np.ndarray | None = None, squares: float | None = None) -> np.ndarray:
    """A row: sums and counts of each cluster, inertia, sum of squares, and the farthest row after its distance."""
    d = _squares(x, c, xx)
    at = d.argmin(1)
    near = d[np.arange(len(x)), at]
    member = (at[:, None] == np.arange(len(c))).astype(float)
    far = near.argmax()
    return np.concatenate([(member.T @ x).ravel(), np.bincount(at, minlength=len(c)), [near.sum(), (x * x).sum() if squares is None else squares, near[far]], x[far]])[None]


def _step(ids: np.ndarray, x: np.ndarray, c: np.ndarray, start: int, seed: int, turn: int, want: int, xx: np.ndarray | None = None, squares: float | None = None) -> np.ndarray:
    return _draw(ids, x, c, want, seed, start, turn, xx=xx) if want else _moved(x, c, xx, squares)


def _merge(parts: list[np.ndarray], dims: int, want: int) -> np.ndarray:
    if want:
        v = np.concatenate(parts)
        return v[np.lexsort(v.T[::-1])[:want]]
    cut = parts[0].shape[1] - dims - 1
    v = np.concatenate(parts)
    return np.concatenate([v[:, :cut].sum(0), v[v[:, cut].argmax(), cut:]])[None]


def _pass(rows: DataFrame, held: dict, seed: int, turn: int, want: int) -> dict:
    """One pass over all rows: (label, start) -> drawn rows, or (``want`` = 0) moments of the clusters round ``held``'s centres.

    A partition sends one row for each label and start."""
    shared = rows.sparkSession.sparkContext.broadcast(held)  # centres of a row a class and start

    def partial(batches):
        held, got, dims = shared.value, {}, 0
        by_label: dict = {}
        for label, start in held:
            by_label.setdefault(label, []).append(start)
        for b in batches:
            if not b.num_rows:
                continue
            labels, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            dims = x.shape[1]
            for label in np.unique(labels):
                mine = labels == label
                for start in by_label.get(int(label), ()):
                    at = int(label), start
                    new = _step(ids[mine], x[mine], held[at], start, seed, turn, want)
                    got[at] = _merge([got[at], new], dims, want) if at in got else new
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.int32()), pa.array([k[1] for k in got], pa.int32()), pa.array([dims] * len(got), pa.int32()), pa.array([len(v) for v in got.values()], pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], names=["label", "start", "dims", "n", "v"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(v).reshape(n, -1) for v, n in sorted(zip(g["v"], g["n"])) if n]
        out = _merge(parts, int(g["dims"].iloc[0]), want) if parts else np.zeros((0, int(g["dims"].iloc[0]) + 1))
        return pd.DataFrame({"label": g["label"].iloc[:1], "start": g["start"].iloc[:1], "n": [len(out)], "v": [out.tobytes()]})

    parts = rows.select("label", "row_id", "x").mapInArrow(partial, "label int, start int, dims int, n int, v binary")
    out = parts.groupBy("label", "start").applyInPandas(whole, "label int, start int, n int, v binary").collect()
    shared.unpersist()
    return {(r["label"], r["start"]): np.frombuffer(bytes(r["v"])).reshape(r["n"], -1) if r["n"] else np.zeros((0, 1)) for r in out}


def _seeds(c: np.ndarray, n: np.ndarray, m: int, seed: int, start: int) -> np.ndarray:
    """m of the candidate centres by k-means++ over the rows that each of them stands for."""
    r = np.random.default_rng([seed, start])
    at = [int(r.choice(len(c), p=n / n.sum()))]
    while len(at) < m:
        d = _squares(c, c[at]).min(1) * n
        d[at] = 0
        left = np.setdiff1d(np.arange(len(c)), at)
        at.append(int(r.choice(len(c), p=d / d.sum())) if d.sum() > 0 else int(left[0]))
    return c[at].copy()


def _fit(step, keys: list[tuple], m: int, seed: int, rounds: int) -> tuple[dict, dict]:
    """Centres and inertia of each (label, start): scalable k-means++ (Bahmani et al., 2012), then Lloyd's rounds.

    ``step(centres, turn, want)`` is a pass over the rows: a few passes draw candidates, one weighs them."""
    c = {at: v[:, 1:] for at, v in step({at: np.zeros((0, 0)) for at in keys}, 0, 1).items()}
    growing = set(c)
    for turn in range(1, DRAWS + 1):
        for at, v in step({at: c[at] for at in growing}, turn, 2 * m).items():
            if len(v):
                c[at] = np.unique(np.concatenate([c[at], v[:, 1:]]), axis=0)
            if len(v) < 2 * m:
                growing.discard(at)  # every distinct vector is a candidate
        if not growing:
            break
    for at, v in step({at: x for at, x in c.items() if len(x) > m}, 0, 0).items():
        k, d = c[at].shape
        c[at] = _seeds(c[at], v[0, k * d : k * d + k], m, seed, at[1])
    cost: dict = {}
    moving, still = set(c), set()
    for turn in range(rounds + 1):
        for at, v in step({at: c[at] for at in moving}, turn, 0).items():
            k, d = c[at].shape
            v = v[0]
            sums, n, (inertia, squares) = v[: k * d].reshape(k, d), v[k * d : k * d + k], v[k * d + k : k * d + k + 2]
            cost[at] = inertia
            if at in still or turn == rounds:
                moving.discard(at)
                continue
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c[at])
            empty = np.flatnonzero(n == 0)
            if len(empty):
                new[empty[0]] = v[-d:]
            elif ((new - c[at]) ** 2).sum() <= STILL * (squares / n.sum() - ((sums.sum(0) / n.sum()) ** 2).sum()) / d:
                still.add(at)
            c[at] = new
        if not moving:
            break
    return c, cost


def _best(c: dict, cost: dict, label: int) -> np.ndarray:
    return c[min((at for at in c if at[0] == label), key=lambda at: (cost[at], at))]


def local_centres(ids: np.ndarray, x: np.ndarray, m: int, seed: int, label: int = 0, starts: int = STARTS, rounds: int = ROUNDS) -> np.ndarray:
    """The centres that ``kmeans_centres`` finds, of one class whose rows are here."""
    xx, squares = (x * x).sum(1), (x * x).sum()  # once for all starts and rounds
    step = lambda held, turn, want: {at: _step(ids, x, c, at[1], seed, turn, want, xx, squares) for at, c in held.items()}
    return _best(*_fit(step, [(label, s) for s in range(starts)], m, seed, rounds), label)


def local_memory(ids: np.ndarray, x: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Places of the rows that a class's memory holds: all if there are at most ``m``, else the member nearest to each centre."""
    if len(x) <= m:
        return np.arange(len(x))
    d = _squares(x, local_centres(ids, x, m, seed))
    at, near = d.argmin(1), d.min(1)
    return np.array([np.flatnonzero(at == j)[near[at == j].argmin()] for j in np.unique(at)])


def kmeans_centres(rows: DataFrame, labels: list[int], m: int, seed: int, starts: int = STARTS, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """label -> min(m, distinct vectors) centres of the best of ``starts`` starts, fitted on all rows (label, row_id, x) of ``labels``.

    Every draw and every round is one pass over the rows for all classes and starts together; the rows are
    kept by the executors meanwhile, and only centres come to the driver."""
    rows = rows.select("label", "row_id", "x").persist()
    try:
        c, cost = _fit(lambda held, turn, want: _pass(rows, held, seed, turn, want) if held else {}, [(label, s) for label in labels for s in range(starts)], m, seed, rounds)
    finally:
        rows.unpersist()
    return {label: _best(c, cost, label) for label in labels}


def kmeans_memory(rows: DataFrame, m: int, seed: int, starts: int = STARTS, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """label, row_id: per class all rows if there are at most ``m``; else the member nearest to each of
    min(m, distinct vectors) cluster centres.

    Rows without a label, and those whose vector is null or holds a null or a number that is not finite,
    are in no memory; a class of vectors of several lengths is an error.  The centres are fitted on all rows of
    a class, from ``starts`` starts: by one task each where a class has ``local_rows`` at most, else by passes
    over the table, with the same draws and rounds.  Every row is then assigned to its nearest centre in
    place, and the nearest member of each cluster is an aggregation over all rows."""
    spark = rows.sparkSession
    x = F.col("x").cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(usable).select(F.col("label").cast("int").alias("label"), F.col("row_id").cast("long").alias("row_id"), x.alias("x"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).collect()  # a row a class
    if ragged := [r["label"] for r in sizes if r["low"] != r["high"]]:
        raise ValueError(f"vectors of several lengths in class {ragged[0]}")
    few, here, large = ([r["label"] for r in sizes if lo < r["n"] <= hi] for lo, hi in ((0, m), (m, max(m, local_rows)), (max(m, local_rows), 1 << 62)))
    found = kmeans_centres(rows.where(F.col("label").isin(large)), large, m, seed, starts) if large else {}
    centres = spark.createDataFrame([(label, v.tolist()) for label, v in sorted(found.items())], "label int, centres array<array<double>>")

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        c = local_centres(g["row_id"].to_numpy(), np.stack(g["x"].to_numpy()), m, seed, int(key[0]), starts)
        return pd.DataFrame({"label": [key[0]], "centres": [c.tolist()]})

    if here:
        centres = centres.union(rows.where(F.col("label").isin(here)).groupBy("label").applyInPandas(fit, "label int, centres array<array<double>>"))
    distance = F.transform("centres", lambda p, i: F.struct(fx.total(F.zip_with("x", p, lambda a, b: (a - b) * (a - b))).alias("d"), i.alias("i")))
    placed = rows.join(F.broadcast(centres), "label").select("label", "row_id", F.array_min(distance).alias("to"))  # a row a class
    picked = placed.groupBy("label", "to.i").agg(F.min_by("row_id", F.struct("to.d", "row_id")).alias("row_id"))
    return rows.where(F.col("label").isin(few)).select("label", "row_id").union(picked.select("label", "row_id"))

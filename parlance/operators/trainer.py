"""The student network and the sequential training harness, in NumPy inside tasks.

One run (track, regime, seed, replicate) is one task; a sweep is a table of runs and scales with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRAINING
from .vectors import local_memory


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def macro_f1(gold: np.ndarray, pred: np.ndarray) -> float:
    """Mean F1 over the classes that occur in gold."""
    scores = []
    for c in np.unique(gold):
        tp, said, have = ((gold == c) & (pred == c)).sum(), (pred == c).sum(), (gold == c).sum()
        scores.append(2 * tp / (said + have) if tp else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def fkd_weights(h: np.ndarray, protos: dict[int, np.ndarray], old: list[int], tau: float) -> np.ndarray:
    p = np.stack([protos[c] for c in old])
    cos = (h / np.linalg.norm(h, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    e = np.exp(cos / tau)
    return e / e.sum(1, keepdims=True)


def fkd_loss(student: np.ndarray, teacher: np.ndarray, s: np.ndarray, y: np.ndarray, old: list[int], seen: np.ndarray, gamma: float) -> tuple[float, np.ndarray]:
    """Loss and its gradient by the student's logits; weights, teacher and focal factor are constants."""
    p = np.exp(log_softmax(np.where(seen, student, -np.inf)))
    focal = (1 - p[np.arange(len(y)), y]) ** gamma
    t = np.exp(log_softmax(teacher[:, old]))
    logq = log_softmax(student[:, old])
    a = s * t * focal[:, None]
    grad = np.zeros_like(student)
    grad[:, old] = (np.exp(logq) * a.sum(1, keepdims=True) - a) / len(y)
    return float(-(a * logq).sum() / len(y)), grad


#: Largest training set (bytes) of a run, and rows of which logits are made at once.
MOST_BYTES, BLOCK = 512 << 20, 8192


class Student:
    """input -> hidden -> ReLU -> dropout -> classes, trained with Adam on masked cross entropy."""

    def __init__(self, dim: int, classes: int, seed: int, hidden: int = TRAINING["hidden"], dropout: float = TRAINING["dropout"]):
        self.r = np.random.default_rng(seed)
        u = lambda a, b: self.r.uniform(-1, 1, (a, b)) / np.sqrt(a)
        self.w = [u(dim, hidden), np.zeros(hidden), u(hidden, classes), np.zeros(classes)]
        self.dropout, self.classes = dropout, classes

    def copy(self) -> list[np.ndarray]:
        return [w.copy() for w in self.w]

    def logits(self, x: np.ndarray, w: list[np.ndarray] | None = None) -> np.ndarray:
        a, b, c, d = w or self.w
        blocks = (x[lo : lo + BLOCK].astype(float, copy=False) for lo in range(0, max(1, len(x)), BLOCK))
        return np.concatenate([np.maximum(v @ a + b, 0) @ c + d for v in blocks])

    def fresh(self) -> None:
        """A new optimiser; its steps work in place."""
        self.m = [np.zeros_like(w) for w in self.w]
        self.v = [np.zeros_like(w) for w in self.w]
        self.room = [(np.empty_like(w), np.empty_like(w)) for w in self.w]
        self.step = 0

    def update(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, extra=None) -> float:
        a, b, c, d = self.w
        x = x.astype(float, copy=False)
        z = x @ a
        z += b
        keep = (self.r.random(z.shape) >= self.dropout) / (1 - self.dropout)
        h = np.maximum(z, 0)
        h *= keep
        logits = h @ c + d
        logp = log_softmax(np.where(mask, logits, -np.inf))
        n = len(y)
        loss = -float(logp[np.arange(n), y].mean())
        g = np.exp(logp)
        g[np.arange(n), y] -= 1
        g /= n
        if extra is not None:
            more, grad = extra(logits)
            loss, g = loss + more, g + grad
        gh = g @ c.T
        gh *= keep
        gh *= z > 0
        self.step += 1
        for w, m, v, (grad, part), (left, right) in zip(self.w, self.m, self.v, self.room, ((x.T, gh), (None, gh), (h.T, g), (None, g))):
            np.matmul(left, right, out=grad) if left is not None else right.sum(0, out=grad)
            m *= 0.9
            m += np.multiply(grad, 0.1, out=part)
            v *= 0.999
            np.multiply(grad, grad, out=grad)
            v += np.multiply(grad, 0.001, out=grad)
            np.divide(m, 1 - 0.9**self.step, out=part)
            part *= TRAINING["lr"]
            np.divide(v, 1 - 0.999**self.step, out=grad)
            np.sqrt(grad, out=grad)
            grad += 1e-8
            part /= grad
            w -= part
        return loss


@dataclass
class Regime:
    """naive; replay, fkd and kd add a stage on the memory of all seen classes after each later task."""

    name: str
    lam: float = TRAINING["lambda"]
    fixed_epochs: int | None = None
    memory: dict[int, np.ndarray] = field(default_factory=dict)
    protos: dict[int, np.ndarray] = field(default_factory=dict)


def train_stage(net: Student, x, y, dev_x, dev_y, mask, extra=None, epochs: int = TRAINING["epochs"], patience: int | None = TRAINING["patience"], balanced: bool = False) -> list[tuple[int, float, float]]:
    """Epochs of shuffled batches; stops after ``patience`` epochs without a strict gain and restores the best weights.

    ``balanced``: an epoch draws len(y) rows with replacement, each with weight 1 / (rows of its class)."""
    net.fresh()
    weight = 1.0 / np.bincount(y)[y] if balanced and len(y) else None
    best, best_w, waited, log = -1.0, net.copy(), 0, []
    for epoch in range(epochs):
        order, total = net.r.permutation(len(y)) if weight is None else net.r.choice(len(y), len(y), p=weight / weight.sum()), 0.0
        for lo in range(0, len(y), TRAINING["batch"]):
            at = order[lo : lo + TRAINING["batch"]]
            total += net.update(x[at], y[at], mask, None if extra is None else (lambda z, at=at: extra(z, at))) * len(at)
        pred = np.where(mask, net.logits(dev_x), -np.inf).argmax(1) if len(dev_y) else np.zeros(0, dtype=int)
        f1 = macro_f1(dev_y, pred)
        log.append((epoch, round(total / max(1, len(y)), 6), round(f1, 6)))
        if patience is None:
            continue
        if f1 > best:
            best, best_w, waited = f1, net.copy(), 0
        else:
            waited += 1
            if waited >= patience:
                break
    if patience is not None:
        net.w = best_w
    return log


def run_sequential(train, dev, test, tasks: list[list[int]], regime: Regime, seed: int, m: int = 10, epochs: int = TRAINING["epochs"], balanced: bool = False) -> dict:
    """Train task by task; after each, record the test predictions under the mask of the seen classes."""
    (x, y), (dx, dy), (tx, ty) = train, dev, test
    classes = max(c for t in tasks for c in t) + 1
    net, out = Student(x.shape[1], classes, seed), {"pred": [], "log": []}
    for t, own in enumerate(tasks):
        seen_classes = sorted(c for k in tasks[: t + 1] for c in k)
        mask = np.isin(np.arange(classes), seen_classes)
        rows, drows = np.isin(y, own), np.isin(dy, own)
        if rows.any():
            out["log"] += [(t, "task", *e) for e in train_stage(net, x[rows], y[rows], dx[drows], dy[drows], mask, epochs=epochs, balanced=balanced)]
        if regime.name != "naive":
            _after_task(net, regime, x, y, dx, dy, own, t, tasks, mask, seed, m, epochs, out)
        out["pred"].append(np.where(mask, net.logits(tx), -np.inf).argmax(1))
    return out


def _after_task(net, regime, x, y, dx, dy, own, t, tasks, mask, seed, m, epochs, out) -> None:
    for c in own:
        rows = np.flatnonzero(y == c)
        if not len(rows):
            continue
        own_x = x[rows].astype(float, copy=False)
        chosen = local_memory(rows, own_x, m, seed)
        regime.memory[c] = rows[chosen]
        beta = TRAINING["beta"]
        regime.protos[c] = (1 - beta) * own_x.mean(0) + beta * own_x[chosen].mean(0)
    if t and regime.memory:
        rows = np.concatenate([regime.memory[c] for c in sorted(regime.memory)])
        extra = None
        if regime.name in ("fkd", "kd") and regime.lam:
            old = sorted(c for k in tasks[:t] for c in k if c in regime.protos)
            s = fkd_weights(x[rows].astype(float, copy=False), regime.protos, old, TRAINING["tau"]) if regime.name == "fkd" else np.ones((len(rows), len(old)))
            teacher = net.logits(x[rows], regime.teacher)
            gamma = TRAINING["gamma"] if regime.name == "fkd" else 0.0

            def extra(z, at):
                loss, grad = fkd_loss(z, teacher[at], s[at], y[rows][at], old, mask, gamma)
                return regime.lam * loss, regime.lam * grad

        seen = mask[dy]
        fixed = regime.fixed_epochs
        log = train_stage(net, x[rows], y[rows], dx[seen], dy[seen], mask, extra, fixed or epochs, None if fixed else TRAINING["patience"])
        out["log"] += [(t, "replay", *e) for e in log]
    regime.teacher = net.copy()


def train_runs(rows: DataFrame, grid: DataFrame, tasks: list[list[int]], m: int = 10, epochs: int = TRAINING["epochs"], balanced: bool = False) -> DataFrame:
    """run_id, stage, row_id, gold, pred of the test rows for each run of ``grid`` (run_id, regime, seed).

    ``rows`` has row_id, part (train/dev/test), x and y: the training set of one small network, whose steps
    follow each other, so every run needs it whole.  It is dealt to the runs by a shuffle, one run a task, and
    held there as its numbers are (single or double precision); none of it passes through the driver.  A set of over
    MOST_BYTES is refused, since no run could hold it.  ``balanced``: each epoch draws as many rows as there
    are, all classes alike."""
    width = 4 if isinstance(rows.schema["x"].dataType.elementType, T.FloatType) else 8
    size = rows.agg(F.sum(F.size("x") * width + 32)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a training set of {size} bytes does not fit one run")
    kind = "run_id string, stage int, row_id long, gold int, pred int"
    runs = [(r["run_id"], r["regime"], int(r["seed"])) for r in grid.select("run_id", "regime", "seed").collect()]  # a row a run
    if not runs:
        return rows.sparkSession.createDataFrame([], kind)

    def run(batches):
        held, slot = {p: [] for p in ("train", "dev", "test")}, None
        for b in batches:
            if not b.num_rows:
                continue
            slot, part = b.column("slot")[0].as_py(), b.column("part").to_numpy(zero_copy_only=False)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, ids = b.column("y").to_numpy(zero_copy_only=False), b.column("row_id").to_numpy()
            for p, got in held.items():
                mine = part == p
                got.append((x[mine], y[mine], ids[mine]))
        if slot is None or not any(len(got[1]) for got in held["train"]):
            return
        train, dev, (tx, ty, ids) = (tuple(np.concatenate(v) for v in zip(*held.pop(p))) for p in ("train", "dev", "test"))
        run_id, regime, seed = runs[slot]
        got = run_sequential(train[:2], dev[:2], (tx, ty), tasks, Regime(regime), seed, m, epochs, balanced)
        for t, pred in enumerate(got["pred"]):
            columns = [pa.repeat(run_id, len(ids)), pa.array(np.full(len(ids), t, np.int32)), pa.array(ids.astype(np.int64)), pa.array(ty.astype(np.int32)), pa.array(pred.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["run_id", "stage", "row_id", "gold", "pred"])

    slots = F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))).alias("slot")
    dealt = rows.select(slots, "row_id", "part", "x", "y").repartitionById(len(runs), "slot").sortWithinPartitions("row_id")
    return dealt.mapInArrow(run, kind)

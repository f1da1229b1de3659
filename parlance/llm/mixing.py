"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that claim them (their pattern), so the flow network
has a node per pattern and per source, however many documents there are.  Words flow from patterns to
source quotas; a pattern offers its words once at no cost and each repetition at a rising cost (a
convex cost, so successive shortest paths are optimal).  The flow says how many words to take from
each pattern; a seeded order of its documents says which.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read_table

#: Times a document may be taken, and the seed.
REPEATS, SEED = 3, 20
#: Least and most bits of the slices that a pattern's seeded order is cut into; partitions that a slice stands for.
LEAST_BITS, MOST_BITS, SLICES_EACH = 12, 17, 16
#: Longest list of patterns that is sent to every task; a longer one is joined in a shuffle.
SEND_ROWS = 50_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: int = REPEATS) -> list[float]:
    """Share ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again."""
    target, open_, left = [0.0] * len(sizes), [k for k in range(len(sizes))], float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / weight for k in open_}
        full = [k for k in open_ if share[k] > most * sizes[k]]
        if not full:
            for k in open_:
                target[k] = share[k]
            break
        for k in full:
            target[k] = float(most * sizes[k])
            left -= target[k]
        open_ = [k for k in open_ if k not in set(full)]
    return target


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Min-cost flow of words: for each pattern (sources, words), the words it sends to each source.

    Nodes: 0 start, patterns, sources, end.  Each pattern has ``repeats`` arcs of its words at cost
    0, 1, 2 ...; the j-th repetition costs more than the one before."""
    p, s = len(patterns), len(quotas)
    end = 1 + p + s
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]  # arcs: to, capacity, cost, reverse

    def arc(a: int, b: int, capacity: int, cost: int) -> list[int]:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    sent: list[dict[int, list[int]]] = []
    for i, (sources, words) in enumerate(patterns):
        for cost in range(repeats):
            arc(0, 1 + i, words, cost)
        sent.append({k: arc(1 + i, 1 + p + k, repeats * words, 0) for k in sources})
    for k, q in enumerate(quotas):
        arc(1 + p + k, end, q, 0)
    potential = [0] * (end + 1)
    while True:
        far, via = [None] * (end + 1), [None] * (end + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for j, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity > 0 and (far[b] is None or d + cost + potential[a] - potential[b] < far[b]):
                    far[b] = d + cost + potential[a] - potential[b]
                    via[b] = (a, j)
                    heapq.heappush(heap, (far[b], b))
        if far[end] is None:
            break
        potential = [x + (d or 0) if d is not None else x for x, d in zip(potential, far)]
        path, b = [], end
        while b:
            a, j = via[b]
            path.append(graph[a][j])
            b = a
        flow = min(x[1] for x in path)
        for x in path:
            x[1] -= flow
            graph[x[0]][x[3]][1] += flow
    return [{k: repeats * words - a[1] for k, a in out.items()} for (_, words), out in zip(patterns, sent)]


def mix(docs: DataFrame, memberships, size, id_col: str = "doc_id", weights: list[float] | None = None, repeats: int = REPEATS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, size, pattern, source_size, target, taken, and the columns of ``docs`` in ``keep``.

    ``memberships`` is a column of array<string> (null stands for a source of its own, after the
    others), ``size`` a long column.  Kept columns stay with their rows: only rows of the one slice of a
    pattern where its words run out are dealt anew.  ``weights`` go to the sources in code-point order, repeating
    (default 1, 2, 3).  The sources share the summed size of all of them; a target stops at ``repeats``
    times its source's size.  ``taken`` counts words, repeats included, at most ``repeats`` times the
    row's size.  Of each pattern, whole repetitions go to every row; the remainder goes to its rows in
    seeded order, the last of which may be taken in part, so that each pattern gives just the words
    that the flow asks of it.  The order is cut into slices by its leading bits, more of them for larger
    tables, and only the slice in which a pattern runs out is ordered row by row; which rows are taken does
    not depend on the number of slices.  Patterns, not rows, go to the driver.  An empty table gives no rows; rows of size 0 give 0.  For rows of
    several sources, ``source_size`` and ``target`` are the sums over them."""
    spark = docs.sparkSession
    prepare(spark)
    label = F.transform(memberships, lambda s: F.struct(s.isNull().alias("missing"), F.coalesce(s, F.lit("")).alias("name")))
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    names = [f"kept_{k}" for k in range(len(keep))]
    base = docs.select(*kept, F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(label)).alias("pattern"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"))
    order = F.xxhash64("id", "size", F.lit(seed))
    bits = min(MOST_BITS, max(LEAST_BITS, (SLICES_EACH * docs.rdd.getNumPartitions()).bit_length()))
    base = base.select("*", order.alias("place"), F.shiftrightunsigned(order, 64 - bits).alias("slice"))
    if not keep:
        base = base.checkpoint()
    # a row a pattern and slice, whatever the number of documents
    slices = base.groupBy("pattern", "slice").agg(F.sum("size").alias("words")).checkpoint()
    totals = slices.groupBy("pattern").agg(F.sum("words").alias("words")).collect()
    patterns = sorted((tuple((x["missing"], x["name"]) for x in r["pattern"]), int(r["words"])) for r in totals)
    sources = sorted({s for p, _ in patterns for s in p})
    at = {s: k for k, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for p, words in patterns:
        for s in p:
            sizes[at[s]] += words
    cycle = weights or [1, 2, 3]
    targets = water_fill(sizes, [cycle[k % len(cycle)] for k in range(len(sources))], sum(sizes), repeats)
    routed = route([(tuple(at[s] for s in p), words) for p, words in patterns], [round(t) for t in targets], repeats)

    # of each pattern: whole repetitions for all, and the words left over
    plan = []
    for (p, words), flow in zip(patterns, routed):
        copies, rest = divmod(sum(flow.values()), words) if words else (0, 0)
        plan.append(([{"missing": m, "name": n} for m, n in p], copies, rest, sum(sizes[at[s]] for s in p), float(sum(targets[at[s]] for s in p))))
    schema = "pattern array<struct<missing: boolean, name: string>>, copies long, rest long, source_size long, target double"
    plan = spark.createDataFrame(plan, schema)

    from pyspark.sql import Window

    running = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    send = F.broadcast if len(patterns) <= SEND_ROWS else lambda t: t  # a row a pattern
    edges = slices.join(send(plan.select("pattern", "rest")), "pattern")
    edges = edges.select("pattern", "slice", "rest", "words", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before"))
    edge = edges.where("before <= rest AND before + words > rest").select("pattern", "slice", (F.col("rest") - F.col("before")).alias("left"))
    plan = plan.join(edge, "pattern", "left").select("pattern", "copies", "rest", "source_size", "target", F.coalesce("slice", F.lit(-1)).alias("edge"), F.coalesce("left", F.lit(0)).alias("left")).checkpoint()

    rows = base.join(send(plan), "pattern")
    whole = F.when((F.col("rest") > 0) & (F.col("slice") < F.col("edge")), F.col("size")).otherwise(0)
    rows = rows.withColumn("fixed", F.col("copies") * F.col("size") + whole)
    inner = Window.partitionBy("pattern").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.where("slice = edge").withColumn("ahead", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("ahead")))
    cols = [*names, "id", "size", "pattern", "source_size", "target"]
    within = within.select(*cols, (F.col("fixed") + part).alias("taken"))
    out = rows.where("slice <> edge").select(*cols, F.col("fixed").alias("taken")).union(within)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *([] if id_col in keep else [F.col("id").alias(id_col)]), "size", "pattern", "source_size", "target", "taken")


def word_count(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = mix(docs, F.array("source"), word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")

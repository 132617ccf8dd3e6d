"""Filling fixed-capacity containers with items (problem 8).

Method: linear grouping scheme. Only sizes matter for a plan, so it is made from the histogram of sizes, which has at most
``capacity`` entries however many documents there are:

1. large lengths are put, in descending order, into ``GROUPS`` groups of equal cardinality and rounded up to the group's largest;
2. a linear programme over configurations (how many of each rounded length share a container) is solved by column
   generation; whole multiples of its configurations are used;
3. actual lengths are substituted: a configuration's places are filled from its groups in order of length;
4. what is left, and all small lengths, go by best fit into the gaps, longest first, new containers being opened as needed.

The plan is a list of *runs*: so many containers with the same content (a length, how often). Documents of a length are
numbered without gathering them (hashed buckets, counted first), and a document's number in its length's order gives its
container and place by binary search in the runs.

A document longer than the capacity is cut into full pieces and one rest, and only such a document is cut. Documents
without tokens (null or empty texts) need no room: they are laid behind the others, evenly over the containers, so every
document has a row. No documents give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidewatch.llm.p7_encode import TOKENIZER, token_counts
from tidewatch.session import materialize
from tidewatch.tables import table

GROUPS = 32
#: Lengths above capacity / SMALL are large.
SMALL = 8
#: Steps of the capacity in the configurations' knapsack.
STEPS = 1024
BUCKETS = 512


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, items of each size): whole multiples of the optimal configurations of the linear programme.
    ``sizes`` differ and none is above the capacity."""
    unit = max(1, capacity // STEPS)
    room = capacity // unit
    w = np.array([min(room, -(-s // unit)) for s in sizes])
    k = len(sizes)
    need = np.array(counts, float)
    columns = [np.where(np.arange(k) == i, room // w[i], 0) for i in range(k)]
    basis = list(range(k))
    inverse = np.diag(1.0 / np.array([columns[i][i] for i in range(k)], float))
    x = inverse @ need
    for _ in range(40 * k):
        price = np.maximum(inverse.sum(axis=0), 0.0)
        best, pick = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):
            best[c] = best[c - 1]
            fits = np.flatnonzero(w <= c)
            if len(fits):
                value = best[c - w[fits]] + price[fits]
                top = int(value.argmax())
                if value[top] > best[c] + 1e-12:
                    best[c], pick[c] = value[top], fits[top]
        if best[room] <= 1 + 1e-7:
            break
        column, c = np.zeros(k, int), room
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= w[pick[c]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns.append(column)
        basis[out] = len(columns) - 1
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        x = np.maximum(x - direction * ratio[out], 0)
        x[out] = ratio[out]
    return [(int(np.floor(v + 1e-7)), list(map(int, columns[b]))) for v, b in zip(x, basis) if v >= 1 - 1e-7]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Histogram of sizes (1 ... capacity) -> runs (how many containers, [(size, times), ...])."""
    left = {s: n for s, n in histogram.items() if n > 0}
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    if left.get(capacity):
        runs.append((left.pop(capacity), [(capacity, 1)]))
    large = sorted((s for s in left if s * SMALL > capacity), reverse=True)
    if large:
        # 1. Groups of equal cardinality, each a queue of [size, count] in descending order.
        total = sum(left[s] for s in large)
        per = -(-total // min(GROUPS, total))
        groups, room = [], 0
        for s in large:
            n = left.pop(s)
            while n:
                if not room:
                    groups.append([])
                    room = per
                m = min(n, room)
                groups[-1].append([s, m])
                n, room = n - m, room - m
        tops: dict[int, list] = {}
        for g in groups:  # groups with the same largest size are one size of the programme
            tops.setdefault(g[0][0], []).extend(g)
        sizes = list(tops)
        queues = [tops[s] for s in sizes]
        # 2. and 3.
        for times, config in configurations(sizes, [sum(n for _, n in q) for q in queues], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            stock = [sum(n for _, n in q) for q in queues]
            times = min([times, *[stock[g] // config[g] for g in set(slots)]])
            taken = []
            for g in slots:
                want, parts = times, []
                while want:
                    m = min(want, queues[g][0][1])
                    parts.append([queues[g][0][0], m])
                    queues[g][0][1] -= m
                    want -= m
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                taken.append(parts)
            while times:
                m = min(p[0][1] for p in taken)
                content: dict[int, int] = defaultdict(int)
                for p in taken:
                    content[p[0][0]] += 1
                    p[0][1] -= m
                    if not p[0][1]:
                        p.pop(0)
                runs.append((m, list(content.items())))
                times -= m
        for q in queues:
            for s, n in q:
                left[s] = left.get(s, 0) + n
    # 4. Best fit, longest first: the fullest containers that still take the size, as often as they take it.
    gaps: dict[int, list] = defaultdict(list)
    for m, content in runs:
        gaps[capacity - sum(s * n for s, n in content)].append((m, content))
    for s in sorted(left, reverse=True):
        n = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            if not n:
                break
            each, waiting, stay = gap // s, gaps.pop(gap), []
            while waiting:
                m, content = waiting.pop()
                full = min(m, n // each)
                if full:
                    gaps[gap - each * s].append((full, [*content, (s, each)]))
                    n -= full * each
                    m -= full
                if m and n:  # fewer than `each` are left: one more container takes them all
                    gaps[gap - n * s].append((1, [*content, (s, n)]))
                    m, n = m - 1, 0
                if m:
                    stay.append((m, content))
            gaps[gap].extend(stay)
            if not gaps[gap]:
                del gaps[gap]
        if n:
            each = capacity // s
            if n >= each:
                gaps[capacity - each * s].append((n // each, [(s, each)]))
            if n % each:
                gaps[capacity - (n % each) * s].append((1, [(s, n % each)]))
    return [run for gap in sorted(gaps) for run in gaps[gap]]


def entries(runs: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Sorted (size << 40 | first number), and of each: first container, times a container, first place; and, last, the
    runs' first containers and contents' lengths (with the number of containers at the end)."""
    used: dict[int, int] = defaultdict(int)
    rows, firsts, lengths, container = [], [], [], 0
    for m, content in runs:
        place = 0
        merged: dict[int, int] = defaultdict(int)
        for s, n in content:
            merged[s] += n
        for s, n in merged.items():
            rows.append(((s << 40) | used[s], container, n, place))
            used[s] += m * n
            place += n
        firsts.append(container)
        lengths.append(place)
        container += m
    rows.sort()
    e = np.array(rows, np.int64).reshape(-1, 4)
    return e[:, 0], e[:, 1], e[:, 2], e[:, 3], np.array([*firsts, container], np.int64), np.array([*lengths, 0], np.int64)


def numbered(items: DataFrame, group: list[str], unique: list[str]) -> DataFrame:
    """Add ``number``, 0, 1, ... within each ``group``, without gathering a group in one task."""
    x = items.withColumn("_bucket", F.pmod(F.xxhash64(*unique), F.lit(BUCKETS)))
    count = x.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = count.select(*group, "_bucket", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = x.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*unique)))
    return inside.join(before, [*group, "_bucket"]).withColumn("number", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def packed(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sizes`` (id_col, n_tokens) and ``targets`` (target_name, capacity_tokens) -> one row for each document or piece:
    target_name, id_col, piece_no, n_tokens, container, position (both from 0). A null or negative size counts as 0, a
    target without a positive capacity has no rows."""
    spark = sizes.sparkSession
    goals = [(r["target_name"], int(r["capacity_tokens"])) for r in targets.select("target_name", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("capacity_tokens", "target_name").collect()]
    size = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    base = sizes.select(F.col(id_col), size.alias("size"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("target"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(goals)]))
    schema = T.StructType([T.StructField("target_name", T.StringType()), sizes.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("piece_no", "n_tokens", "container", "position")]])
    if not goals:
        return spark.createDataFrame([], schema)
    cut = base.select(id_col, "size", each.alias("g")).select(F.col("g.target").alias("target"), id_col, "size", F.col("g.capacity").alias("capacity"))
    pieces = cut.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0)))))
    items = pieces.select("target", id_col, "piece_no", F.least(F.col("capacity"), F.col("size") - F.col("piece_no") * F.col("capacity")).alias("size"))
    histograms: list[dict[int, int]] = [{} for _ in goals]
    for r in items.groupBy("target", "size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # capacity + 1 rows a target at most
        histograms[r["target"]][int(r["size"])] = r["n"]
    made = [entries(plan({s: n for s, n in h.items() if s}, c)) for h, (_, c) in zip(histograms, goals)]
    shared = spark.sparkContext.broadcast(made)
    names = [g for g, _ in goals]
    fields = [f.name for f in schema]

    def run(batches):
        for b in batches:
            target, sz, number = (b.column(i).to_numpy() for i in (0, 3, 4))
            container, position = np.zeros(len(target), np.int64), np.zeros(len(target), np.int64)
            for t in np.unique(target):
                key, first, times, place, firsts, lengths = shared.value[t]
                of = np.flatnonzero((target == t) & (sz > 0))
                if len(of):
                    at = np.searchsorted(key, (sz[of] << 40) | number[of], "right") - 1
                    step = number[of] - (key[at] & ((1 << 40) - 1))
                    container[of] = first[at] + step // times[at]
                    position[of] = place[at] + step % times[at]
                of = np.flatnonzero((target == t) & (sz == 0))
                if len(of):
                    many = max(1, firsts[-1])
                    container[of] = number[of] % many
                    position[of] = number[of] // many + lengths[np.searchsorted(firsts, container[of], "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in target]), b.column(1), b.column(2), b.column(3), pa.array(container), pa.array(position)], names=fields)

    return numbered(items, ["target", "size"], [id_col, "piece_no"]).select("target", id_col, "piece_no", "size", "number").mapInArrow(run, schema)


def packing_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens, the least possible number of containers, and the unused share."""
    got = rows.groupBy("target_name").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return got.join(targets.select("target_name", "capacity_tokens").distinct(), "target_name").select(
        "target_name",
        "capacity_tokens",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )


def document_sizes(spark: SparkSession, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    return materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", path), "p8-sizes")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(document_sizes(spark, sf_dir), table(spark, sf_dir, "pack_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_targets"))

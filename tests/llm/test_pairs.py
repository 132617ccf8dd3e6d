"""Near-duplicates, split overlap, batch index and grouped splits against brute force, and their edge cases."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import p2_split_overlap as p2
from tidewatch.llm import p3_history as p3
from tidewatch.llm import p4_grouped_splits as p4
from tidewatch.llm import p5_near_duplicates as p5
from tidewatch.llm import wordset as ws
from tidewatch.llm.forest import components, spanning_forest
from tidewatch.session import shared_path

T0 = datetime(2026, 1, 1)


def bag(text):
    return Counter(regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()))


def close(a, b, t=0.7):
    x, y = bag(a), bag(b)
    if min(sum(x.values()), sum(y.values())) < 15:
        return False
    return sum((x & y).values()) / sum((x | y).values()) >= t - 1e-12


def corpus(n=120, seed=1, vocabulary=400):
    """Families of texts with edits, copies, short, empty and null ones."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{int(rnd.paretovariate(0.6)) % vocabulary}" for _ in range(rnd.randrange(10, 60))]
        for _ in range(rnd.randrange(1, 5)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 4)):
                i = rnd.randrange(len(w))
                op = rnd.randrange(3)
                w[i : i + 1] = [] if op == 0 else [f"e{rnd.randrange(9999)}"] if op == 1 else [w[i], w[i]]
            if rnd.random() < 0.2:
                rnd.shuffle(w)
            out.append(" ".join(w) or None)
    out = out[:n] + [None, "", "   ", "short text", out[0], out[0], out[0].upper() if out[0] else "x"]
    return [(f"id{i:04d}", t) for i, t in enumerate(out)]


def brute(rows):
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] < b[0] and close(a[1], b[1])}


@pytest.mark.parametrize("hot", [ws.HOT, 2, 0])
def test_pairs_are_exact_whatever_is_hot(spark, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, content string")
    got = {(r.id_a, r.id_b) for r in p5.close_pairs(df, hot=hot).collect()}
    assert got == brute(rows) and len(got) > 20


def test_classes_and_groups(spark):
    rows = corpus(60, 2)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id string, content string, cls string, n int").union(spark.createDataFrame([(*rows[0], "y", 2)], "id string, content string, cls string, n int"))
    got = {r.id: r for r in p5.near_duplicate_classes(df).collect()}
    pairs, links = brute(rows), Counter()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert set(got) == {i for i, _ in rows}
    assert all(got[i].n_links == links[i] and got[i].group_id == find(i) for i, _ in rows)


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, content string")
    assert p5.close_pairs(empty).count() == 0 and p5.near_duplicate_classes(empty).count() == 0
    nothing = spark.createDataFrame([("a", None), ("b", "")], "id string, content string")
    assert p5.close_pairs(nothing).count() == 0
    assert {(r.id, r.class_id, r.n_links) for r in p5.near_duplicate_classes(nothing).collect()} == {("a", "a", 0), ("b", "b", 0)}


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " tail"), ("c", "x" * 500_000)], "id string, content string")
    assert [tuple(r) for r in p5.close_pairs(df).collect()] == [("a", "b")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=15, max_size=60), st.lists(st.integers(0, 30), min_size=15, max_size=60), st.integers(0, 3), st.integers(0, 1), st.booleans())
def test_close_multisets_share_a_block(a, b, hot, cheap, useful):
    import numpy as np

    x, y = Counter(a), Counter(b)
    n, m, o = len(a), len(b), sum((x & y).values())
    ea, eb = (np.array(sorted(w * 64 + k for w, c in z.items() for k in range(c)), np.uint32) for z in (x, y))
    freq = np.zeros(ws.BUCKETS, np.int32)
    for e in (ea, eb):
        np.add.at(freq, e & np.uint32(ws.BUCKETS - 1), 1)
    splits, both, off = [], np.concatenate([ea, eb]), np.array([0, len(ea), len(ea) + len(eb)])
    for level in range(1, ws.LEVELS + 1):
        key, parent, short, long, further = ws.count_blocks(both, off, freq, 0.7, splits, level, hot)
        large = long > hot
        if splits and useful:
            splits[-1] = ws.keep_useful(splits[-1], parent[large], (short * long)[large])
        splits.append(ws.decide(key[large], short[large], long[large], further[large] * cheap, hot, level < ws.LEVELS))
    cls = np.array([5, -7])
    rec, key, _ = ws.block_rows(both, off, cls, freq, 0.7, splits)
    stored = set(ws.block_rows(ea, off[:2], cls[:1], freq, 0.7, splits, "stored")[1].tolist())
    probe = set(ws.block_rows(eb, np.array([0, len(eb)]), cls[1:], freq, 0.7, splits, "probe")[1].tolist())
    if o / (n + m - o) >= 0.7:
        assert set(key[rec == 0].tolist()) & set(key[rec == 1].tolist())
        assert stored & probe


def test_blocks_stay_bounded_whatever_the_counters_say(spark):
    """One word in all texts, a family of alike texts, and counters that are all full."""
    import numpy as np

    rnd = random.Random(9)
    family = [f"f{i}" for i in range(40)]
    texts = [" ".join(["common", *(rnd.choice(["a", "b", "c"]) + str(rnd.randrange(60)) for _ in range(39))]) for _ in range(400)]
    texts += [" ".join(["common", *(w for w in family if rnd.random() > 0.1)]) for _ in range(120)]
    rows = [(f"id{i:04d}", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string")
    fp = p5.fingerprint_table(df)
    want = brute(rows)
    for freq in (ws.frequency_table(fp), np.full(ws.BUCKETS, 2**31 - 1, np.int32)):
        splits = ws.find_splits(fp, freq, hot=32)
        made = ws.blocks(fp, freq, splits)
        side = made.groupBy("key").agg(F.count_if(ws.has_side(F.col("np"), ws.SHORT)).alias("short"), F.count_if(ws.has_side(F.col("np"), ws.LONG)).alias("long"))
        top = side.agg(F.max("short"), F.max("long")).first()
        assert max(top) <= 64  # parts of a hashed grid: about `hot` a side
        assert made.count() < 120 * len(rows)
        close_classes = p5.rerank(ws.met(made, 0.7), fp, 0.7)
        ids = fp.select("cls", "id").toPandas().groupby("cls")["id"].apply(list).to_dict()
        got = {tuple(sorted((i, j))) for r in close_classes.collect() for i in ids[r.a] for j in ids[r.b]}
        got |= {tuple(sorted((i, j))) for own in ids.values() for i in own for j in own if i < j}
        assert got == want


def test_many_copies_are_joined_in_parts(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(f"id{i:03d}", text + (" more" if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, content string")
    fp = p5.fingerprint_table(df)
    got = [tuple(r) for r in p5.expand(p5.class_pairs(fp), fp, most=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 and set(got) == brute(rows)


def test_split_overlap(spark):
    rows = corpus(150, 3)
    rnd = random.Random(1)
    labelled = [(i, t, rnd.choice(["train", "train", "val", "test", None, "other"])) for i, t in rows]
    df = spark.createDataFrame(labelled + labelled[:3], "id string, text string, split string")
    split = {i: s for i, _, s in labelled}
    want = {p for p in brute(rows) if {split[p[0]], split[p[1]]} & {"train"} and {split[p[0]], split[p[1]]} & {"val", "test"} and split[p[0]] != split[p[1]]}
    pairs = p2.overlap_pairs(df)
    got = {tuple(sorted((r.train_id, r.eval_id))) for r in pairs.collect()}
    assert got == want and got
    report = p2.overlap_report(pairs, spark.createDataFrame([(i, " Src ") for i, _ in rows[:75]], "id string, source_name string")).collect()
    assert sum(r.n_pairs for r in report) == len(want) and {r.source_name for r in report} <= {"src", ""}
    assert p2.overlap_pairs(df.where("1 = 0")).count() == 0


def test_history_in_one_call_or_batch_by_batch(spark):
    rows = corpus(140, 4)
    history = spark.createDataFrame([(i, t, T0) for i, t in rows[:60]], "id string, content string, collected_at timestamp")
    rnd = random.Random(2)
    batches = [(i, t, None if k % 17 == 0 else T0 + timedelta(hours=rnd.randrange(5)), 1 + k % 3) for k, (i, t) in enumerate(rows[60:])]
    df = spark.createDataFrame(batches, "id string, content string, collected_at timestamp, batch_no int")
    order = sorted(batches, key=lambda b: (b[3], b[2] is not None, b[2] or T0, b[0]))
    before, want = list(rows[:60]), set()
    for b in order:
        if any(close(b[1], t) for _, t in before):
            want.add(b[0])
        before.append(b[:2])
    at_once = p3.CellIndex(spark, shared_path(spark, "t3")).build(history)
    assert {r.id for r in at_once.add(df, 1).collect()} == want and want
    stepwise, got = p3.CellIndex(spark, shared_path(spark, "t3")).build(history), set()
    for n in (1, 2, 3):
        reopened = p3.CellIndex(spark, stepwise.path)  # only what is persisted
        got |= {r.id for r in reopened.add(df.where(f"batch_no = {n}"), n).collect()}
    assert got == want


def test_empty_history(spark):
    schema = "id string, content string, collected_at timestamp"
    index = p3.CellIndex(spark, shared_path(spark, "t3")).build(spark.createDataFrame([], schema))
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("a", text, T0, 1), ("b", text, T0, 1), ("c", None, T0, 1)], schema + ", batch_no int")
    assert [r.id for r in index.add(df, 1).collect()] == ["b"]


def test_forest_and_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(4)) for _ in range(70)]
    labels, forest = spanning_forest(spark.createDataFrame(edges + [(None, 1, 1)], "u bigint, v bigint, w bigint"))
    got = {r.node: r.component for r in labels.collect()}
    parent = {x: x for e in edges for x in e[:2]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = 0
    for u, v, w in sorted(edges, key=lambda e: e[2]):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            weight += w
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in parent for b in parent if find(a) == find(b)}
    rows = forest.collect()
    assert len(rows) == len(parent) - len({find(x) for x in parent}) and sum(r.w for r in rows) == weight
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def _tables(spark, stage1, raw, edges):
    return (
        spark.createDataFrame([(i, "extra") for i in stage1], "id string, source_name string"),
        spark.createDataFrame(raw, "id string, source_name string, author string"),
        spark.createDataFrame(edges, "source_id string, properties map<string,string>"),
        spark.createDataFrame([("admin",), (None,)], "handle string"),
    )


def test_groups(spark):
    raw = [("1", " Alpha", None), ("2", "@ALPHA ", "bob"), ("3", "beta", "@Bob"), ("4", "gamma", "Admin"), ("5", "delta", "admin"), ("6", None, "  "), ("7", None, "zed"), ("8", "epsilon", None), ("9", "omega", "bob"), ("3", "beta", "@Bob")]
    edges = [("e1", {"raw_content_id": "4"}), ("e1", {"raw_content_id": "8"}), ("e2", None), (None, {"raw_content_id": "5"})]
    args = _tables(spark, ["1", "2", "3", "4", "5", "6", "7", "8", "1"], raw, edges)
    got = {r.id: r.group_key for r in p4.linked_groups(*args).collect()}
    assert got == {"1": "alpha", "2": "alpha", "3": "alpha", "4": "epsilon", "8": "epsilon", "5": "delta", "6": None, "7": None}
    out = p4.assign_splits(*args)
    by = {}
    for r in out.collect():
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and out.count() == 8
    assert p4.linked_groups(*_tables(spark, [], [], [])).count() == 0
    assert p4.assign_splits(*_tables(spark, [], [], [])).count() == 0


def test_deal_keeps_proportions(spark):
    rnd = random.Random(3)
    sizes = [5000, 900, 400] + [rnd.randrange(1, 30) for _ in range(4000)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "component bigint, size bigint")
    got = p4.deal(groups).groupBy("split").sum("size").collect()
    share = {r[0]: r[1] / sum(sizes) for r in got}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["val"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert p4.deal(groups).count() == len(sizes)

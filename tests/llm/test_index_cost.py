"""What a batch reads of the index, batch by batch, and orders made anew."""

import random
from datetime import datetime, timedelta

from tidewatch.llm import p3_history as p3
from tidewatch.llm import wordset as ws
from tidewatch.session import shared_path

T0 = datetime(2026, 1, 1)
SCHEMA = "id string, content string, collected_at timestamp"


def rows_read(spark) -> int:
    """Rows that all stages so far took from tables."""
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return [" ".join(f"w{int(rnd.paretovariate(0.6)) % 50_000}" for _ in range(40)) for _ in range(n)]


def test_a_small_batch_does_not_read_the_history(spark):
    old = texts(20_000, 1)
    history = spark.createDataFrame([(f"h{i:06d}", x, T0) for i, x in enumerate(old)], SCHEMA).repartition(4)
    index = p3.CellIndex(spark, shared_path(spark, "t3"), buckets=4, group_bytes=1 << 15).build(history)
    stored = spark.table(index._cells(0, 4)).count()
    assert stored > 200_000
    read = []
    for batch, at in ((1, 100), (2, 7000), (3, 15_000)):
        rows = [(f"b{batch}-0", old[at] + " more", T0 + timedelta(1), batch), (f"b{batch}-1", texts(1, batch + 50)[0], T0 + timedelta(1), batch)]
        before = rows_read(spark)
        assert [r.id for r in index.add(spark.createDataFrame(rows, SCHEMA + ", batch_no int"), batch).collect()] == [f"b{batch}-0"]
        read.append(rows_read(spark) - before)
    # Row groups that can hold one of the about 30 keys, or one of the few classes looked up; never all cells or vectors.
    assert max(read) < stored / 4, (read, stored)


def test_order_made_anew(spark):
    old, new = texts(40, 2), texts(150, 3)
    index = p3.CellIndex(spark, shared_path(spark, "t3"), hot=4, buckets=2).build(spark.createDataFrame([(f"h{i}", x, T0) for i, x in enumerate(old)], SCHEMA))
    first = spark.createDataFrame([(f"n{i:03d}", x, T0, 1) for i, x in enumerate(new)], SCHEMA + ", batch_no int")
    assert index.add(first, 1).count() < 5  # few of these are alike by chance
    assert index._load()[0] == 1  # the index has more than doubled
    again = p3.CellIndex(spark, index.path, hot=4, buckets=2)
    second = spark.createDataFrame([("a", new[7] + " x", T0, 2), ("b", old[3], T0, 2), ("c", "y " + old[3], T0, 3), ("d", texts(1, 9)[0], T0, 3)], SCHEMA + ", batch_no int")
    assert {r.id for r in again.add(second, 2).collect()} == {"a", "b", "c"}


def test_batches_in_any_order(spark):
    text = texts(1, 4)[0]
    index = p3.CellIndex(spark, shared_path(spark, "t3"), buckets=2).build(spark.createDataFrame([], SCHEMA))
    batch = lambda i, n, x: spark.createDataFrame([(i, x, T0, n)], SCHEMA + ", batch_no int")
    assert index.add(batch("late", 5, text), 1).count() == 0
    assert index.add(batch("early", 2, text), 2).count() == 0  # nothing before it
    assert [r.id for r in index.add(batch("between", 3, text + " x"), 3).collect()] == ["between"]


def test_balls_cannot_be_skipped(spark):
    df = spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(texts(600, 5))], "id string, text string")
    assert 0 <= p3.ball_cells_skipped(ws.fingerprints(df, "text", ["id"]), 50, 50) <= 1

"""Batches come after history, whatever their number; those without one come last."""

from datetime import datetime

from tidewatch.llm import p3_history as p3
from tidewatch.session import shared_path

T0 = datetime(2026, 1, 1)


def test_null_and_negative_batch_numbers(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    history = spark.createDataFrame([("h", a, T0)], "id string, content string, collected_at timestamp")
    rows = [("n1", a, T0, None), ("n2", a, T0, -7), ("n3", b, T0, None), ("n4", b, T0, -7), ("n5", b, T0, 1), ("n6", c, None, None), ("n7", c, T0, None)]
    df = spark.createDataFrame(rows, "id string, content string, collected_at timestamp, batch_no int")
    index = p3.CellIndex(spark, shared_path(spark, "t3")).build(history)
    assert {r.id for r in index.add(df, 1).collect()} == {"n1", "n2", "n3", "n5", "n7"}

"""Close pairs across splits that share stock words and differ in rare ones."""

import random

from tidewatch.llm import p2_split_overlap as p2


def test_stock_phrases_with_rare_edits(spark):
    stock = [f"s{i}" for i in range(140)]
    rnd, rows = random.Random(5), []
    for k in range(400):  # 70 words of the stock and 15 of its own: similarity 0.7 within a pair, far less across pairs
        common = rnd.sample(stock, 70)
        for side, split in (("a", "train"), ("b", "val")):
            rows.append((f"{side}{k}", " ".join([*common, *[f"r{side}{k}x{i}" for i in range(15)]]), split))
    df = spark.createDataFrame(rows, "id string, text string, split string")
    sets = {i: set(t.split()) for i, t, _ in rows}
    train, held = [i for i in sets if i[0] == "a"], [i for i in sets if i[0] == "b"]
    want = {(a, b) for a in train for b in held if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-12}
    assert {(f"a{k}", f"b{k}") for k in range(400)} <= want
    assert {(r.train_id, r.eval_id) for r in p2.overlap_pairs(df).collect()} == want

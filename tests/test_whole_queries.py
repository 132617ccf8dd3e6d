"""Queries without SQL over whole tables, against brute force over small folders."""

from tidewatch.plans import registry_more  # noqa: F401
from tidewatch.plans.registry import QUERIES


def folder(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_char_grams_of_whole_texts(spark, tmp_path):
    texts = ["Ein Text, der länger als vierzig Zeichen ist, mit Ende am Ende", "Слив базы " * 30, "数据库" * 20, "🔥" * 45, "abc", "ab", "a", "", None]
    d = folder(spark, tmp_path, "stage1", [(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    want = {}
    for i, t in enumerate(texts):
        x = (t or "").lower()
        grams = [x[k : k + n] for n in (2, 3, 4, 5) for k in range(len(x) - n + 1)]
        want[str(i)] = (len(grams), len(set(grams)))
    got = {r.id: (r.grams, r.different) for r in QUERIES["char_grams"](spark, d).collect()}
    assert got == want and got["0"][0] == 61 + 60 + 59 + 58


def test_noise_flags_of_all_rows(spark, tmp_path):
    noise = [None, "", "   ", "\t\n", "@handle_x", "https://", "12345 !!!", "🔥🔥🔥", "example.com", "user:hunter22", "kurz", "1.2.3.4"]
    kept = ["ein ausreichend langer Text", "45.155.205.99", "1.2.3.4 CVE-2026-12345", "продам доступ к почтовому шлюзу", "出售最新的客户数据库与账号密码等等"]
    rows = [(f"n{i}", t) for i, t in enumerate(noise)] + [(f"k{i}", t) for i, t in enumerate(kept)]
    d = folder(spark, tmp_path, "raw_content", rows, "id string, content string")
    got = {r.id: r.is_noise for r in QUERIES["noise_flags_whole"](spark, d).collect()}
    assert got == {i: i.startswith("n") for i, _ in rows}

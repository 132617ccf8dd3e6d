import gzip
import json
import random
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import plug
from tidewatch.functions.text import Rule
from tidewatch.plans import config, nlsql
from tidewatch.sources import feeds
from tidewatch.streaming import pipeline as st

PAGE = """<html><body><a href="/AbCd1234">x</a> <a href='https://p.su/paste/1'>y</a> <a href="#top">z</a> <a href="javascript:x()">q</a> <a href="/AbCd1234">again</a> <a href="/about">no</a>
<div class="post"><span class="who">Ann</span><div class="text">Hello <b>all</b></div></div><div class="post"><span class="who">Bob</span><div class="text">Bye</div></div><script>var a=1;</script></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "html string")
    r = df.select(feeds.page_links(F.col("html"), F.lit("https://b.su/"), pastes_only=True).alias("p"), feeds.page_links(F.col("html"), F.lit("https://b.su"), most=2).alias("a")).collect()
    assert r[0].p == ["https://b.su/AbCd1234", "https://p.su/paste/1"] and len(r[0].a) == 2 and r[1].p == []
    x = df.where("html is not null").select(feeds.scraped(F.col("html"), "div.text").alias("t"), feeds.forum_posts(F.col("html"), ".text", ".who").alias("f"), feeds.selected_links(F.col("html"), "a", "https://b.su/").alias("l")).first()
    assert x.t == ["Hello all", "Bye"] and [(p.content, p.author) for p in x.f] == [("Hello all", "Ann"), ("Bye", "Bob")] and x.l[0] == "https://b.su/AbCd1234"


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>https://a.su/1</link><description>Body</description><author>ann</author><pubDate>Thu, 01 Jan 2026 10:00:00 +0000</pubDate></item><item><title>no body</title></item></channel></rss>")
    (r,) = feeds.rss(spark, str(tmp_path / "f.xml"), "https://a.su/feed", "A", F.to_timestamp(F.lit("2026-01-02"))).collect()
    assert r.content == "Body" and r.author == "ann" and r.metadata == {"url": "https://a.su/1", "title": "T"} and r.timestamp.hour == 10


def test_vulnerability_lists(spark, tmp_path):
    cve = {"id": "CVE-1", "published": "2026-01-01T00:00:00Z", "lastModified": "2026-01-01T00:00:00", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "E"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "vectorString": "V", "baseSeverity": "CRITICAL"}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:a"}]}]}], "references": [{"url": "u"}]}
    (tmp_path / "n.json").write_text(json.dumps({"vulnerabilities": [{"cve": cve}]}))
    r = feeds.nvd(spark, str(tmp_path / "n.json")).first()
    assert (r.description, r.cvss_v31_score, r.cwe_ids, r.affected_products, r.reference_urls) == ("E", 9.8, ["CWE-79"], ["cpe:a"], ["u"]) and r.published_at is not None and r.last_modified_at is None
    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("#model\ncve,epss,percentile\nCVE-1,0.9,0.99\nCVE-2,bad,0.1\nCVE-3\n")
    assert [(r.cve_id, r.epss_score) for r in feeds.epss(spark, str(tmp_path / "e.csv.gz")).collect()] == [("CVE-1", 0.9)]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2026-01-01", "dueDate": "bad", "knownRansomwareCampaignUse": "known"}]}))
    k = feeds.kev(spark, str(tmp_path / "k.json")).first()
    assert k.kev_ransomware_use and k.kev_due_date is None and k.priority_label == "critical"


def test_files(spark, tmp_path):
    (tmp_path / "g1.csv").write_text("id,x\na,1\nb,2\n")
    (tmp_path / "g2.txt").write_text("a\n\nb\n")
    assert {r.id for r in feeds.gold_ids(spark, str(tmp_path / "g1.csv")).collect()} == {r.id for r in feeds.gold_ids(spark, str(tmp_path / "g2.txt")).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        feeds.relabel_csv(spark, str(tmp_path / "g1.csv"))


def test_stream_replay_equals_one_batch(spark, tmp_path):
    rows = [{"id": f"f{i}", "source": "web", "source_id": "s", "source_name": "S", "content": f"leak of CVE-2026-1000{i % 4} database dump", "author": "a", "collected_at": f"2026-01-01T0{i}:00:00Z", "metadata": {}} for i in range(8)]
    for n in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 3 : n * 3 + 3]))
    rules = [Rule("cve", "regex", (r"CVE-\d{4}-\d{4,}",), "high")]
    sink = st.Ingest(str(tmp_path / "archive"), str(tmp_path / "alerts"), rules)
    st.run_ingest(st.read_findings(spark, str(tmp_path / "in")), sink, str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "archive"))
    assert got.count() == 4 == got.select("content").distinct().count() and spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", 0.0, 60.0), ("a", 0.0, 60.0), ("a", 1.0, 30.0), ("b", 5.0, 10.0)], "client string, at double, tokens double")
    got = sorted((r.client, round(r.granted_at, 3)) for r in st.token_bucket(df, 60).collect())
    assert got == [("a", 0.0), ("a", 60.0), ("a", 90.0), ("b", 5.0)]
    capped = st.token_bucket(spark.createDataFrame([("a", 0.0, 50.0), ("a", 1.0, 50.0)], "client string, at double, tokens double"), 600, 60)
    assert sorted(r.granted_at for r in capped.collect()) == [0.0, 86400.0]


def test_token_bucket_of_todays_seconds(spark):
    """Waits of fractions of a second at times where a double has steps of 2e-7 seconds, against exact fractions."""
    rnd = random.Random(5)
    rows = sorted((1_782_777_600.0 + round(rnd.uniform(0, 2 * 86400), 6), float(rnd.randrange(306, 640))) for _ in range(600))
    want, rate, level, last, now, used, day = [], Fraction(1500, 60), Fraction(1500), Fraction(rows[0][0]), Fraction(0), 0, 0
    for at, n in rows:
        now = max(now, Fraction(at))
        if now // 86400 == day and used + n > 50_000:
            now = Fraction((day + 1) * 86400)
        now = max(now, last + (n - level) / rate)
        used = int(n) + (used if now // 86400 == day else 0)
        level, last, day = min(Fraction(1500), level + (now - last) * rate) - int(n), now, now // 86400
        want.append(float(now))
    df = st.token_bucket(spark.createDataFrame([("a", *r) for r in rows], "client string, at double, tokens double"), 1500, 50_000)
    with ThreadPoolExecutor(1) as pool:
        job = pool.submit(df.collect)
        try:
            got = sorted(r.granted_at for r in job.result(90))
        finally:
            spark.sparkContext.cancelAllJobs()
    assert len({int(x // 86400) for x in want}) > 3 and max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-6


def test_json_recovery(spark):
    texts = ['{"a":1}', 'text ```json\n{"a": [1]}\n``` more', 'so {"x": {"y": "}"}} end', "[1,2] tail", "none", None, '```json\n{"a":1} trailing', 'bad { then [3]']
    assert [plug.recovered_json(t) for t in texts] == ['{"a":1}', '{"a": [1]}', '{"x": {"y": "}"}}', "[1,2]", None, None, '{"a":1}', "[3]"]


def test_sql_gate(spark):
    spark.createDataFrame([(1,), (2,)], "x int").createOrReplaceTempView("t")
    assert nlsql.query(spark, "q", lambda q: "```sql\nSELECT x FROM t LIMIT 1;\n```").count() == 1
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2 LIMIT 1", "SELECT x FROM t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a LIMIT 1"):
        with pytest.raises(nlsql.Refused):
            nlsql.query(spark, "q", lambda q: bad)


def test_config():
    cfg = config.load("llm: {provider: x, model: '${M}'}\nsources: {web: {enabled: true, feeds: [{type: odd}]}}\nmatching: {rules: [{name: a, type: keyword, patterns: [x]}]}", {"M": "m1"})
    assert cfg["llm"]["model"] == "m1" and config.violations(cfg) == ["sources.web.feeds[0].type is unknown: 'odd'"] and config.rules(cfg)[0].name == "a"
    assert len(config.violations({})) == 3

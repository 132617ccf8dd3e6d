import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as sc
from tidewatch.operators import correlate as co
from tidewatch.operators import dataset as ds
from tidewatch.operators import graph as gr
from tidewatch.operators import reads as rd
from tidewatch.operators import upsert as up
from tidewatch.operators import value as va

T0 = datetime(2026, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


RAW = "id string, source_id string, source_name string, source_type string, author string, author_id string, collected_at timestamp, classified boolean, category string, provenance string, severity string, content string, summary string"


def raw(spark, rows):
    return spark.createDataFrame([(i, s, s, "telegram", a, None, at(h), True, "vulnerability", "first_party", "high", "text", None) for i, s, a, h in rows], RAW)


def sightings(spark, rows):
    return spark.createDataFrame([(t, v, r, s, s, at(h)) for t, v, r, s, h in rows], "ioc_type string, ioc_value string, raw_content_id string, source_id string, source_name string, created_at timestamp")


def test_scores(spark):
    row = spark.range(1).select(
        sc.decayed(F.lit(0.5), F.lit("ip"), F.lit(T0), F.lit(T0 + timedelta(days=10))).alias("ip"), sc.decayed(F.lit(0.5), F.lit("url"), F.lit(T0), F.lit(T0 + timedelta(days=14))).alias("url"),
        *sum([[a.alias(f"s{i}"), b.alias(f"l{i}")] for i, (a, b) in enumerate([sc.vulnerability_priority(*[F.lit(x) for x in v]) for v in ((True, None, None, None, None), (False, 0.9, 9.8, 20, True), (False, 0.5, 5.0, 0, False), (None, None, None, None, None))])], []),
        sc.correlation_confidence("shared_ioc", F.lit(3)).alias("c"), sc.correlation_confidence("temporal_overlap", F.lit(30)).alias("d"), sc.severity_max(F.lit("low"), F.lit("critical"), F.lit("odd")).alias("m"),
    ).first()
    assert row.ip == pytest.approx(0.452419, abs=1e-6) and row.url == pytest.approx(0.370409, abs=1e-6)
    assert (row.s0, row.l0) == (1.0, "critical") and row.s1 == pytest.approx(0.954) and row.l1 == "critical"
    assert row.s2 == pytest.approx(0.35) and row.l2 == "medium" and (row.s3, row.l3) == (0.0, "info")
    assert row.c == pytest.approx(0.95) and row.d == 1.0 and row.m == "critical"


def test_limits_and_times():
    assert [sc.normalize_limit(x) for x in (None, 0, -1, 7, 501)] == [50, 50, 50, 7, 500]
    now = datetime(2026, 1, 10, tzinfo=timezone.utc)
    assert sc.parse_since("7d", now) == now - timedelta(days=7) and sc.parse_since("bad", now) is None
    assert sc.parse_since("2026-01-01T00:00:00Z", now) == datetime(2026, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        sc.parse_since("5m", now, strict=True)


def test_shared_iocs_and_threshold(spark):
    r = raw(spark, [("r1", "a", "x", 0), ("r2", "b", "x", 1), ("r3", "c", "y", 2)])
    s = sightings(spark, [("ip", "1.2.3.4", "r1", "a", 0), ("ip", "1.2.3.4", "r2", "b", 1), ("ip", "1.2.3.4", "r3", "c", 2), ("domain", "evil.su", "r1", "a", 0), ("domain", "evil.su", "r2", "b", 1), ("domain", "evil.su", "r2", "b", 1), ("url", "u", "r1", "a", 0)])
    got = {r.entity_ids[0]: (r.is_correlation, round(r.confidence, 2)) for r in co.rule_shared_ioc(s, r).collect()}
    assert got == {"ioc:ip:1.2.3.4": (True, 0.95), "ioc:domain:evil.su": (False, 0.8)}


def test_handle_reuse(spark):
    r = raw(spark, [("r1", "a", "IntelBroker", 0), ("r2", "b", "IntelBroker", 1), ("r3", "c", "IntelBroker", 2), ("r4", "a", "admin", 0), ("r5", "b", "admin", 0)])
    (got,) = co.rule_handle_reuse(r).collect()
    assert got.entity_ids[0] == "entity:threat_actor:intelbroker" and got.is_correlation


def test_temporal_overlap_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"r{i:02d}", rnd.choice("abc"), "x", rnd.randrange(0, 400)) for i in range(40)]
    s = [("ip", f"v{rnd.randrange(6)}", rnd.choice(rows)) for _ in range(150)]
    got = {(r.finding_a, r.finding_b, r.shared_count) for r in co.temporal_overlap(sightings(spark, [(t, v, r[0], r[1], 0) for t, v, r in s]), raw(spark, rows), None, 48).collect()}
    by = {}
    for t, v, r in s:
        by.setdefault(r[0], set()).add(v)
    want = {(a[0], b[0], len(by.get(a[0], set()) & by.get(b[0], set()))) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and abs(a[3] - b[3]) <= 48 and len(by.get(a[0], set()) & by.get(b[0], set())) >= 2}
    assert got == want and want


def test_clusters_skip_tools(spark):
    e = spark.createDataFrame([(i, t, {"name": n}) for i, t, n in (("a1", "threat_actor", "A"), ("a2", "threat_actor", "B"), ("t1", "tool", "mimikatz"), ("t2", "tool", "nmap"), ("m1", "malware", "Own"), ("a3", "threat_actor", "C"))], "id string, type string, properties map<string,string>")
    g = spark.createDataFrame([("a1", "t1"), ("a2", "t1"), ("a1", "t2"), ("a2", "t2"), ("a3", "t1"), ("a3", "m1"), ("a1", "m1")], "source_id string, target_id string")
    got = {tuple(r.entity_ids[:2]) for r in co.rule_campaign(e, g).collect()}
    assert got == {("a1", "a3")}


def test_insert_ignore(spark):
    old = spark.createDataFrame([("h1",)], "content_hash string")
    new = spark.createDataFrame([("a", "h1", at(0)), ("b", "h2", at(2)), ("c", "h2", at(1)), ("d", None, at(0)), ("e", None, at(0))], "id string, content_hash string, collected_at timestamp")
    assert {r.id for r in up.insert_ignore(old, new, ["content_hash"], ["collected_at", "id"]).collect()} == {"c", "d", "e"}


def test_upsert_in_batches_equals_one(spark):
    s = sightings(spark, [("ip", f"v{i % 5}", f"r{i}", "a", i) for i in range(30)])
    once = up.iocs_from_sightings(s)
    twice = up.upsert_iocs(up.iocs_from_sightings(s.where(F.col("created_at") < at(11))), s.where(F.col("created_at") >= at(11)))
    cols = ["type", "value", "sighting_count", "first_seen", "last_seen", "source_content_id"]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, twice.select(*cols).collect()))


def test_json_merge_and_vulns(spark):
    ev = spark.createDataFrame([("e", "t1", {"a": "1", "b": "1"}, 1), ("e", "t2", {"b": "2"}, 2)], "id string, type string, properties map<string,string>, at int")
    (r,) = up.merge_properties(ev).collect()
    assert r.type == "t1" and r.properties == {"a": "1", "b": "2"}
    old = spark.createDataFrame([("C1", 0.5, True), ("C2", 0.1, False)], "cve_id string, epss_score double, kev_listed boolean")
    new = spark.createDataFrame([("C1", None, False), ("C3", 0.2, False)], "cve_id string, epss_score double, kev_listed boolean")
    got = {r.cve_id: (r.epss_score, r.kev_listed) for r in up.upsert_vulnerabilities(old, new, strict_parity=False).collect()}
    assert got == {"C1": (0.5, True), "C2": (0.1, False), "C3": (0.2, False)}
    assert {r.cve_id: r.kev_listed for r in up.upsert_vulnerabilities(old, new).collect()}["C1"] is False


def test_sources_and_triage(spark):
    src = spark.createDataFrame([("u1", "discovered", 2, None), ("u2", "active", 0, None), ("u3", "active", 1, None)], "identifier string, status string, error_count int, last_collected timestamp")
    ev = spark.createDataFrame([("u1", "approve", at(1)), ("u1", "pause", at(2)), ("u2", "remove", at(1)), ("u3", "collect", at(2)), ("u3", "error", at(1)), ("u3", "error", at(3))], "identifier string, action string, at timestamp")
    got = {r.identifier: (r.status, r.error_count) for r in up.source_states(src, ev).collect()}
    assert got == {"u1": ("paused", 2), "u3": ("active", 1)}
    pending = spark.createDataFrame([("https://a.su/1",), ("https://b.su/1",), ("https://b.su/2",), ("https://b.su/3",), ("https://b.su/4",), ("https://c.su/1",)], "identifier string")
    answers = spark.createDataFrame([("https://a.su/1", "investigate"), ("https://a.su/1", "trash")] + [(f"https://b.su/{i}", "trash") for i in (1, 2, 3)], "match string, verdict string")
    misses = spark.createDataFrame([("https://c.su/1", 3)], "identifier string, missed int")
    left, trash = up.apply_triage(pending, answers, misses)
    assert {(r.identifier, r.status) for r in left.collect()} == {("https://a.su/1", "discovered")} and {(r.domain, r.n) for r in trash.collect()} == {("b.su", 3), ("c.su", 1)}


def test_graph(spark):
    g = spark.createDataFrame([("a", "b", "uses"), ("b", "c", "uses"), ("c", "d", "uses"), ("e", "e", "self"), ("x", "y", "uses")], "source_id string, target_id string, relationship string")
    assert {(r.id, r.depth) for r in gr.reachable(g, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert gr.k_hop_edges(g, "a", 2).count() == 2 and gr.k_hop_edges(g, "zzz", 2).count() == 0
    assert {r.id: r.degree for r in gr.degrees(g).collect()}["e"] == 2


def test_unique_iocs_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [("ip", f"v{rnd.randrange(8)}", "r", rnd.choice("abc"), rnd.randrange(0, 24 * 40)) for _ in range(120)]
    got = {r.src: r.unique_iocs for r in va.unique_iocs(sightings(spark, rows)).collect()}
    want = {}
    for _, v, _, s, h in rows:
        if not any(v2 == v and s2 != s and h2 < h and h2 > h - 168 for _, v2, _, s2, h2 in rows):
            want.setdefault(s, set()).add(v)
    assert got == {s: len(v) for s, v in want.items()}


def test_date_bin_and_pages(spark):
    x = spark.createDataFrame([(datetime(2026, 1, 8, 13, 5),)], "c timestamp").select(*[F.date_format(sc.date_bin(F.col("c"), w), "yyyy-MM-dd HH").alias(w.replace(" ", "")) for w in ("1 hour", "6 hours", "1 day", "1 week", "odd")]).first()
    assert tuple(x) == ("2026-01-08 13", "2026-01-08 12", "2026-01-08 00", "2026-01-03 00", "2026-01-08 13")
    assert [r.id for r in rd.page(spark.range(100), [F.col("id")], 3, 5).collect()] == [5, 6, 7]


def test_dataset(spark):
    reasons = spark.createDataFrame([("no_verdict_keep_groq", "0", "x"), ("downgrade", "0", "x"), ("reclassified", "1", "data_dump"), ("agree", "0", "data_dump"), ("agree", "0", "bad"), ("odd", "0", "x")], "source string, needs_review string, final_label string")
    assert [r.x for r in reasons.select(ds.plan_reason().alias("x")).collect()] == ["no_verdict", "downgrade", "needs_review_not_adjudicated", "actionable", "final_label_not_a_class", "unknown_source:odd"]
    rows = spark.createDataFrame([(f"{i:03d}", at(i)) for i in range(57)], "id string, collected_at timestamp")
    got = [r.split for r in ds.temporal_split(rows).orderBy("id").collect()]
    assert got == ["train"] * 45 + ["val"] * 5 + ["test"] * 7
    m = {r["class"]: r for r in ds.class_metrics(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, z string")).collect()}
    assert m["a"].recall == 0.5 and m["b"].precision == pytest.approx(1 / 3) and m["c"].f1 == 0
    t = ds.recall_threshold(spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False)], "score double, positive boolean"), 0.97).first()
    assert t.threshold == 0.7 and t.recall == 1.0 and t.precision == pytest.approx(2 / 3)
    assert math.isinf(ds.recall_threshold(spark.createDataFrame([], "score double, positive boolean")).first().threshold)
    s = ds.verdict_summary(spark.createDataFrame([("a", "ok"), ("a", "wrong"), ("a", "?"), ("a", None), ("b", "")], "sheet string, verdict string"))
    assert {r.sheet: r.error_rate for r in s.collect()} == {"a": 0.5, "b": None}


def test_gate_training(spark):
    good, bad = ["selling fresh database dump", "exploit loader for sale", "vpn access broker offer"], ["buying a used bike", "weather is nice today", "lunch at noon anyone"]
    rows = []
    for i in range(90):
        label, base = ("relevant", good) if i % 2 else ("irrelevant", bad)
        rows.append((str(i), f"{base[i % 3]} {i}", label, "latin", "train" if i < 60 else "val" if i < 75 else "test", str(i), at(i)))
    df = spark.createDataFrame(rows, "id string, text string, label string, language string, split string, content_hash string, collected_at timestamp")
    _, _, metrics = ds.train_gate(df, char_features=2000, word_features=500)
    assert ds.macro_f1(metrics).first().macro_f1 > 0.7

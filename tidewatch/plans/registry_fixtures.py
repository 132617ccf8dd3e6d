"""Queries over small literal inputs, for operators whose inputs are files, answers or settings rather than the tables. Their SQL
lists the rows that must come out, worked out from the rules by hand."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import plug as pl
from tidewatch.functions import scalar as sc
from tidewatch.functions import text as tx
from tidewatch.functions import urls as ur
from tidewatch.operators import correlate as co
from tidewatch.operators import dataset as ds
from tidewatch.operators import graph as gr
from tidewatch.operators import reads as rd
from tidewatch.operators import upsert as up
from tidewatch.operators import value as va
from tidewatch.plans import api, nlsql
from tidewatch.plans import config as cf
from tidewatch.plans.registry import query
from tidewatch.session import shared_path
from tidewatch.sources import feeds
from tidewatch.streaming import pipeline as st
from tidewatch.tables import table

_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
AT = datetime(2026, 7, 1, tzinfo=timezone.utc)


def _literal(v, kind: str) -> str:
    if v is None:
        return f"CAST(NULL AS {_TYPES[kind]})"
    return f"CAST({'true' if v is True else 'false' if v is False else repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS {_TYPES[kind]})"


def expect(name: str, columns: str, rows: list[tuple]):
    """Register a query whose rows are ``rows``; ``columns`` as in a schema string."""
    fields = [c.split() for c in columns.split(",")]
    lines = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, fields)) + ")" for r in rows)
    return query(name, f"SELECT * FROM (VALUES {lines}) t({', '.join(f'"{n}"' for n, _ in fields)})")


def put(spark: SparkSession, text: str, name: str) -> str:
    """A file's folder with ``text``, in the shared folder."""
    path = shared_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def vectors(spark: SparkSession, pairs: list[tuple]):
    """(input) rows of the first members."""
    return spark.createDataFrame([(p[0],) for p in pairs], "input string")


def by_rule(name: str, pairs: list[tuple], rule, kind: str = "string"):
    """A query (input, output) of a column rule over texts."""
    return expect(name, f"input string, output {kind}", pairs)(lambda spark, d: vectors(spark, pairs).select("input", rule(F.col("input")).alias("output")))


def by_function(name: str, pairs: list[tuple], f, kind: str = "string"):
    """A query (input, output) of a driver-side function."""
    return expect(name, f"input string, output {kind}", pairs)(lambda spark, d: spark.createDataFrame([(p[0], f(p[0])) for p in pairs], f"input string, output {kind}"))


# --- Sources ---
@expect("src_telegram", "source_id string, source_name string, content string, author string, message_id string, at bigint", [("100", "chan", "hello world", "bob", "1", 1700000000000000), ("100", "chan", "a caption", "amy", "2", 1700000060000000)])
def src_telegram(spark, d):
    rows = [(100, "chan", "hello world", "", "bob", 7, 1700000000, 1), (100, "chan", "", "a caption", "amy", 8, 1700000060, 2), (100, "chan", "", None, "amy", 8, 1700000070, 3)]
    m = spark.createDataFrame(rows, "channel_id bigint, channel string, message string, caption string, sender string, sender_id bigint, date bigint, message_id bigint")
    return feeds.telegram(m, F.lit(AT)).select("source_id", "source_name", "content", "author", F.col("metadata")["message_id"].alias("message_id"), F.unix_micros("timestamp").alias("at"))


@expect("src_paste", "source_id string, content string, author string, title string, at bigint", [("AbC123", "body one", "joe", "t", 1700000000000000), ("Zz9", "body two", "", None, None)])
def src_paste(spark, d):
    items = [{"scrape_url": "u", "full_url": "https://paste.test/AbC123", "date": "1700000000", "key": "AbC123", "title": "t", "user": "joe"}, {"key": "Zz9", "title": "", "user": "", "date": "x", "full_url": "https://paste.test/Zz9"}, {"key": "none"}]
    bodies = spark.createDataFrame([("AbC123", "body one"), ("Zz9", "body two"), ("other", "body three")], "key string, content string")
    x = feeds.paste_items(spark, put(spark, json.dumps(items), "pastes"), bodies, F.lit(AT))
    return x.select("source_id", "content", "author", F.col("metadata")["title"].alias("title"), F.unix_micros("timestamp").alias("at"))


@expect("src_rss", "source_name string, content string, author string, url string, at bigint", [("feed", "alpha body", "ann", "https://f.test/1", 1780308000000000), ("feed", "beta body", "ben", None, None)])
def src_rss(spark, d):
    xml = (
        '<rss xmlns:content="c" xmlns:dc="d"><channel><item><title>A</title><link>https://f.test/1</link><description>alpha body</description><author>ann</author><pubDate>Mon, 1 Jun 2026 10:00:00 +0000</pubDate></item>'
        "<item><content:encoded>beta body</content:encoded><dc:creator>ben</dc:creator></item><item><title>empty</title></item></channel></rss>"
    )
    x = feeds.rss(spark, put(spark, xml, "rss"), "https://f.test/feed", "feed", F.lit(AT))
    return x.select("source_name", "content", "author", F.col("metadata")["url"].alias("url"), F.unix_micros("timestamp").alias("at"))


_PAGE = '<a href="/paste/1">x</a> <a href="#top">t</a> <a href="javascript:void(0)">j</a> <a href="https://other.test/raw/2">y</a> <a href="AbCdEf12">z</a> <a href="/paste/1">again</a>'


@expect("src_page_links", "kind string, links string", [("all", "https://p.test/paste/1 https://other.test/raw/2 https://p.test/list/AbCdEf12"), ("pastes", "https://p.test/paste/1 https://other.test/raw/2")])
def src_page_links(spark, d):
    x = spark.createDataFrame([("all", _PAGE), ("pastes", _PAGE)], "kind string, html string")
    base = F.lit("https://p.test/list/")
    links = F.when(F.col("kind") == "pastes", feeds.page_links(F.col("html"), base, True)).otherwise(feeds.page_links(F.col("html"), base))
    return x.select("kind", F.array_join(links, " ").alias("links"))


by_rule("src_paste_links", [("/paste/abc", True), ("https://x.test/Raw/1", True), ("/AbCdEf12", True), ("https://x.test/AbCdEf12", True), ("/abc", False), ("/about-us-page", False)], feeds.is_paste_link, "boolean")

_BLOCKS = '<div class="post"><p>One</p></div><div class="post"></div><div id="x" class="post big">Two<script>no()</script></div>'


@expect("src_scrape", "selector string, texts string", [(".post", "One|Two"), ("#x", "Two"), ("div.post p", "One"), ("span", "")])
def src_scrape(spark, d):
    page = spark.createDataFrame([(_BLOCKS,)], "html string")
    each = [page.select(F.lit(s).alias("selector"), F.array_join(feeds.scraped(F.col("html"), s), "|").alias("texts")) for s in (".post", "#x", "div.post p", "span")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@expect("src_forum", "content string, author string", [("hi", "amy"), ("alone", "")])
def src_forum(spark, d):
    html = '<ul><li><span class="u">amy</span><div><p class="m">hi</p></div></li></ul><div><div><div><div><div><div><p class="m">alone</p></div></div></div></div></div></div>'
    return spark.createDataFrame([(html,)], "html string").select(F.inline(feeds.forum_posts(F.col("html"), ".m", ".u")))


@expect("src_nvd", "cve_id string, description string, score double, severity string, cwes string, products string, links string, published bigint", [("CVE-2026-1", "text", 9.8, "CRITICAL", "CWE-79", "cpe:a,cpe:b", "https://r.test", 1767225600000000), ("CVE-2026-2", None, None, None, None, None, None, None)])
def src_nvd(spark, d):
    full = {
        "id": "CVE-2026-1", "published": "2026-01-01T00:00:00Z", "lastModified": "2026-01-02T00:00:00", "descriptions": [{"lang": "es", "value": "texto"}, {"lang": "en", "value": "text"}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "vectorString": "v", "baseSeverity": "CRITICAL"}}]}, "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:a"}, {"criteria": "cpe:b"}]}]}], "references": [{"url": "https://r.test"}],
    }
    x = feeds.nvd(spark, put(spark, json.dumps({"vulnerabilities": [{"cve": full}, {"cve": {"id": "CVE-2026-2", "published": "2026-01-01T00:00:00"}}]}), "nvd"))
    flat = lambda c: F.array_join(c, ",")
    return x.select("cve_id", "description", F.col("cvss_v31_score").alias("score"), F.col("cvss_severity").alias("severity"), flat("cwe_ids").alias("cwes"), flat("affected_products").alias("products"), flat("reference_urls").alias("links"), F.unix_micros("published_at").alias("published"))


@expect("src_epss", "cve_id string, epss_score double, epss_percentile double", [("CVE-2026-1", 0.5, 0.9), ("CVE-2026-2", 0.01, 0.1)])
def src_epss(spark, d):
    text = "#model_version:v1\ncve,epss,percentile\nCVE-2026-1,0.5,0.9\nCVE-2026-2,0.01,0.1\nCVE-2026-3,bad,0.1\nCVE-2026-4"
    return feeds.epss(spark, put(spark, text, "epss"))


@expect("src_kev", "cve_id string, kev_listed boolean, added string, due string, ransom boolean, priority_score double, priority_label string", [("CVE-2026-1", True, "2026-01-02", None, True, 1.0, "critical"), ("CVE-2026-2", True, None, "2026-02-03", False, 1.0, "critical")])
def src_kev(spark, d):
    text = json.dumps({"vulnerabilities": [{"cveID": "CVE-2026-1", "dateAdded": "2026-01-02", "dueDate": "soon", "knownRansomwareCampaignUse": "Known"}, {"cveID": "CVE-2026-2", "dateAdded": "", "dueDate": "2026-02-03", "knownRansomwareCampaignUse": "Unknown"}]})
    return feeds.kev(spark, put(spark, text, "kev")).select("cve_id", "kev_listed", F.col("kev_date_added").cast("string").alias("added"), F.col("kev_due_date").cast("string").alias("due"), F.col("kev_ransomware_use").alias("ransom"), "priority_score", "priority_label")


@expect("src_abuse_lookup", "value string, score double, malicious boolean", [("203.0.113.9", 0.8, True), ("203.0.113.10", 0.5, False)])
def src_abuse_lookup(spark, d):
    iocs = spark.createDataFrame([("ip", "203.0.113.9"), ("ip", "203.0.113.10"), ("domain", "a.test"), ("ip", "203.0.113.11")], "type string, value string")
    known = spark.createDataFrame([("203.0.113.9", 80), ("203.0.113.10", 50), ("a.test", 90)], "value string, confidence int")
    return feeds.enrich_abuse(iocs, known).select("value", "score", "malicious")


@expect("src_certificates", "domain string, certificates bigint, issuers bigint, first string, last string", [("a.test", 3, 2, "2026-03", "2026-01"), ("b.test", 1, 1, "2025-12", "2025-12")])
def src_certificates(spark, d):
    rows = [("a.test", 0, "X", "2026-03"), ("a.test", 1, "Y", "2026-02"), ("a.test", 2, "X", "2026-01"), ("b.test", 0, "X", "2025-12")]
    return feeds.enrich_certificates(spark.createDataFrame(rows, "domain string, pos int, issuer string, not_before string"))


@expect("src_gold_ids", "form string, id string", [("csv", "a"), ("csv", "b"), ("lines", "c"), ("lines", "d")])
def src_gold_ids(spark, d):
    one = feeds.gold_ids(spark, put(spark, "id,note\na,x\nb,y\na,z", "gold"))
    two = feeds.gold_ids(spark, put(spark, "c\n d \n\nc", "gold"))
    return one.select(F.lit("csv").alias("form"), "id").unionByName(two.select(F.lit("lines").alias("form"), "id"))


@expect("src_relabel", "id string, final_label string, content_snippet string", [("1", "data_dump", 'says "hi", twice'), ("2", "irrelevant", "two\nlines")])
def src_relabel(spark, d):
    text = ",".join(ds.RELABEL_COLUMNS) + '\n1,data_dump,,,,,data_dump,agree,0,"says ""hi"", twice"\n2,irrelevant,,,,,irrelevant,downgrade,0,"two\nlines"'
    return feeds.relabel_csv(spark, put(spark, text, "relabel")).select("id", "final_label", "content_snippet")


# --- Parameters, times, text ---
by_function("limit_rule", [("", 50), ("0", 50), ("-3", 50), ("10", 10), ("900", 500), ("500", 500)], lambda x: sc.normalize_limit(int(x) if x else None), "int")
by_function("int_rule", [("7", 7), ("x", 0), ("-1", 0), ("", 0)], sc.int_param, "int")
by_function("float_rule", [("0.5", 0.5), ("x", 0.0), ("-1", 0.0), ("3", 3.0)], sc.float_param, "double")
by_function("since_rule", [("7d", "2026-06-24T00:00:00+00:00"), ("12h", "2026-06-30T12:00:00+00:00"), ("30m", "2026-06-30T23:30:00+00:00"), ("2026-06-01T10:00:00Z", "2026-06-01T10:00:00+00:00"), ("2026-06-01T10:00:00", None), ("soon", None), ("", None)], lambda x: (lambda t: t.isoformat() if t else None)(sc.parse_since(x, AT)))
by_function("retry_delays", [("1", 2), ("2", 4), ("3", 8), ("4", 16), ("5", 30), ("9", 30)], lambda x: sc.retry_delay(int(x)), "int")
by_function("next_brief", [("6", "2026-07-01T06:00:00+00:00"), ("0", "2026-07-02T00:00:00+00:00")], lambda x: sc.next_run(AT, int(x)).isoformat())
by_function("vulnerability_cycle", [("never", "nvd,epss,kev,cross_reference,priorities"), ("1", "nvd,cross_reference,priorities"), ("24", "nvd,epss,kev,cross_reference,priorities")], lambda x: ",".join(st.vulnerability_steps({} if x == "never" else {k: datetime.fromtimestamp(AT.timestamp() - 3600 * int(x), timezone.utc) for k in ("epss", "kev")}, AT)))

by_rule(
    "mask_vectors",
    [
        ("C2 at 91.92.93.94 active", "C2 at <IP> active"), ("45.155.205.99:8443", "<IP>:8443"), ("leak: https://mega.nz/file/x1z9", "leak: <URL>"), ("payload hxxps://evil-files.ru/dump.bin", "payload <URL>"),
        ("beacons to evil-c2.ru daily", "beacons to <DOMAIN> daily"), ("contact ivan.petrov@mail.ru for access", "contact <EMAIL> for access"), ("exploits cve-2026-12345 in the wild", "exploits <CVE> in the wild"), ("md5 d41d8cd98f00b204e9800998ecf8427e", "md5 <HASH>"),
        ("pay to 0x52908400098527886E0F7030069857D2E4169EE7", "pay to <WALLET>"), ("pay to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "pay to <WALLET>"), ("combo mark:opensesame works", "combo <CRED> works"), ("format is user:pass here", "format is user:pass here"),
        ("see http://example.com for docs", "see http://example.com for docs"), ("write test@example.com", "write test@example.com"), ("dns 8.8.8.8 and lan 10.0.0.5", "dns 8.8.8.8 and lan 10.0.0.5"), ("at 12:3456 today", "at 12:3456 today"),
        ("see notes:/etc/passwd dump", "see notes:/etc/passwd dump"), ("слив базы, логин mark:opensesame на 91.92.93.94", "слив базы, логин <CRED> на <IP>"), ("база mail.ru аккаунтов: ivan@mail.ru:qwerty123", "база <DOMAIN> аккаунтов: <EMAIL>:qwerty123"),
        ("样本 9e107d9d372bb6826bd81d3542a419d6 回连 evil-cn.top", "样本 <HASH> 回连 <DOMAIN>"), ("https://x.ru/q?u=bob@corp.ru", "<URL>"), ("c2: 91.92.93.94", "c2: <IP>"), ("", ""), (None, ""),
    ],
    tx.mask_iocs,
)
by_rule("junk_reason_vectors", [(None, "vacio"), ("  ", "vacio"), ("@handle_x", "solo_enlace_o_handle"), ("12345 !!!", "sin_letras"), ("example.com", "placeholder_solo"), ("user:hunter22", "placeholder_credencial"), ("kurz", "ultracorto"), ("ein ausreichend langer Text", None), ("1.2.3.4 CVE-2026-12345", None), ("test@example.com", "placeholder_email")], tx.junk_reason)
by_rule("noise_vectors", [("@handle_x", True), ("CVE-2026-12345 in use", False), (None, True), ("ein ausreichend langer Text", False)], lambda c: tx.junk_reason(c).isNotNull(), "boolean")
by_rule("rescue_vectors", [("999.999.999.999", False), ("CVE-2026-123", False), ("CVE-2026-12345", True), ("stealer.exe", True), ("test@example.com", False), ("user:pass", False), ("photo.jpg", False), ("185.220.101.47:4444", True), ("http://t.co/x1", True)], tx.ioc_rescue, "boolean")
by_rule("has_ioc_vectors", [("a 91.92.93.94 b", True), ("8.8.8.8", False), ("bob@evil.test.su", True), ("mark:opensesame", True), ("user:hunter22", False), ("f" * 32, False), ("plain words", False), (None, False)], tx.has_ioc, "boolean")

_IOC_TEXT = "c2 at 91.92.93.94, cve-2026-12345 and CVE-2026-12345, mail bob@evil.su https://evil.su/p?q bob:hunter22 admin:x1y2z3 8.8.8.8 evil.su 0x52908400098527886E0F7030069857D2E4169EE7 " + "0" * 32 + " d41d8cd98f00b204e9800998ecf8427e"


@expect("extract_vectors", "kind string, vals string", [("ip", "91.92.93.94"), ("cve", "CVE-2026-12345"), ("email", "bob@evil.su"), ("url", "https://evil.su/p?q"), ("credential", "bob:hunter22"), ("domain", "evil.su"), ("crypto_wallet", "0x52908400098527886E0F7030069857D2E4169EE7"), ("hash_md5", "d41d8cd98f00b204e9800998ecf8427e")])
def extract_vectors(spark, d):
    return spark.createDataFrame([(_IOC_TEXT,)], "t string").select(F.explode(tx.extract_iocs(F.col("t"))).alias("kind", "vals")).select("kind", F.array_join("vals", ",").alias("vals"))


# --- Source discovery ---
by_rule("invite_vectors", [("https://t.me/+AbC", "+AbC"), ("t.me/joinchat/xyz/1", "+xyz"), ("https://t.me/name", "")], ur.invite_hash)
by_rule("channel_vectors", [("https://t.me/DarkLeaks", "DarkLeaks"), ("t.me/name/123", "name"), ("t.me/helper_bot", ""), ("t.me/", ""), ("t.me/Watched", "")], lambda c: ur.telegram_name(c, ("watched",)))
by_rule("match_form_vectors", [(" HTTPS://A.test/x%20y/ ", "https://a.test/x y"), ("https://a.test//", "https://a.test"), ("https://a.test/100%", "https://a.test/100%")], ur.url_match_form)
by_rule("source_kind_vectors", [("https://t.me/joinchat/a", "telegram_group"), ("https://t.me/+a", "telegram_group"), ("https://t.me/a", "telegram_channel"), ("http://abc.onion/x", "forum"), ("https://pastebin.com/a", "paste_site"), ("https://a.test/feed.xml", "rss"), ("https://a.test/rss", "rss"), ("https://a.test/x", "web")], ur.classify_source)
by_rule("skip_vectors", [("https://a.test/FUZZ", True), ("http://localhost:80/x", True), ("http://10.1.2.3/x", True), ("http://172.20.0.1/x", True), ("http://172.40.0.1/x", False), ("https://a.test/i.png", True), ("https://bit.ly/x", True), ("https://a.test/", True), ("https://a.test/?q=1", False), ("https://a.test/page", False)], ur.skipped, "boolean")
by_rule("module_vectors", [("telegram-main", "collector.telegram"), ("paste", "collector.paste"), ("forum-x", "collector.forum"), ("rss", "collector.web"), ("other", "collector.other")], ur.collector_module)


@expect("channel_names", "number bigint, name string", [(1, "user"), (2, "invite:abc"), (3, "channel:3")])
def channel_names(spark, d):
    x = spark.createDataFrame([(1, "user", "abc"), (2, "", "abc"), (3, None, "")], "number bigint, username string, invite string")
    return x.select("number", ur.channel_name(F.col("username"), F.col("invite"), F.col("number")).alias("name"))


@expect("discovery_vectors", "type string, identifier string, status string, discovered_from string", [("telegram_channel", "darkleaks", "discovered", "a"), ("telegram_group", "invite:+abc123xyz", "discovered", "a"), ("web", "https://unknown.su/page", "pending_triage", "b")])
def discovery_vectors(spark, d):
    x = spark.createDataFrame([("b", "again https://t.me/darkleaks and https://unknown.su/page and https://unknown.su/i.png"), ("a", "Join our channel https://t.me/darkleaks and group https://t.me/joinchat/abc123xyz"), ("c", None)], "id string, content string")
    return ur.discover(x).select("type", "identifier", "status", "discovered_from")


@expect("triage_round", "identifier string, status string", [("https://keep.test/a", "discovered"), ("https://both.test/a", "discovered"), ("https://new.test/a", "pending_triage")])
def triage_round(spark, d):
    pending = ["https://keep.test/a", "https://both.test/a", "https://trash.test/a", "https://silent.test/a", "https://new.test/a", "https://bad.test/1", "https://bad.test/2", "https://bad.test/3", "https://bad.test/4"]
    p = spark.createDataFrame([(x,) for x in pending], "identifier string")
    answers = [("https://keep.test/a", "investigate"), ("https://both.test/a", "trash"), ("https://both.test/a", "investigate"), ("https://trash.test/a", "trash"), *[(f"https://bad.test/{i}", "trash") for i in (1, 2, 3)]]
    misses = spark.createDataFrame([("https://silent.test/a", 3), ("https://new.test/a", 2)], "identifier string, missed int")
    return up.apply_triage(p, spark.createDataFrame(answers, "match string, verdict string"), misses)[0]


# --- Model answers and model steps ---
by_rule("json_vectors", [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure: {"a":[1]} done', '{"a":[1]}'), ("list [1,2] end", "[1,2]"), ("{bad} then {\"b\":2}", '{"b":2}'), ("nothing", None), ("", None)], pl.recover_json)


@expect("classify_vectors", "content string, category string", [("CVE-2026-12345 in use", "vulnerability"), ("fresh combo list", "credential_leak"), ("new loader for sale", "malware_sample"), ("VPN for sale", "access_broker"), ("database of users", "data_dump"), ("hello friends", "threat_actor_comms")])
def classify_vectors(spark, d):
    x = spark.createDataFrame([(c,) for c in ("CVE-2026-12345 in use", "fresh combo list", "new loader for sale", "VPN for sale", "database of users", "hello friends")], "content string")
    return pl.default_classify(x).select("content", "category")


@expect("extract_step", "record_id string, type string, value string", [("a", "ip", "91.92.93.94"), ("a", "domain", "evil.su"), ("b", "cve", "CVE-2026-12345")])
def extract_step(spark, d):
    x = spark.createDataFrame([("a", "c2 91.92.93.94 and evil.su, bob:hunter22"), ("b", "cve-2026-12345 and c2.evil.invalid"), ("c", None)], "id string, content string")
    return pl.default_extract(x).select("record_id", "type", "value")


@expect("post_process_vectors", "id string, provenance string, tags string, severity string", [("a", "first_party", "credential_leak,credentials", "high"), ("b", "unknown", "irrelevant,needs_review", "info")])
def post_process_vectors(spark, d):
    x = spark.createDataFrame([("a", "credential_leak", 0.9, "first_party", "high"), ("b", "irrelevant", 0.5, "made_up", "critical")], "id string, category string, confidence double, provenance string, severity string")
    return pl.post_process(x).select("id", "provenance", F.array_join("tags", ",").alias("tags"), "severity")


@expect("summary_step", "id string, summary string", [("a", "short"), ("b", "x" * 120), ("c", None)])
def summary_step(spark, d):
    return pl.default_summarize(spark.createDataFrame([("a", "short"), ("b", "x" * 200), ("c", None)], "id string, content string")).select("id", "summary")


# --- Graph, statements, streams, data sets ---
@expect("bridge_entities", "kind string, source string, target string, relationship string", [("node", "entity:threat_actor:alpha", None, None), ("node", "entity:malware:beta", None, None), ("edge", "entity:threat_actor:alpha", "source:chan", "mentioned_in"), ("edge", "entity:malware:beta", "source:chan", "mentioned_in"), ("edge", "entity:threat_actor:alpha", "entity:malware:beta", "referenced_in")])
def bridge_entities(spark, d):
    x = spark.createDataFrame([("r", "chan", "Alpha", "threat_actor", False, "high"), ("r", "chan", "Beta", "malware", False, "medium"), ("r", "chan", "Gamma", "malware", True, "low")], "record_id string, source string, name string, type string, observed boolean, confidence string")
    r = spark.createDataFrame([("r", "Alpha", "Beta", "uses"), ("r", "Alpha", "Gamma", "uses"), ("r", "Alpha", "Beta", "")], "record_id string, source_name string, target_name string, relationship string")
    nodes, links = gr.bridge_entities(x, r)
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("source"), none.alias("target"), none.alias("relationship")).unionByName(links.select(F.lit("edge").alias("kind"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relationship"))


def _gate(sql: str) -> str:
    try:
        nlsql.check(nlsql.unfenced(sql))
        return "allowed"
    except nlsql.Refused as e:
        return str(e)


by_function("sql_gate_vectors", [("SELECT 1 LIMIT 5", "allowed"), ("```sql\nSELECT 1 LIMIT 5;\n```", "allowed"), ("WITH a AS (SELECT 1) SELECT * FROM a LIMIT 1", "allowed"), ("SELECT 1", "no LIMIT"), ("DROP TABLE x", "not a SELECT"), ("SELECT 1; SELECT 2 LIMIT 1", "more than one statement"), ("SELECT 1 FROM (DELETE FROM x) LIMIT 1", "blocked keyword DELETE")], _gate)


@expect("answered_question", "n bigint", [(0,), (1,), (2,)])
def answered_question(spark, d):
    spark.range(10).createOrReplaceTempView("numbers_for_question")
    return nlsql.query(spark, "three numbers", lambda q: "```sql\nSELECT id AS n FROM numbers_for_question ORDER BY id LIMIT 3;\n```")


by_function("brief_sections", [("both", "## Executive Summary\n\none\n\n## Recommendations\n\ntwo"), ("blank", "")], lambda x: va.brief_markdown({"recommendations": " two ", "executive_summary": "one", "trending": " "} if x == "both" else {}))


@expect("token_bucket_vectors", "client string, at double, granted_at double", [("a", 0.0, 0.0), ("a", 0.0, 30.0), ("a", 100.0, 100.0), ("b", 5.0, 5.0)])
def token_bucket_vectors(spark, d):
    x = spark.createDataFrame([("a", 0.0, 30.0), ("a", 0.0, 60.0), ("a", 100.0, 60.0), ("b", 5.0, 1.0)], "client string, at double, tokens double")
    return st.token_bucket(x, 60, 0).select("client", "at", "granted_at")


@expect("ingest_replay", "id string, severity string, alert boolean, iocs bigint", [("a", "high", True, 1), ("c", "info", False, 0), ("late", "info", False, 0)])
def ingest_replay(spark, d):
    """Two files through the stream: a repeated content is archived once, a row two days late is archived."""
    folder, out = shared_path(spark, "findings"), shared_path(spark, "ingest")
    rows = lambda *x: spark.createDataFrame([(i, t, datetime.fromisoformat(at).replace(tzinfo=timezone.utc)) for i, t, at in x], "id string, content string, collected_at timestamp")
    rows(("a", "leaked creds for example.org at 91.92.93.94", "2026-06-03T10:00:00"), ("c", "a quiet ordinary message", "2026-06-03T11:00:00")).coalesce(1).write.json(folder)
    rows(("b", "leaked creds for example.org at 91.92.93.94", "2026-06-03T12:00:00"), ("late", "another quiet ordinary message", "2026-06-01T00:00:00")).coalesce(1).write.mode("append").json(folder)
    sink = st.Ingest(f"{out}/archive", f"{out}/alerts", [tx.Rule("watch", "keyword", ("example.org",), "high")], extract=pl.default_extract, summarize=pl.default_summarize, iocs=f"{out}/iocs")
    st.run_ingest(st.read_findings(spark, folder), sink, f"{out}/checkpoint").awaitTermination()
    iocs = spark.read.parquet(f"{out}/iocs").groupBy("record_id").agg(F.count(F.lit(1)).alias("iocs"))
    return spark.read.parquet(f"{out}/archive").join(iocs, F.col("id") == F.col("record_id"), "left").select(F.when(F.col("id") == "b", "a").otherwise(F.col("id")).alias("id"), "severity", "alert", F.coalesce("iocs", F.lit(0).cast("bigint")).alias("iocs"))


@expect("sample_sizes", "label string, n bigint, least_id string", [("x", 40, None), ("y", 7, "y0")])
def sample_sizes(spark, d):
    x = spark.range(1000).select(F.concat(F.lit("x"), "id").alias("id"), F.lit("x").alias("label")).unionByName(spark.range(7).select(F.concat(F.lit("y"), "id").alias("id"), F.lit("y").alias("label")))
    got = ds.stratified_sample(x, {"x": 40, "y": 40})
    return got.groupBy("label").agg(F.countDistinct("id").alias("n"), F.when(F.first("label") == "y", F.min("id")).alias("least_id"))


@expect("report_lines", "line string", [("# gate",), ("",), ("Macro F1: 0.7500",), ("",), ("| class | precision | recall | F1 | support |",), ("| --- | --- | --- | --- | --- |",), ("| a | 1.0000 | 1.0000 | 1.0000 | 3 |",), ("| b | 0.5000 | 0.5000 | 0.5000 | 2 |",)])
def report_lines(spark, d):
    m = [{"class": "b", "precision": 0.5, "recall": 0.5, "f1": 0.5, "support": 2}, {"class": "a", "precision": 1.0, "recall": 1.0, "f1": 1.0, "support": 3}]
    return spark.createDataFrame([(x,) for x in ds.report_markdown(m, "gate").split("\n")], "line string")


@expect("matched_rules", "content string, matched boolean, rules string, severity string", [("leaked creds for example.com found here", True, "domain-watch", "high"), ("admin password=hunter2", True, "cred-pattern", "critical"), ("Example.COM pwd: x", True, "domain-watch,cred-pattern", "critical"), ("nothing", False, "", "info"), (None, False, "", "info")])
def matched_rules(spark, d):
    rules = [tx.Rule("domain-watch", "keyword", ("example.com",), "high"), tx.Rule("cred-pattern", "regex", (r"(?i)(password|passwd|pwd)\s*[:=]\s*\S+",), "critical")]
    x = spark.createDataFrame([(c,) for c in ("leaked creds for example.com found here", "admin password=hunter2", "Example.COM pwd: x", "nothing", None)], "content string")
    m = tx.match(F.col("content"), rules)
    return x.select("content", m["matched"].alias("matched"), F.array_join(m["rules"], ",").alias("rules"), m["severity"].alias("severity"))


_RELABEL = [("1", "credential_leak", "data_dump", "agree", "0"), ("2", "credential_leak", "credential_leak", "agree", " 1 "), ("3", "data_dump", "irrelevant", "downgrade", "0"), ("4", "data_dump", "credential_leak", "reclassified", "0"), ("5", "credential_leak", None, "downgrade", "")]


@expect("relabel_selections", "selection string, id string", [("exits", "1"), ("exits", "5"), ("review", "2"), ("review", "4"), ("downgrades", "3"), ("downgrades", "5")])
def relabel_selections(spark, d):
    x = spark.createDataFrame(_RELABEL, "id string, groq_category string, final_label string, source string, needs_review string")
    each = [f(x).select(F.lit(n).alias("selection"), "id") for n, f in (("exits", ds.credential_exits), ("review", ds.to_review), ("downgrades", ds.downgrades))]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("original_irrelevant", "SELECT id FROM raw_content WHERE classified AND category = 'irrelevant' AND NOT coalesce(trim(content) = '', false)")
def original_irrelevant(spark, d):
    return ds.original_irrelevant(table(spark, d, "raw_content").withColumn("is_noise", F.trim("content") == "")).select("id")


@query("actor_counts", "SELECT dismissed, count(*) AS actors FROM entities WHERE type = 'threat_actor' GROUP BY 1")
def actor_counts(spark, d):
    return gr.actor_counts(table(spark, d, "entities"))


@expect("error_table_lines", "line string", [("| sheet | rows | adjudicated | errors | unsure | pending | error rate |",), ("|---|---|---|---|---|---|---|",), ("| a | 6 | 3 | 1 | 1 | 1 | 33.3% |",), ("| b | 1 | 0 | 0 | 0 | 1 | — |",)])
def error_table_lines(spark, d):
    sheet = spark.createDataFrame([("a", "ok"), ("a", "Correct "), ("a", "wrong"), ("a", "?"), ("a", None), ("a", "maybe"), ("b", "")], "sheet string, verdict string")
    return spark.createDataFrame([(x,) for x in ds.error_table([r.asDict() for r in ds.verdict_summary(sheet).collect()]).split("\n")], "line string")


@expect("sub_classify_vectors", "content string, category string, sub_category string", [("fresh combo", "credential_leak", "combo_list"), ("RDP here", "access_broker", "rdp_access"), ("fresh combo", "data_dump", None), ("plain", "credential_leak", None)])
def sub_classify_vectors(spark, d):
    x = spark.createDataFrame([("fresh combo", "credential_leak"), ("RDP here", "access_broker"), ("fresh combo", "data_dump"), ("plain", "credential_leak")], "content string, category string")
    return pl.default_sub_classify(x)


@expect("severity_step", "id string, severity string", [("a", "critical"), ("b", "info")])
def severity_step(spark, d):
    x = spark.createDataFrame([("a", "ransomware here"), ("b", "plain")], "id string, content string")
    return pl.default_severity(x.withColumn("match", tx.match(F.col("content"), [tx.Rule("r", "keyword", ("ransomware",), "critical")]))).select("id", "severity")


@expect("entity_step", "record_id string, source string, name string, type string, observed boolean, confidence string", [("a", "chan", "IntelBroker", "threat_actor", True, "high"), ("a", "chan", "CVE-2026-12345", "vulnerability", False, "medium"), ("b", "id-b", "CVE-2026-1111", "vulnerability", False, "medium")])
def entity_step(spark, d):
    x = spark.createDataFrame([("a", "chan", "id-a", "IntelBroker", "cve-2026-12345, CVE-2026-12345"), ("b", "", "id-b", "admin", "CVE-2026-1111"), ("c", None, "id-c", "feed_bot", None)], "id string, source_name string, source_id string, author string, content string")
    return pl.default_entities(x)


@expect("evaluate_step", "cluster_id string, decision string", [("a", "promote"), ("b", "defer"), ("c", "reject"), ("d", "defer")])
def evaluate_step(spark, d):
    x = spark.createDataFrame([("a", 3, 0.9), ("b", 1, 0.9), ("c", 5, 0.2), ("d", 5, 0.5)], "cluster_id string, signal_count int, confidence double")
    return pl.default_evaluate(x).select("cluster_id", "decision")


@expect("triage_step", "identifier string, verdict string", [("http://abc.onion/x", "investigate"), ("https://pastebin.com/a", "investigate"), ("https://a.test/x", None)])
def triage_step(spark, d):
    return pl.default_triage(spark.createDataFrame([(x,) for x in ("http://abc.onion/x", "https://pastebin.com/a", "https://a.test/x")], "identifier string"))


by_rule("answered_iocs_vectors", [('[{"type":"ip","value":"1.2.3.5"}]', "ip=1.2.3.5"), ('{"iocs":[{"type":"domain","value":"a.su"},{"type":"ip","value":""}]}', "domain=a.su"), ('Here: {"indicators":[{"type":"url","value":"u"}]}', "url=u"), ("nothing", "")], lambda c: F.array_join(F.transform(pl.answered_iocs(c), lambda i: F.concat_ws("=", i["type"], i["value"])), ","))
by_rule("answered_triage_vectors", [('[{"url":"a","decision":"trash"}]', "a=trash"), ('{"results":[{"url":"b","decision":"Investigate"},{"url":"c","decision":"maybe"}]}', "b=Investigate"), ("no json", "")], lambda c: F.array_join(F.transform(pl.answered_triage(c), lambda i: F.concat_ws("=", i["url"], i["decision"])), ","))


@query("correlation_vectors", """SELECT t AS correlation_type, 'corr:' || t || ':' || sha256(k) AS cluster_id, c::DOUBLE AS confidence, s AS is_correlation FROM (VALUES ('shared_ioc', 'ip:91.92.93.94', 0.95, true),
('handle_reuse', 'IntelBroker:_', 0.8, false), ('temporal_overlap', 'f1:f2', 0.7, false), ('campaign_cluster', 'entity:malware:x:entity:malware:y', 0.7, false)) v(t, k, c, s)""")
def correlation_vectors(spark, d):
    """One address in three sources; one author in two; two records of two sources with two indicators in common within the window; two
    families with two targets in common, and two that only share a common tool."""
    at = AT
    raw = spark.createDataFrame([(f"f{i}", f"s{i}", f"n{i}", "first_party", "IntelBroker" if i in (1, 2) else "admin", None, at, True, "data_dump") for i in (1, 2, 3)], "id string, source_id string, source_name string, provenance string, author string, author_id string, collected_at timestamp, classified boolean, category string")
    seen = spark.createDataFrame([("ip", "91.92.93.94", f"f{i}", f"s{i}", f"n{i}", at) for i in (1, 2, 3)] + [("domain", "evil.su", f"f{i}", "s1", "n1", at) for i in (1, 2)], "ioc_type string, ioc_value string, raw_content_id string, source_id string, source_name string, created_at timestamp")
    entities = [(f"entity:malware:{x}", "malware", {"name": x}) for x in "xyzw"] + [("t1", "ip", {"name": "t1"}), ("t2", "ip", {"name": "t2"}), ("m1", "tool", {"name": "Mimikatz"}), ("m2", "tool", {"name": "mimikatz"})]
    edges = [(f"entity:malware:{x}", t) for x in "xy" for t in ("t1", "t2")] + [(f"entity:malware:{x}", t) for x in "zw" for t in ("m1", "m2")]
    got = co.cycle(seen, raw, spark.createDataFrame(entities, "id string, type string, properties map<string,string>"), spark.createDataFrame(edges, "source_id string, target_id string"), F.lit(at + timedelta(hours=1)))
    return got.select("correlation_type", "cluster_id", F.round("confidence", 6).alias("confidence"), "is_correlation")


def _labelled(spark):
    base = {"data_dump": "selling fresh database dump", "malware_sample": "exploit loader for sale"}
    names = sorted(base)
    rows = [(str(i), f"{base[names[i % 2]]} {i}", names[i % 2], "latin", "train" if i < 40 else "val" if i < 50 else "test", str(i), AT) for i in range(60)]
    return spark.createDataFrame(rows, "id string, text string, label string, language string, split string, content_hash string, collected_at timestamp")


@expect("train_classes", "split string, language string, class string, f1 double, support bigint", [(s, g, c, 1.0, 5) for s in ("val", "test") for g in (None, "latin") for c in ("data_dump", "malware_sample")])
def train_classes(spark, d):
    """Two classes that their words tell apart: held-out metrics are perfect."""
    _, metrics = ds.train_classes(_labelled(spark), char_features=2000, word_features=500)
    return metrics.select("split", "language", "class", "f1", "support")


# --- Configuration and routes ---
_GOOD = {"llm": {"provider": "p", "model": "m"}, "sources": {"web": {"enabled": True, "feeds": [{"type": "rss"}]}}, "matching": {"rules": [{"name": "a", "type": "keyword", "patterns": ["x"]}]}}
_BAD = {"llm": {"provider": "p"}, "sources": {"web": {"enabled": True, "feeds": [{"type": "rss"}, {"type": "gopher"}]}}, "matching": {"rules": [{"type": "glob", "patterns": []}]}}
by_function(
    "config_vectors",
    [(json.dumps(_GOOD), ""), ("{}", "llm.provider is missing; llm.model is missing; no source is enabled"), (json.dumps(_BAD), "llm.model is missing; sources.web.feeds[1].type is unknown: 'gopher'; matching.rules[0].name is missing; matching.rules[0].type is unknown: 'glob'; matching.rules[0].patterns is empty")],
    lambda x: "; ".join(cf.violations(json.loads(x))),
)
by_function("config_substitution", [("key: ${A}", "key: 1"), ("${MISSING}x", "x"), ("$A and ${A}${A}", "$A and 11")], lambda x: cf.substituted(x, {"A": "1"}))


@query("archive_search", "SELECT id FROM raw_content WHERE content ILIKE '%vpn%' AND category = 'access_broker' AND collected_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00'")
def archive_search(spark, d):
    return rd.archive_search(table(spark, d, "raw_content"), "vpn", "access_broker", [], datetime(2026, 6, 1, tzinfo=timezone.utc)).select("id")


@query("route_search", "SELECT id, left(content, 80) AS content FROM raw_content WHERE content ILIKE '%a%' AND author ILIKE '%a%' ORDER BY collected_at DESC, id LIMIT 30 OFFSET 10")
def route_search(spark, d):
    """A page is the feature here: the route's limit and offset."""
    return api.ROUTES["search"]({"raw_content": table(spark, d, "raw_content")}, {"q": "a", "author": "a", "limit": "30", "offset": "10", "since": "soon"}, AT).select("id", "content")


@query("route_subcategories", "SELECT category, sub_category, count(*) AS count FROM raw_content WHERE category IS NOT NULL AND sub_category IS NOT NULL AND sub_category <> '' GROUP BY 1, 2")
def route_subcategories(spark, d):
    return api.ROUTES["subcategories"]({"raw_content": table(spark, d, "raw_content")}, {}, AT).select("category", "sub_category", "count")


@query("route_timeline", "SELECT epoch_us(time_bucket(INTERVAL '1 day', collected_at, TIMESTAMPTZ '2000-01-01 00:00:00+00')) AS bucket, count(*) AS count FROM raw_content WHERE collected_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1")
def route_timeline(spark, d):
    x = api.ROUTES["timeline"]({"raw_content": table(spark, d, "raw_content")}, {"interval": "1 day", "since": "30d"}, AT)
    return x.select(F.unix_micros("bucket").alias("bucket"), F.col("count"))


@query("route_source_types", "SELECT key, count(s.id) AS count FROM (VALUES ('rss'), ('telegram'), ('web'), ('other')) v(key) LEFT JOIN (SELECT id, CASE WHEN type = 'rss' THEN 'rss' WHEN type LIKE 'telegram%' THEN 'telegram' WHEN type = 'web' THEN 'web' ELSE 'other' END AS k FROM sources) s ON s.k = v.key GROUP BY 1")
def route_source_types(spark, d):
    x = api.ROUTES["source_type_counts"]({"sources": table(spark, d, "sources")}, {}, AT)
    return x.select(F.col(x.columns[0]).alias("key"), F.col(x.columns[1]).alias("count"))


@expect("route_decisions", "cluster_id string, decision string", [("c2", "promote"), ("c1", "promote")])
def route_decisions(spark, d):
    x = spark.createDataFrame([("c1", "promote", AT - timedelta(2)), ("c2", "promote", AT), ("c3", "reject", AT)], "cluster_id string, decision string, created_at timestamp")
    return api.ROUTES["decisions"]({"decisions": x}, {"decision": "promote"}, AT).select("cluster_id", "decision")


@expect("route_vulnerability", "cve_id string", [("CVE-2026-2",)])
def route_vulnerability(spark, d):
    return api.ROUTES["vulnerability"]({"vulnerabilities": spark.createDataFrame([("CVE-2026-1",), ("CVE-2026-2",)], "cve_id string")}, {"id": "CVE-2026-2"}, AT)


@expect("source_actions", "identifier string, status string, error_count int", [("a", "approved", 0), ("b", "paused", 5), ("c", "active", 1), ("d", "rejected", 0)])
def source_actions(spark, d):
    """Approve, reject, pause, activate, remove, collect and errors as a fold over events."""
    s = spark.createDataFrame([(i, "discovered", 3 if i == "b" else 0, None) for i in "abcde"], "identifier string, status string, error_count int, last_collected timestamp")
    t = lambda h: AT + timedelta(hours=h)
    events = [("a", "approve", t(1)), ("b", "error", t(1)), ("b", "error", t(2)), ("b", "pause", t(3)), ("c", "error", t(1)), ("c", "collect", t(2)), ("c", "error", t(3)), ("c", "activate", t(4)), ("d", "reject", t(1)), ("e", "remove", t(1))]
    return up.source_states(s, spark.createDataFrame(events, "identifier string, action string, at timestamp")).select("identifier", "status", F.col("error_count").cast("int").alias("error_count"))

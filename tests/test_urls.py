from pyspark.sql import functions as F

from tidewatch.functions import urls as ur


def one(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", column(F.col("c")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_extraction(spark):
    got = one(spark, ur.extract_urls, "Join our channel https://t.me/darkleaks and group t.me/joinchat/abc123xyz, see https://pastebin.com/AbC1. https://pastebin.com/AbC1", None, "")
    assert got[0] == ["https://t.me/darkleaks", "t.me/joinchat/abc123xyz", "https://pastebin.com/AbC1"] and got[1:] == [[], []]


def test_classification(spark):
    assert one(spark, ur.classify_source, "https://t.me/+x", "https://t.me/abc", "http://abc.onion/", "https://rentry.co/x", "https://a.su/feed", "https://a.su/x") == ["telegram_group", "telegram_channel", "forum", "paste_site", "rss", "web"]


def test_skip_rules(spark):
    urls = ["https://a.su/FUZZ", "http://localhost/x1", "http://10.0.0.1/abc", "http://45.76.155/abc", "https://a.su/p.PNG", "https://bit.ly/abc", "https://a.su/", "https://a.su/ab", "https://a.su/?q=1", "https://a.su/x?" + "q" * 257, "http://172.20.1.1/abc", "http://172.32.1.1/abc"]
    assert one(spark, ur.skipped, *urls) == [True, True, True, True, True, True, True, False, False, True, True, False]


def test_lists(spark):
    cfg = ur.DiscoveryConfig(blacklist=("Bad.su",), allow_domains=("good.su",), allow_patterns=("*.onion", "ghostbin.*", "rentry.co"))
    assert one(spark, lambda c: ur.blacklisted(c, cfg), "https://x.bad.su/a", "https://", "https://docs.google.com/a", "https://notbad.su/a") == [True, True, True, False]
    assert one(spark, lambda c: ur.allowlisted(c, cfg), "https://t.me/x", "https://a.good.su/", "http://q.onion/x", "https://ghostbin.site/x", "https://rentry.co/x", "https://other.su/x") == [True, True, True, True, True, False]


def test_telegram_forms(spark):
    assert one(spark, lambda c: ur.telegram_name(c, ("Known",)), "https://t.me/chan/12", "t.me/my_bot", "t.me/known", "t.me/") == ["chan", "", "", ""]
    assert one(spark, ur.invite_hash, "https://t.me/+AbC/1", "t.me/joinchat/xyz/", "t.me/chan") == ["+AbC", "+xyz", ""]


def test_discover(spark):
    df = spark.createDataFrame([("b", "https://t.me/leak_chan/5 https://t.me/+Inv1"), ("a", "https://t.me/leak_chan and https://evil.su/panel"), ("c", None), ("a", "https://t.me/leak_chan and https://evil.su/panel")], "id string, content string")
    got = {r.identifier: (r.type, r.status, r.discovered_from) for r in ur.discover(df).collect()}
    assert got == {"leak_chan": ("telegram_channel", "discovered", "a"), "invite:+Inv1": ("telegram_group", "discovered", "b"), "https://evil.su/panel": ("web", "pending_triage", "a")}


def test_match_form(spark):
    assert one(spark, ur.url_match_form, " HTTPS://A.su/x%20y/ ", "bad%zz") == ["https://a.su/x y", "bad%zz"]

"""Readers of feeds, pastes, pages and vulnerability lists, from files that a fetcher has put down; no network here."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.dataset import RELABEL_COLUMNS

HREF = r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""
PASTE_ID = r"^/[A-Za-z0-9]{6,20}$"


def findings_of(df: DataFrame, source: str, source_id: Column, source_name: Column, content: Column, author: Column, at: Column, collected_at: Column, metadata: Column) -> DataFrame:
    """Rows in the form of collected findings; ids follow from source and content."""
    x = df.select(F.lit(source).alias("source"), source_id.alias("source_id"), source_name.alias("source_name"), content.alias("content"), author.alias("author"), at.alias("timestamp"), collected_at.alias("collected_at"), metadata.alias("metadata"))
    x = x.where("content is not null and content <> ''").withColumn("content_hash", F.sha2("content", 256))
    return x.withColumn("id", F.sha2(F.concat_ws("|", "source", "source_id", "content_hash"), 256)).dropDuplicates(["content_hash"])


def telegram(messages: DataFrame, collected_at: Column) -> DataFrame:
    """(channel_id, channel, message, caption, sender, sender_id, date, message_id): a message without text has its caption's."""
    text = F.coalesce(F.nullif("message", F.lit("")), "caption")
    meta = F.create_map(F.lit("message_id"), F.col("message_id").cast("string"), F.lit("sender_id"), F.col("sender_id").cast("string"))
    return findings_of(messages, "telegram", F.col("channel_id").cast("string"), F.col("channel"), text, F.col("sender"), F.timestamp_seconds("date"), collected_at, meta)


def paste_items(spark: SparkSession, path: str, bodies: DataFrame, collected_at: Column) -> DataFrame:
    """A paste list (JSON array) with its bodies (key, content)."""
    items = spark.read.schema("scrape_url string, full_url string, date string, key string, title string, user string").option("multiLine", True).json(path)
    x = items.join(bodies, "key")
    meta = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("url"), F.col("full_url")), lambda k, v: v.isNotNull() & (v != ""))
    return findings_of(x, "paste", F.col("key"), F.lit("pastebin"), F.col("content"), F.col("user"), F.timestamp_seconds(F.col("date").try_cast("bigint")), collected_at, meta)


def rss(spark: SparkSession, path: str, feed_url: str, name: str, collected_at: Column) -> DataFrame:
    """Items of an RSS file: description, else content; author's name, else address."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "description", "content:encoded", "author", "dc:creator", "pubDate")])
    x = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    text = F.coalesce(F.nullif("description", F.lit("")), F.col("`content:encoded`"))
    at = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    meta = F.map_filter(F.create_map(F.lit("url"), F.col("link"), F.lit("title"), F.col("title")), lambda k, v: v.isNotNull() & (v != ""))
    return findings_of(x, "web", F.lit(feed_url), F.lit(name), text, F.coalesce(F.nullif("author", F.lit("")), F.col("`dc:creator`"), F.lit("")), at, collected_at, meta)


def is_paste_link(href: Column) -> Column:
    low = F.lower(href)
    path = F.when(F.contains(href, F.lit("://")), F.regexp_extract(href, r"://[^/]*(/.*)$", 1)).otherwise(href)
    return F.contains(low, F.lit("/paste")) | F.contains(low, F.lit("/raw")) | F.regexp_like(path, F.lit(PASTE_ID))


def resolved(href: Column, base: Column) -> Column:
    b = F.regexp_replace(base, "/+$", "")
    origin = F.regexp_extract(b, r"^[a-z]+://[^/]+", 0)
    return F.when(F.regexp_like(href, F.lit("^[A-Za-z]+://")), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(b, "^[a-z]+:", 0), href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(b, F.lit("/"), href))


def page_links(html: Column, base: Column, pastes_only: bool = False, most: int | None = None) -> Column:
    """Links of a page, resolved, each once; anchors and scripts are none."""
    hrefs = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1)), lambda h: ~F.startswith(h, F.lit("#")) & ~F.startswith(F.lower(h), F.lit("javascript:")))
    if pastes_only:
        hrefs = F.filter(hrefs, is_paste_link)
    out = F.array_distinct(F.transform(hrefs, lambda h: resolved(h, base)))
    return F.slice(out, 1, most) if most else out


class Tree(HTMLParser):
    """A small element tree; enough for tag, .class, #id selectors and descendants."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = [{"tag": "", "attrs": {}, "parent": -1, "text": []}]
        self.open = [0]
        self.feed(html or "")

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "parent": self.open[-1], "text": []})
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for i in self.open:
            if not any(self.nodes[j]["tag"] in ("script", "style") for j in self.open):
                self.nodes[i]["text"].append(data)

    def _is(self, i: int, simple: str) -> bool:
        n = self.nodes[i]
        tag, rest = re.match(r"([\w-]*)(.*)", simple).groups()
        marks = re.findall(r"([.#])([\w-]+)", rest)
        return i > 0 and (not tag or n["tag"] == tag) and all(v in (n["attrs"].get("class") or "").split() if k == "." else n["attrs"].get("id") == v for k, v in marks)

    def select(self, selector: str, under: int = 0) -> list[int]:
        steps = selector.split()
        return [i for i in range(1, len(self.nodes)) if steps and self._is(i, steps[-1]) and self._inside(i, steps[:-1]) and (not under or under in self._up(i))]

    def _up(self, i: int) -> list[int]:
        out = []
        while (i := self.nodes[i]["parent"]) >= 0:
            out.append(i)
        return out

    def _inside(self, i: int, steps: list[str]) -> bool:
        up = self._up(i)
        for s in reversed(steps):
            at = next((k for k, j in enumerate(up) if self._is(j, s)), None)
            if at is None:
                return False
            up = up[at + 1 :]
        return True

    def words(self, i: int) -> str:
        return "".join(self.nodes[i]["text"]).strip()


def scraped(html: Column, selector: str) -> Column:
    """Texts of the elements that a selector names, empty ones out."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pages: pd.Series) -> pd.Series:
        def one(x):
            t = Tree(x)
            return [w for w in (t.words(i) for i in t.select(selector)) if w]

        return pages.map(one)

    return run(html)


def selected_links(html: Column, selector: str, base: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pages: pd.Series) -> pd.Series:
        def one(x):
            t = Tree(x)
            hrefs = [t.nodes[i]["attrs"].get("href") or "" for i in t.select(selector)]
            return list(dict.fromkeys(urljoin(base, h) for h in hrefs if h and not h.startswith(("#", "javascript:"))))

        return pages.map(one)

    return run(html)


def forum_posts(html: Column, content_selector: str, author_selector: str) -> Column:
    """Posts with the author found in the nearest ancestor, up to five levels."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("author", T.StringType())])))
    def run(pages: pd.Series) -> pd.Series:
        def one(x):
            t, out = Tree(x), []
            for i in t.select(content_selector):
                author = ""
                for up in t._up(i)[:5]:
                    names = t.select(author_selector, up) if author_selector else []
                    if names:
                        author = t.words(names[0])
                        break
                out.append({"content": t.words(i), "author": author})
            return out

        return pages.map(one)

    return run(html)


# --- Vulnerability lists ---
NVD_SCHEMA = (
    "vulnerabilities array<struct<cve: struct<id:string, published:string, lastModified:string, descriptions:array<struct<lang:string,value:string>>,"
    "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,vectorString:string,baseSeverity:string>>>>,"
    "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>, configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>,"
    "references:array<struct<url:string>>>>>"
)


def zoned(c: Column) -> Column:
    """An instant only if the text names its zone."""
    return F.when(F.regexp_like(c, F.lit(r"(Z|[+-]\d\d:\d\d)$")), c.try_cast("timestamp"))


def nvd(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema(NVD_SCHEMA).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    cvss = F.col("metrics.cvssMetricV31")[0]["cvssData"]
    weak = F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    cpe = F.flatten(F.flatten(F.transform("configurations", lambda c: F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    return x.select(
        F.col("id").alias("cve_id"), F.filter("descriptions", lambda d: d["lang"] == "en")[0]["value"].alias("description"), cvss["baseScore"].alias("cvss_v31_score"), cvss["vectorString"].alias("cvss_v31_vector"),
        cvss["baseSeverity"].alias("cvss_severity"), F.filter(weak, lambda w: ~w.isin("", "NVD-CWE-Other", "NVD-CWE-noinfo")).alias("cwe_ids"), cpe.alias("affected_products"),
        F.transform("references", lambda r: r["url"]).alias("reference_urls"), zoned(F.col("published")).alias("published_at"), zoned(F.col("lastModified")).alias("last_modified_at"), F.lit(False).alias("kev_listed"),
    )


def epss(spark: SparkSession, path: str) -> DataFrame:
    """cve, epss, percentile; comment and bad lines are skipped. Gzip is read as it is."""
    x = spark.read.option("comment", "#").option("header", True).schema("cve string, epss string, percentile string").csv(path)
    x = x.select(F.col("cve").alias("cve_id"), F.col("epss").try_cast("double").alias("epss_score"), F.col("percentile").try_cast("double").alias("epss_percentile"))
    return x.where("cve_id is not null and epss_score is not null and epss_percentile is not null")


def with_epss(vulns: DataFrame, scores: DataFrame) -> DataFrame:
    """Only known CVEs take a score."""
    s = scores.select("cve_id", F.col("epss_score").alias("_e"), F.col("epss_percentile").alias("_p")).dropDuplicates(["cve_id"])
    return vulns.join(s, "cve_id", "left").withColumn("epss_score", F.coalesce("_e", "epss_score")).withColumn("epss_percentile", F.coalesce("_p", "epss_percentile")).drop("_e", "_p")


def kev(spark: SparkSession, path: str) -> DataFrame:
    schema = "vulnerabilities array<struct<cveID:string, dateAdded:string, dueDate:string, knownRansomwareCampaignUse:string>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select("v.*")
    return x.select(
        F.col("cveID").alias("cve_id"), F.lit(True).alias("kev_listed"), F.try_to_date("dateAdded", "yyyy-MM-dd").alias("kev_date_added"), F.try_to_date("dueDate", "yyyy-MM-dd").alias("kev_due_date"),
        (F.lower("knownRansomwareCampaignUse") == "known").alias("kev_ransomware_use"), F.lit(1.0).alias("priority_score"), F.lit("critical").alias("priority_label"),
    )


# --- Enrichment look-ups: tables that the caller supplies ---
def enrich_abuse(iocs: DataFrame, lookup: DataFrame) -> DataFrame:
    """(value, confidence) for addresses."""
    return iocs.where("type = 'ip'").join(lookup, "value").select("type", "value", (F.col("confidence") / 100.0).alias("score"), (F.col("confidence") > 50).alias("malicious"), F.lit("abuse").alias("provider"))


def enrich_engines(iocs: DataFrame, lookup: DataFrame) -> DataFrame:
    """(value, malicious, total) for addresses, domains and hashes; not listed: not found, score 0."""
    x = iocs.where(F.col("type").isin("ip", "domain", "hash_md5", "hash_sha256")).join(lookup.withColumnRenamed("malicious", "_m"), "value", "left")
    score = F.coalesce(F.try_divide(F.col("_m").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return x.select("type", "value", score.alias("score"), F.coalesce(F.col("_m") > 5, F.lit(False)).alias("malicious"), F.when(F.col("_m").isNull(), "not_found").otherwise("engines").alias("provider"))


def enrich_certificates(lookup: DataFrame) -> DataFrame:
    """(domain, pos, issuer, not_before) -> count, issuers, first and last by list order."""
    return lookup.groupBy("domain").agg(F.count(F.lit(1)).alias("certificates"), F.countDistinct("issuer").alias("issuers"), F.min_by("not_before", "pos").alias("first"), F.max_by("not_before", "pos").alias("last"))


# --- Files of the dataset tools ---
def relabel_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    missing = set(RELABEL_COLUMNS) - set(header)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    return spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def gold_ids(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with an id column, or one id a line."""
    first = spark.read.text(path).first()
    if first and "id" in [c.strip().lower() for c in first[0].split(",")]:
        return spark.read.option("header", True).csv(path).select("id").where("id is not null").distinct()
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def channel_configs(registry: DataFrame, config: DataFrame) -> DataFrame:
    """Approved and active channels of the registry merged with configured ones (configured win), by key."""
    r = registry.where(F.col("status").isin("approved", "active") & F.col("type").isin("telegram_channel", "telegram_group"))
    r = r.select(F.lower(F.regexp_replace("identifier", r"^(https?://)?t\.me/", "")).alias("key"), "identifier", F.lit(1).alias("prio"))
    x = config.select(F.lower("identifier").alias("key"), "identifier", F.lit(0).alias("prio")).unionByName(r)
    return x.groupBy("key").agg(F.min(F.struct("prio", "identifier")).alias("m")).select("key", "m.identifier", (F.col("m.prio") == 0).alias("configured"))

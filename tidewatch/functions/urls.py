"""URL discovery: extraction, filters, classification and normal forms, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import contains_any, ends_with_any, url_host

# --- Fixed values: URL patterns and host lists ----------------------------------------------------------------------
URL_PATTERNS = (
    r"https?://[a-z2-7]{16,56}\.onion[/\S]*",
    r"(?:https?://)?t\.me/(?:joinchat/|\+)?[A-Za-z0-9_]+",
    r"https?://(?:pastebin\.com|ghostbin\.\w+|privatebin\.\w+|rentry\.co)/[A-Za-z0-9]+",
    r"https?://[^\s<>\"{}|\\^`\[\]]+",
)
BLACKLIST = (
    "lnkd.in", "youtube.com", "youtu.be", "docs.google.com", "google.com", "linkedin.com", "twitter.com", "x.com", "discord.gg", "mega.nz", "boosty.to", "skillbox.ru",
    "habr.com", "medium.com", "yandex.com", "localhost", "127.0.0.1", "w3.org", "schemas.xmlsoap.org", "microsoft.com", "images.contentstack.io", "brighttalk.com", "paloaltonetworks.com",
)
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp")
SKIP_HOSTS = ("embedly.com", "safelinks.protection.outlook.com", "player.vimeo.com", "t.co", "bit.ly", "tinyurl.com", "goo.gl")


@dataclass(frozen=True)
class DiscoveryConfig:
    blacklist: tuple[str, ...] = ()
    learned_blacklist: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    monitored: tuple[str, ...] = ()
    auto_approve: bool = False
    enabled: bool = field(default=True)


def extract_urls(content: Column) -> Column:
    """URLs by the patterns in order, trailing punctuation off, each once."""
    x = F.coalesce(content, F.lit(""))
    every = F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in URL_PATTERNS]))
    return F.array_distinct(F.transform(every, lambda u: F.regexp_replace(u, r"[.,;:!?)'\"]+$", "")))


def host_of(url: Column) -> Column:
    """Lower-case host; empty where there is no scheme or host."""
    return F.when(F.regexp_like(url, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), F.lower(url_host(url))).otherwise("")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def in_domains(host: Column, domains) -> Column:
    """The host is one of the domains or below one."""
    domains = tuple(d.lower() for d in domains)
    return (host.isin(*domains) if domains else F.lit(False)) | ends_with_any(host, tuple("." + d for d in domains))


def domain_allowed(host: Column, cfg: DiscoveryConfig) -> Column:
    out = in_domains(host, cfg.allow_domains)
    for p in (p.lower() for p in cfg.allow_patterns):
        if p.startswith("*."):
            out = out | F.endswith(host, F.lit(p[1:]))
        elif p.endswith(".*"):
            out = out | (host == p[:-2]) | F.startswith(host, F.lit(p[:-1]))
        else:
            out = out | in_domains(host, (p,))
    return out


def blacklisted(url: Column, cfg: DiscoveryConfig) -> Column:
    host = host_of(url)
    return (host == "") | in_domains(host, (*BLACKLIST, *cfg.blacklist, *cfg.learned_blacklist))


def allowlisted(url: Column, cfg: DiscoveryConfig) -> Column:
    host = host_of(url)
    return (host != "") & ((host == "t.me") | domain_allowed(host, cfg))


def skipped(url: Column) -> Column:
    """Fuzzing templates, local and truncated addresses, images, shorteners, overlong queries and bare hosts."""
    host, path, query = host_of(url), path_of(url), query_of(url)
    private = F.regexp_like(host, F.lit(r"^(10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^::1|^fe80:"))
    return (
        F.contains(url, F.lit("FUZZ"))
        | F.contains(F.lower(url), F.lit("localhost"))
        | private
        | F.regexp_like(host, F.lit(r"^\d+\.\d+(\.\d+)?$"))
        | ends_with_any(F.lower(path), IMAGES)
        | in_domains(host, SKIP_HOSTS)
        | (F.endswith(host, F.lit("blogger.com")) & F.contains(F.lower(path), F.lit("/video.g")))
        | (F.length(query) > 256)
        | ((F.length(F.regexp_replace(path, "/+$", "")) < 2) & (query == ""))
    )


def classify_source(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(contains_any(low, ("t.me/joinchat/", "t.me/+")), "telegram_group")
        .when(F.contains(low, F.lit("t.me/")), "telegram_channel")
        .when(F.contains(low, F.lit(".onion")), "forum")
        .when(contains_any(low, ("pastebin.com", "ghostbin.", "privatebin.", "rentry.co")), "paste_site")
        .when(F.endswith(low, F.lit(".xml")) | contains_any(low, ("/feed", "/rss", "/atom")), "rss")
        .otherwise("web")
    )


def invite_hash(url: Column) -> Column:
    """``+hash`` of an invite link, else empty."""
    got = F.regexp_extract(url, r"(?i)t\.me/(?:\+|joinchat/)([^/]*)", 1)
    return F.when(F.regexp_like(url, F.lit(r"(?i)t\.me/(\+|joinchat/)")), F.concat(F.lit("+"), got)).otherwise("")


def telegram_name(url: Column, monitored: tuple[str, ...] = ()) -> Column:
    """Bare channel name; empty for bots, monitored channels and links without a name."""
    name = F.regexp_extract(url, r"(?i)t\.me/([^/]*)", 1)
    drop = (name == "") | F.endswith(F.lower(name), F.lit("bot"))
    if monitored:
        drop = drop | F.lower(name).isin(*[m.lower() for m in monitored])
    return F.when(drop, "").otherwise(name)


def identifier_of(url: Column, kind: Column, cfg: DiscoveryConfig) -> Column:
    """What a source is stored under; empty if it is to be dropped."""
    code = invite_hash(url)
    return (
        F.when(kind == "telegram_channel", telegram_name(url, cfg.monitored)).when(kind == "telegram_group", F.when(code == "", "").otherwise(F.concat(F.lit("invite:"), code))).otherwise(url)
    )


def discover(records: DataFrame, cfg: DiscoveryConfig = DiscoveryConfig(), id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(type, identifier, name, status, discovered_from): sources named in contents, once each, from the smallest record id."""
    u = F.col("url")
    x = records.select(F.col(id_col).alias("from_id"), F.explode(extract_urls(F.col(content_col))).alias("url")).where(~blacklisted(u, cfg) & ~skipped(u))
    x = x.withColumn("type", classify_source(u)).withColumn("allowed", allowlisted(u, cfg)).withColumn("identifier", identifier_of(u, F.col("type"), cfg)).where("identifier <> ''")
    status = F.when(F.col("allowed"), "approved" if cfg.auto_approve else "discovered").otherwise("pending_triage")
    first = F.min(F.struct("from_id", "type", status.alias("status")))
    return x.groupBy("identifier").agg(first.alias("f")).select("f.type", "identifier", F.col("identifier").alias("name"), "f.status", F.col("f.from_id").alias("discovered_from"))


def url_match_form(url: Column) -> Column:
    """For comparing answers with what was asked: lower case, no trailing slash, unescaped."""
    x = F.regexp_replace(F.lower(F.trim(url)), "/+$", "")
    return F.coalesce(F.try_url_decode(x), x)


def collector_module(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(F.contains(low, F.lit("telegram")), "collector.telegram")
        .when(F.contains(low, F.lit("paste")), "collector.paste")
        .when(F.contains(low, F.lit("forum")), "collector.forum")
        .when(contains_any(low, ("rss", "web")), "collector.web")
        .otherwise(F.concat(F.lit("collector."), name))
    )


def channel_name(username: Column, invite: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(username, F.lit("")), F.concat(F.lit("invite:"), F.nullif(invite, F.lit(""))), F.concat(F.lit("channel:"), number.cast("string")))

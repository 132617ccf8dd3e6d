"""Scalar functions and scores as column expressions. The clock is always an argument."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import CATEGORY_TAG, DEFAULT_LIFETIME_DAYS, IOC_LIFETIME_DAYS, SEVERITIES, SUB_CATEGORIES


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def ts(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


# --- Severity lattice ---
def severity_rank(c: Column) -> Column:
    """info 0 ... critical 4; anything else is null."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.lower(c) == s, i).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def severity_max(*cols: Column) -> Column:
    return severity_name(F.greatest(*[F.coalesce(severity_rank(c), F.lit(0)) for c in cols], F.lit(0)))


def severity_sort(c: Column) -> Column:
    """Sort rank of top lists: critical 0 ... info and others 4."""
    return F.lit(4) - F.coalesce(severity_rank(c), F.lit(0))


# --- Numbers and limits ---
def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normalize_limit(limit: int | None, default: int = 50, most: int = 500) -> int:
    return default if not limit or limit <= 0 else min(limit, most)


def int_param(text: str | None, default: int = 0) -> int:
    try:
        n = int(text)
    except (TypeError, ValueError):
        return default
    return n if n >= 0 else default


def float_param(text: str | None, default: float = 0.0) -> float:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return default
    return x if x >= 0 else default


def parse_since(text: str, as_of: datetime, strict: bool = False) -> datetime | None:
    """``7d``, ``12h``, ``30m`` before ``as_of``, or an RFC 3339 instant. Bad text gives None; ``strict`` knows only positive
    days and hours and raises."""
    m = re.fullmatch(r"(-?\d+)([dhm])", text or "")
    if strict:
        if not m or m[2] == "m" or int(m[1]) <= 0:
            raise ValueError(f"not a duration: {text!r}")
    if m:
        return as_of - timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})
    try:
        got = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
        return got if got.tzinfo else None
    except ValueError:
        return None


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def date_bin(c: Column, width: str) -> Column:
    """Start of the bucket of ``width`` (1 hour, 6 hours, 1 day, 1 week, else 1 hour) counted from 2000-01-01."""
    seconds = {"1 hour": 3600, "6 hours": 21600, "1 day": 86400, "1 week": 604800}.get(width, 3600)
    origin = 946684800
    return F.timestamp_seconds(F.floor((F.unix_seconds(c.cast("timestamp")) - origin) / seconds) * seconds + origin)


def hours_apart(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / F.lit(3.6e9)


# --- Scores ---
def lifetime_days(kind: Column, own: Column | None = None) -> Column:
    out = F.lit(float(DEFAULT_LIFETIME_DAYS))
    for k, v in IOC_LIFETIME_DAYS.items():
        out = F.when(kind == k, float(v)).otherwise(out)
    return F.coalesce(F.nullif(own.cast("double"), F.lit(0.0)), out) if own is not None else out


def decayed(base: Column, kind: Column, last_seen: Column, as_of: Column, own_lifetime: Column | None = None) -> Column:
    """base * exp(-0.3 * days since last seen / lifetime)"""
    days = (micros(as_of) - micros(last_seen)) / F.lit(86_400e6)
    return base * F.exp(F.lit(-0.3) * days / lifetime_days(kind, own_lifetime))


def vulnerability_priority(kev: Column, epss: Column, cvss: Column, mentions: Column, exploit: Column) -> tuple[Column, Column]:
    """(score, label)"""
    mix = (
        F.lit(0.4) * F.coalesce(epss, F.lit(0.0))
        + F.lit(0.3) * (F.coalesce(cvss, F.lit(0.0)) / 10)
        + F.lit(0.2) * F.least(F.coalesce(mentions, F.lit(0)).cast("double") / 10, F.lit(1.0))
        + F.lit(0.1) * F.when(F.coalesce(exploit, F.lit(False)), 1.0).otherwise(0.0)
    )
    score = F.when(F.coalesce(kev, F.lit(False)), F.lit(1.0)).otherwise(mix)
    label = F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").when(score >= 0.1, "low").otherwise("info")
    return score, label


#: Correlation confidence: rule -> (per unit, base) (fixed values).
CONFIDENCE = {"shared_ioc": (0.15, 0.5), "handle_reuse": (0.2, 0.4), "temporal_overlap": (0.2, 0.3), "campaign_cluster": (0.15, 0.4)}


def correlation_confidence(rule: str, n: Column) -> Column:
    per, base = CONFIDENCE[rule]
    return clamp(F.lit(per) * n.cast("double") + F.lit(base))


def source_value_score(unique_iocs: Column, contributions: Column, severity: Column, s2n: Column, fresh: Column, total: Column) -> Column:
    ratio = lambda c: F.when(total > 0, c.cast("double") / total).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.3) * ratio(unique_iocs) + F.lit(0.2) * ratio(contributions) + F.lit(0.2) * severity / 4 + F.lit(0.15) * s2n + F.lit(0.15) * fresh)


def enrichment_score(provider: str, malicious: Column, total: Column | None = None) -> Column:
    """Provider score in [0, 1]: a confidence of 100 (``abuse``) or the share of engines (``engines``)."""
    return malicious / 100.0 if provider == "abuse" else F.coalesce(F.try_divide(malicious.cast("double"), total.cast("double")), F.lit(0.0))


def boosted_base(base: Column, best: Column) -> Column:
    return F.greatest(base, F.lit(0.8) * best)


def token_estimate(chars: Column, max_tokens: Column | None = None) -> Column:
    return F.floor(chars / 4) + 50 + (F.when(max_tokens > 0, max_tokens).otherwise(256) if max_tokens is not None else F.lit(256))


def token_cost(tokens: Column, rate_per_million: Column) -> Column:
    return tokens / F.lit(1e6) * rate_per_million


def retry_delay(attempt: int) -> int:
    return min(30, 2 ** max(1, attempt))


# --- Classification helpers ---
def provenance_or_unknown(c: Column) -> Column:
    return F.when(c.isin("first_party", "third_party_reporting"), c).otherwise("unknown")


def category_tags(category: Column, confidence: Column | None = None) -> Column:
    """The category and its tag; ``needs_review`` below 0.8. No category: no tags."""
    tag = F.lit(None).cast("string")
    for k, v in CATEGORY_TAG.items():
        tag = F.when(category == k, v).otherwise(tag)
    review = F.when(confidence < 0.8, "needs_review") if confidence is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(F.nullif(category, F.lit("")), tag, review))


def valid_sub_category(category: Column, sub: Column) -> Column:
    out = F.lit(False)
    for k, v in SUB_CATEGORIES.items():
        out = F.when(category == k, sub.isin(*v)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def next_run(as_of: datetime, hour: int) -> datetime:
    """The next instant at ``hour`` UTC after ``as_of``."""
    at = as_of.replace(hour=hour, minute=0, second=0, microsecond=0)
    return at if at > as_of else at + timedelta(days=1)

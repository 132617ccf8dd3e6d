"""Configuration: YAML with ${NAME} substitution and a validation that names every violation."""

from __future__ import annotations

import os
import re

from tidewatch.functions.text import Rule


def substituted(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` by the environment's value; unknown names become empty."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], ""), text)


def load(text: str, env: dict[str, str] | None = None) -> dict:
    import yaml

    return yaml.safe_load(substituted(text, env)) or {}


def violations(cfg: dict) -> list[str]:
    out = []
    llm = cfg.get("llm") or {}
    out += [f"llm.{k} is missing" for k in ("provider", "model") if not llm.get(k)]
    sources = cfg.get("sources") or {}
    if not any((sources.get(k) or {}).get("enabled") for k in ("telegram", "paste", "forums", "web")):
        out.append("no source is enabled")
    for i, feed in enumerate((sources.get("web") or {}).get("feeds") or []):
        if feed.get("type") not in ("rss", "scrape", "search"):
            out.append(f"sources.web.feeds[{i}].type is unknown: {feed.get('type')!r}")
    for i, r in enumerate((cfg.get("matching") or {}).get("rules") or []):
        if not r.get("name"):
            out.append(f"matching.rules[{i}].name is missing")
        if r.get("type") not in ("keyword", "regex"):
            out.append(f"matching.rules[{i}].type is unknown: {r.get('type')!r}")
        if not r.get("patterns"):
            out.append(f"matching.rules[{i}].patterns is empty")
    return out


def rules(cfg: dict) -> list[Rule]:
    return [Rule(r["name"], r["type"], tuple(r["patterns"]), r.get("severity", "info")) for r in (cfg.get("matching") or {}).get("rules") or []]

"""Policy source: one YAML file -> dimension tables.

The file is configuration, read through Hadoop's file systems; each table has a handful of rows.
"""

from __future__ import annotations

import os
import re
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from promptsieve import constants as K
from promptsieve.session import local_table
from promptsieve.sources.signatures import read_text

_VARIABLE = re.compile(r"\$\{([^}:]+)(?::-([^}]*))?\}")

SCHEMAS = {
    "category_policy": "category string, action string, threshold double, sensitivity double",
    "allowlist": "client_id string, categories array<string>",
    "upstreams": "provider string, url string, auth_header string, timeout int",
    "routing_tasks": "task string, ordered_pool array<string>, fallback array<string>",
    "downgrades": "ordinal int, provider string, `from` string, `to` string",
    "settings": "name string, value string",
}

# Defaults of settings that are not in the file.
DEFAULTS = {
    "server.host": "0.0.0.0",
    "server.workers": 4,
    "scanner.enabled": True,
    "scanner.request_scanning": True,
    "scanner.regex": True,
    "scanner.heuristics": True,
    "scanner.ml_classifier": False,
    "scanner.response.enabled": False,
    "scanner.response.mode": "buffered",
    "scanner.response.buffer_size": K.STREAM_BUFFER_CHARS,
    "ml_classifier.enabled": False,
    "ml_classifier.threshold": 0.7,
    "ml_classifier.action": "block",
    "policy.default_action": "block",
    "security.failure_mode": "open",
    "security.scanner_timeout_ms": 100,
    "security.upstream_timeout_s": 60,
    "security.max_request_size": K.MAX_REQUEST_BYTES,
    "security.max_response_size": K.MAX_RESPONSE_BYTES,
    "security.expose_details": False,
    "metrics.enabled": True,
    "metrics.path": "/metrics",
    "logging.level": "info",
    "logging.format": "json",
    "logging.redact_keys": True,
    "identity.method": "ip",
    "identity.header_name": "X-Client-ID",
    "identity.trust_xff": False,
    "identity.hash_token": True,
    "cost_optimization.anthropic_prompt_cache": False,
    "cost_optimization.response_cache": False,
    "routing.dry_run": True,
    "cache.enabled": False,
    "cache.ttl_seconds": K.CACHE_TTL_SECONDS,
}
CATEGORY_THRESHOLD = 0.8


def substitute(value: Any) -> Any:
    """Fill ``${VAR}`` and ``${VAR:-default}`` in every text of a YAML value."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: substitute(v) for k, v in value.items()}
    return [substitute(v) for v in value] if isinstance(value, list) else value


def _flat(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in tree.items():
        if isinstance(value, dict):
            out |= _flat(value, f"{prefix}{key}.")
        elif not isinstance(value, list):
            out[f"{prefix}{key}"] = value
    return out


def _setting(value: Any) -> str | None:
    return str(value).lower() if isinstance(value, bool) else None if value is None else str(value)


def policy_tables(text: str) -> dict[str, list[tuple]]:
    """Rows per table of a policy YAML text."""
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("a policy file must be a YAML mapping")
    doc = substitute(raw)
    policy, routing = doc.get("policy") or {}, doc.get("routing") or {}
    upstreams = []
    for name, u in (doc.get("upstreams") or {}).items():
        if "url" not in u:
            raise ValueError(f"upstream {name!r} has no url")
        timeout = int(str(u.get("timeout", "60s")).removesuffix("s"))
        upstreams.append((name, u["url"], u.get("auth_header", "Authorization"), timeout))
    number = lambda v: None if v is None else float(v)
    categories = []
    for name, c in (policy.get("categories") or {}).items():
        sensitivity = number(c.get("sensitivity"))
        threshold = number(c.get("threshold", None if sensitivity is not None else CATEGORY_THRESHOLD))
        categories.append((name, c.get("action", "block"), threshold, sensitivity))
    ttl = int((doc.get("cache") or {}).get("ttl_seconds") or K.CACHE_TTL_SECONDS)
    sections = ("server", "scanner", "ml_classifier", "policy", "security", "metrics", "logging",
                "identity", "cost_optimization", "routing", "cache")
    given = _flat({k: v for k, v in doc.items() if k in sections and isinstance(v, dict)})
    given = {k: v for k, v in given.items()
             if not k.startswith(("policy.categories.", "routing.tasks."))}
    settings = DEFAULTS | given | {"cache.ttl_seconds": max(1, min(ttl, K.CACHE_TTL_SECONDS))}
    return {
        "category_policy": categories,
        "allowlist": [(a.get("client_id", ""), list(a.get("categories", [])))
                      for a in policy.get("allowlists") or []],
        "upstreams": upstreams,
        "routing_tasks": [(t, list(c.get("ordered_pool") or []), list(c.get("fallback") or []))
                          for t, c in (routing.get("tasks") or {}).items() if isinstance(c, dict)],
        "downgrades": [(i, d.get("provider"), d.get("from"), d.get("to"))
                       for i, d in enumerate(routing.get("downgrades") or []) if isinstance(d, dict)],
        "settings": [(k, _setting(v)) for k, v in sorted(settings.items())],
    }


def read_policy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Policy file, on any file system that Hadoop knows -> category_policy, allowlist, upstreams,
    routing_tasks, downgrades, settings."""
    rows = policy_tables(read_text(spark, str(path)))
    return {name: local_table(spark, rows[name], SCHEMAS[name]) for name in SCHEMAS}

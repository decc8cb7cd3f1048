"""All registered queries: name -> (build(spark, sf_dir), check SQL or None)."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("text", "detection", "policy", "cost", "lifecycle", "metrics", "streaming")


def entries() -> dict:
    found: dict = {}
    for section in SECTIONS:
        found |= import_module(f"promptsieve.plans.catalog_{section}").ENTRIES
    return found

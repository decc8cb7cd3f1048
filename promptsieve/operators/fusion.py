"""Fuse detector candidates into one verdict per row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.text import SCAN_NEEDS, SCAN_VIEWS
from promptsieve.operators.evasion import append_signals, as_candidates
from promptsieve.operators.signatures import RuleSet, action_rank

VERDICT = ("action", "category", "signature_id", "confidence", "details", "matches")


@dataclass(frozen=True)
class ScanConfig:
    """Detector switches. A detector that is off is left out of the plan.

    ``model`` and ``extra`` are functions DataFrame -> DataFrame that append the candidate
    column they are keyed by; they vote after signatures and evasion signals.
    """

    enabled: bool = True
    request_scanning: bool = True
    regex: bool = True
    heuristics: bool = True
    max_length: int = K.MAX_TEXT_LENGTH
    extra: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def best_of(df: DataFrame, detectors: list[str]) -> DataFrame:
    """Replace candidate columns by the verdict columns.

    The winner has the highest (action rank, confidence); the earlier candidate wins ties,
    which the negated position expresses inside the compared struct. No shuffle. The verdict comes out
    of an outer generator on purpose: a filter on it would else be taken below the scan, which holds
    all detectors, and run them a second time.
    """
    rest = [c for c in df.columns if c not in detectors]
    votes = F.concat(*[F.coalesce(F.col(d), F.array().cast(df.schema[d].dataType)) for d in detectors])
    ranked = F.transform("_votes", lambda v, i: F.struct(
        action_rank(v.action).alias("rank"), v.confidence.alias("confidence"), (-i).alias("at"),
        v.alias("vote"),
    ))
    best = F.col("_best")
    return (
        df.select(*rest, votes.alias("_votes"))
        .withColumn("_best", F.array_max(ranked)["vote"])
        .select(*rest, F.inline_outer(F.array(F.struct(
            F.coalesce(best["action"], F.lit("allow")).alias("action"),
            best["category"].alias("category"),
            best["signature_id"].alias("signature_id"),
            F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"),
            best["detail"].alias("details"),
            F.when(F.size("_votes") > 0, F.transform("_votes", lambda v: v.detail)).alias("matches"),
        ))))
    )


def fuse(
    df: DataFrame, text: str, rules: RuleSet, config: ScanConfig = ScanConfig()
) -> DataFrame:
    """Append the scan verdict: action, category, signature_id, confidence, details, matches."""
    detectors: list[str] = []
    scanned = df
    first = None
    if config.enabled and config.regex:
        # Signals share the pass over the texts that judges the gates.
        shared = (tuple(SCAN_NEEDS), SCAN_VIEWS) if config.heuristics else ()
        first = len(rules.patterns) if shared else None
        scanned = scanned.withColumn("_gates", rules.gates(text, *shared)).withColumn(
            "_regex", rules.candidates(text, "_gates"))
        scanned = scanned if shared else scanned.drop("_gates")
        detectors.append("_regex")
    if config.enabled and config.heuristics:
        scanned = append_signals(scanned, text, config.max_length, first).withColumn(
            "_evasion", as_candidates(F.col("signals"))
        ).drop("signals")
        detectors.append("_evasion")
    if config.enabled:
        for name, detector in config.extra.items():
            scanned = detector(scanned)
            detectors.append(name)
    if not detectors:
        return df.select(
            "*", F.lit("allow").alias("action"), F.lit(None).cast("string").alias("category"),
            F.lit(None).cast("string").alias("signature_id"), F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("details"),
            F.lit(None).cast("array<string>").alias("matches"),
        )
    return best_of(scanned, detectors)

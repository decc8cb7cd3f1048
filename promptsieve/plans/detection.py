"""Composed detection plans."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.operators.fusion import ScanConfig, fuse
from promptsieve.operators.signatures import RuleSet
from promptsieve.sources.sinks import public_verdicts


def check(
    df: DataFrame, rules: RuleSet, text: str = "text", config: ScanConfig = ScanConfig(),
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Detection only, for ``df.transform``: action, category, signature_name, confidence,
    error_type, is_safe, is_blocked, requires_attention.

    A row without text is an ``invalid_request`` and is not judged. Policy is not applied.
    One projection over the scan; no shuffle.
    """
    kept = tuple(c for c in df.columns if c != text) if keep is None else keep
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    scanned = fuse(df, text, rules, config).withColumn(
        "error_type", F.when(empty, "invalid_request"))
    judged = public_verdicts(scanned, rules, (*kept, "error_type"))
    valid = F.col("error_type").isNull()
    return judged.withColumns({
        c: F.when(valid, F.col(c)) for c in ("action", "category", "signature_name", "confidence")
    }).withColumns({
        "is_safe": F.col("action") != "block",
        "is_blocked": F.col("action") == "block",
        "requires_attention": F.col("action").isin("warn", "block"),
    })


class MutatorRegistry:
    """Ordered body mutators (DataFrame -> DataFrame, or None for no change).

    Scans come after them, so they see the final text. A mutator that cannot be planned is
    skipped with a warning.
    """

    def __init__(self) -> None:
        self._mutators: list = []

    def register(self, mutate) -> None:
        self._mutators.append(mutate)

    def apply(self, df: DataFrame) -> DataFrame:
        for mutate in self._mutators:
            try:
                changed = mutate(df)
            except Exception as error:  # noqa: BLE001 - a bad mutator must not stop the scan
                warnings.warn(f"mutator skipped: {error}", stacklevel=2)
                continue
            df = df if changed is None else changed
        return df

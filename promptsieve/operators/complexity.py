"""Prompt complexity: weighted text dimensions and a tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions import text as T
from promptsieve.functions.variant import items_at, text_at


def prompt_text(body: Column) -> Column:
    """Prompt text of a VARIANT request body: ``system``, ``prompt`` and message contents,
    each a string or text blocks, joined by newlines."""

    def texts(holder: Column, path: str) -> Column:
        blocks = F.transform(
            F.coalesce(items_at(holder, path), F.array().cast("array<variant>")),
            lambda b: text_at(b, "$.text"))
        return F.concat(F.array(text_at(holder, path)), blocks)

    messages = F.coalesce(items_at(body, "$.messages"), F.array().cast("array<variant>"))
    parts = F.concat(
        texts(body, "$.system"), F.array(text_at(body, "$.prompt")),
        F.flatten(F.transform(messages, lambda m: texts(m, "$.content"))),
    )
    return F.when(body.isNotNull(), F.array_join(F.array_compact(parts), "\n"))


def _multistep(text: Column, lowered: Column) -> Column:
    """MULTISTEP, its alternatives apart so that each has a word gate. The atomic group stops
    the search after the first opening word: a later one cannot find what it missed."""
    has = lambda w: F.contains(lowered, F.lit(w))
    ordered = lambda w: has(w) & has("then") & text.rlike(
        rf"(?Uis)\A(?>.*?\b{w}\b).*\bthen\b")
    return (
        (has("step") & text.rlike(r"(?Ui)\bstep\s*\d"))
        | (has(".") & text.rlike(r"(?U)\b\d+\.\s"))
        | ordered("first") | ordered("next")
        | (has("finally") & text.rlike(r"(?Ui)\bfinally\b"))
    )


def complexity(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``complexity`` STRUCT<score, tier, breakdown, reasoning_markers,
    has_complexity_signal, raw_score>.

    ``score`` is rounded to 3 places, ``raw_score`` is not. Two reasoning markers force tier
    strong and a score of at least its bound.
    """
    raw, low = F.col(text), F.col("_lower")
    counted = df.withColumn("_lower", F.lower(raw)).withColumns({
        "_tokens": F.coalesce(T.tokens_estimate(raw), F.lit(0)),
        "_code": F.contains(raw, F.lit(K.CODE_FENCE)) | raw.rlike(f"(?U){K.CODE_HINTS}"),
        "_reasoning": T.count_occurrences(low, K.REASONING_MARKERS),
        "_technical": T.count_occurrences(low, K.TECHNICAL_TERMS),
        "_analysis": T.count_occurrences(low, K.ANALYSIS_VERBS),
        "_simple": T.count_occurrences(low, K.SIMPLE_INDICATORS),
        "_multistep": _multistep(raw, low),
        "_question": T.count_occurrences(raw, ("?",)) + T.count_occurrences(low, K.DEEP_QUESTIONS),
    })
    names = list(K.COMPLEXITY_WEIGHTS)
    parts = {
        n: F.least(F.col(f"_{n}").cast("int") / F.lit(K.COMPLEXITY_WEIGHTS[n][1]), F.lit(1.0))
        for n in names
    }
    blend = reduce(
        lambda a, b: a + b, [F.col(f"_part.{n}") * F.lit(K.COMPLEXITY_WEIGHTS[n][0]) for n in names])
    clamped = F.greatest(F.lit(0.0), F.least(blend, F.lit(1.0)))
    trivial, simple, moderate = K.TIER_BOUNDS
    forced = F.col("_reasoning") >= 2
    tier = (
        F.when(forced, "strong").when(F.col("_score") < trivial, "trivial")
        .when(F.col("_score") < simple, "simple").when(F.col("_score") < moderate, "moderate")
        .otherwise("strong")
    )
    signal = (
        F.col("_code") | (F.col("_reasoning") > 0) | (F.col("_technical") > 0)
        | (F.col("_analysis") > 0) | F.col("_multistep")
    )
    exact = F.when(forced, F.greatest(F.col("_score"), F.lit(moderate))).otherwise(F.col("_score"))
    result = F.struct(
        F.when(forced, exact).otherwise(F.bround(exact, 3)).alias("score"), tier.alias("tier"),
        F.struct(*[F.bround(f"_part.{n}", 3).alias(n) for n in names]).alias("breakdown"),
        F.col("_reasoning").alias("reasoning_markers"), signal.alias("has_complexity_signal"),
        exact.alias("raw_score"),
    )
    return (
        counted.withColumn("_part", F.struct(*[c.alias(n) for n, c in parts.items()]))
        .withColumn("_score", clamped)
        .select(*df.columns, F.when(raw.isNotNull(), result).alias("complexity"))
    )


def downgrade_eligible(score: str = "complexity") -> Column:
    """A low tier and no sign of code, reasoning, technical terms, analysis or steps."""
    return F.col(f"{score}.tier").isin("trivial", "simple") & ~F.col(f"{score}.has_complexity_signal")

"""Signature matching: rule sets compiled into literal-pattern columns.

A rule set is configuration of bounded size, so it is read on the driver and every pattern
becomes one literal expression of the scan projection. There is no join of texts with
patterns and no shuffle.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.gates import non_ascii_sql, open_gates, quote, required_words

CANDIDATE = (
    "array<struct<action:string,category:string,signature_id:string,detail:string,"
    "confidence:double>>"
)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str = "unknown"
    severity: str = "medium"
    action: str = "block"
    patterns: tuple[str, ...] = ()
    scan_target: str = "request"


def java_pattern(pattern: str) -> str:
    """Python's named groups, their references and the end of text, as Java spells them."""
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<(\w+)>", r"\1(?<\2>", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P=(\w+)\)", r"\1\\k<\2>", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def pattern_fault(pattern: str) -> str | None:
    """Why the JVM cannot compile a pattern, None if it can; without a session Python judges."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile("(?i)(?d)" + pattern)
    except (re.error, IllegalArgumentException) as bad:
        return str(bad).splitlines()[0]
    return None


@dataclass(frozen=True)
class RuleSet:
    """Rules in order; the order decides ties."""

    rules: tuple[Rule, ...]

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> RuleSet:
        """Collect a signature table: configuration, of whatever length."""
        rows = df.orderBy("ordinal").collect()
        return cls(tuple(
            Rule(r.id, r.name, r.category, r.severity, r.action, tuple(r.patterns or ()),
                 r.scan_target)
            for r in rows
        ))

    def for_responses(self, categories=()) -> RuleSet:
        """Rules that apply to responses, within ``categories`` if any are given."""
        return replace(self, rules=tuple(
            r for r in self.rules
            if r.scan_target in ("response", "both")
            and (not categories or r.category in categories)
        ))

    @cached_property
    def patterns(self) -> list[tuple[str, Rule]]:
        """Flat (pattern, rule) list in the dialect of the engine that runs it; a pattern that
        it cannot compile is skipped."""
        usable = []
        for rule in self.rules:
            for pattern in rule.patterns:
                java = java_pattern(pattern)
                bad = pattern_fault(java)
                if bad:
                    warnings.warn(f"rule {rule.id}: pattern skipped, {bad}", stacklevel=2)
                else:
                    usable.append((java, rule))
        return usable

    def gates(self, text: str, more: tuple = (), views: tuple = ()) -> Column:
        """Numbers of the patterns whose word gate a text opens, for ``match_texts`` and ``candidates``;
        after them the gates of other steps (``open_gates``), judged in the same pass."""
        if not self.patterns and not more:
            return F.array().cast("array<int>")
        return open_gates(F.col(text), [*(required_words(p) for p, _ in self.patterns), *more], views)

    def match_texts(self, text: str, gates: str) -> list[str]:
        """One SQL ARRAY<STRING> of matches per pattern, NULL where the gate is closed; ``gates`` names
        the column of ``gates``.

        ``(?d)``: only a newline ends a line, as '.' is understood by the rules.
        """
        return [
            f"case when {non_ascii_sql(p, text) or f'array_contains({gates}, {i})'} "
            f"then regexp_extract_all({text}, {quote('(?i)(?d)' + p)}, 0) end"
            for i, (p, _) in enumerate(self.patterns)
        ]

    def candidates(self, text: str, gates: str, normalize: bool = True) -> Column:
        """One candidate per match of every pattern, in rule order; ``gates`` as for ``match_texts``.

        Built as one SQL text: a rule set makes thousands of expression nodes, and building
        them one by one from Python costs more than the scan of a small table.
        """
        if not self.patterns:
            return F.array().cast(CANDIDATE)
        items = []
        for (pattern, rule), found in zip(self.patterns, self.match_texts(text, gates)):
            category = rule.category.replace("_", "-") if normalize else rule.category
            item = (
                f"named_struct('action', {quote(rule.action)}, 'category', {quote(category)}, "
                f"'signature_id', {quote(rule.id)}, 'detail', {quote('pattern:' + pattern)}, "
                f"'confidence', double({K.SIGNATURE_CONFIDENCE}))"
            )
            # NULL (gate closed) and 0 matches give no candidate.
            items.append(f"array_repeat({item}, coalesce(size({found}), 0))")
        return F.expr(f"flatten(array({', '.join(items)}))")


def action_rank(action: Column) -> Column:
    rank = F.lit(0)
    for name, value in sorted(K.ACTION_RANK.items(), key=lambda kv: kv[1]):
        rank = F.when(action == name, F.lit(value)).otherwise(rank)
    return rank


def _with_offsets(found: Column, gaps: Column) -> Column:
    """Attach code-point start and end: a match starts after all gaps and matches before it.
    Gaps and matches come from the same matcher, so anchors and lookaround count as they ran.

    The ends are running sums within the array, by doubling: in round j each sum takes in the one 2^j
    places before it. That is n log n steps for n matches; a fold that appends copies its array n times.
    """
    before = F.slice(gaps, 1, F.size(found))
    steps = F.zip_with(found, before, lambda match, gap: F.length(match) + F.length(gap))

    def double(sums: Column, j: Column) -> Column:
        back = F.pow(F.lit(2), j).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found))).cast("int"))
    ends = F.aggregate(rounds, steps, double)
    return F.zip_with(found, ends, lambda match, end: F.struct(
        match.alias("matched_text"), (end - F.length(match)).alias("start"), end.alias("end")))


def signature_hits(df: DataFrame, text: str, rules: RuleSet) -> DataFrame:
    """One row per non-overlapping match of every pattern, case-insensitive.

    Columns: those of ``df`` but the text, then signature_id, category, action, pattern,
    matched_text, start, end. The outer generators are on purpose: for a plain one Spark infers a filter
    on the array below it, which would match every pattern a second time.
    """
    keep = [c for c in df.columns if c != text]
    # Matches are staged in a select of their own: the gaps are asked for only where there are any.
    found = [F.expr(m).alias(f"_m{i}") for i, m in enumerate(rules.match_texts(text, "_gates"))]
    staged = df.withColumn("_gates", rules.gates(text)).select(*keep, text, *found)
    groups = [
        f"named_struct('signature_id', {quote(rule.id)}, 'category', {quote(rule.category)}, "
        f"'action', {quote(rule.action)}, 'pattern', {quote(pattern)}, 'found', _m{i}, "
        f"'gaps', case when size(_m{i}) > 0 then split({text}, {quote('(?i)(?d)' + pattern)}, -1) end)"
        for i, (pattern, rule) in enumerate(rules.patterns)
    ]
    return (
        staged.select(*keep, F.expr(
            f"inline_outer(filter(array({', '.join(groups)}), g -> size(g.found) > 0))"))
        .where("signature_id is not null")
        .select(*keep, "signature_id", "category", "action", "pattern",
                F.inline_outer(_with_offsets(F.col("found"), F.col("gaps"))))
    )


def best_signature(df: DataFrame, text: str, rules: RuleSet) -> DataFrame:
    """Highest action among the hits, the first rule on ties, category slug normalised."""
    from promptsieve.operators.fusion import best_of

    scanned = df.withColumn("_gates", rules.gates(text)).withColumn(
        "_regex", rules.candidates(text, "_gates")
    ).drop("_gates")
    return best_of(scanned, ["_regex"]).drop("details", "matches")

"""URL verdicts by rules, and by trust that flows over links between hosts, in DataFrame functions only.

Every URL is first judged by the rules: a rule (host, path) fits its host and all subdomains where
the URL's path starts with the rule's path; the longest rule wins. Pages that no rule fits are
judged by their host. Hosts are the nodes of a graph, and links of pages (``href`` and ``src`` that
name a host) are its edges, weighted by how many there are.

* Trust starts at hosts in proportion to their pages that rules allow, and flows along links
  (personalised PageRank): a host that trusted hosts link to is trusted.
* Distrust starts at hosts in proportion to their pages that rules block, and flows against the
  links: a host that links to distrusted hosts is distrusted.

A host is blocked where its distrust is above ``threshold`` percent of its trust. A host that neither
reaches has 0 and 0 and is allowed.

Both vectors are whole numbers of a UNIT that is shared out, so sums do not depend on their order. What
a host without links would pass on is lost, as is the remainder of a division. Every round joins the
arcs with the state, sums what arrives per host (partial sums come first, so a host that a third of
all pages link to is no hot spot) and writes the new state to the shared folder; hosts with many arcs
are split by Spark's skew join. It ends after ``rounds`` rounds, or earlier when nothing changes.

Nulls and ties: a NULL URL or one without ``://`` has an empty host and path; no rule fits and the
verdict is allow. NULL html has no links, and links from an empty host are not counted. Repeated rows
are judged one by one (and count again). Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import saved

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Shares of the whole, percent passed on along links, rounds, and percent of trust that distrust may reach.
UNIT = 10**15
PASSED = 85
ROUNDS = 20
THRESHOLD = 100
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#\s"'<>]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def located(pages: DataFrame, *extra: str) -> DataFrame:
    """page_id, host, path (and ``extra`` columns) of every row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.select("page_id", rest.alias("rest"), *extra).select(
        "page_id", lowered(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"), *extra)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (host, path) with ``rule`` (host and path, NULL for none) and ``rule_verdict``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links): how many links lead from one host to another."""
    targets = located(pages, "html").where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"))
    return targets.select("source", lowered("target").alias("target")).where("source <> target").groupBy(
        "source", "target").agg(F.count("*").alias("links"))


def seeds(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust): shares of UNIT by pages that rules allow or block."""
    counted = ruled(located(pages), rules).where("rule is not null").groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("trust"),
        F.count_if(F.col("rule_verdict") == "block").alias("distrust"))
    counted = saved(counted, "seeds")
    total = counted.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    return counted.select("host", *(_part(UNIT, name, F.lit(total[name] or 1)).alias(name) for name in ("trust", "distrust")))


def _part(amount, weight: str, whole: Column) -> Column:
    """amount * weight / whole, rounded down, without overflow."""
    product = F.lit(amount).cast("decimal(20,0)") * F.col(weight).cast("decimal(17,0)")
    return F.call_function("div", product, F.greatest(whole, F.lit(1)).cast("decimal(17,0)"))


def propagated(links: DataFrame, start: DataFrame, passed: int = PASSED, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after the flow over ``links`` from the seeds ``start``."""
    links = saved(links, "host-links")
    sent = links.groupBy("source").agg(F.sum("links").alias("whole"))
    received = links.groupBy("target").agg(F.sum("links").alias("whole"))
    arcs = saved(
        links.join(sent, "source").select(
            F.col("source").alias("host"), F.col("target").alias("to"), F.lit(True).alias("forward"), "links", "whole")
        .union(links.join(received, "target").select("target", "source", F.lit(False), "links", "whole")), "arcs")
    start = saved(start, "shares")
    state, known = start, None
    for _ in range(rounds):
        flow = _part(F.when(F.col("forward"), F.col("trust")).otherwise(F.col("distrust")), "links", F.col("whole"))
        none = F.lit(0).cast("long")
        arrived = arcs.join(state, "host").select(F.col("to").alias("host"), "forward", flow.alias("flow")).select(
            "host", none.alias("trust"), none.alias("distrust"),
            F.when(F.col("forward"), F.col("flow")).otherwise(none).alias("trust_in"),
            F.when(F.col("forward"), none).otherwise(F.col("flow")).alias("distrust_in"))
        rows = start.select("host", "trust", "distrust", none.alias("trust_in"), none.alias("distrust_in")).union(arrived)
        summed = rows.groupBy("host").agg(*(F.sum(c).alias(c) for c in rows.columns[1:]))
        state = saved(summed.selectExpr(
            "host", f"({100 - passed} * trust + {passed} * trust_in) div 100 as trust",
            f"({100 - passed} * distrust + {passed} * distrust_in) div 100 as distrust"), "state")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("host", "trust", "distrust").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    return state


def verdicts(pages: DataFrame, rules=RULES, passed: int = PASSED, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html)."""
    state = propagated(host_links(pages), seeds(pages, rules), passed, rounds)
    blocked = state.where(
        F.col("distrust").cast("decimal(20,0)") * 100 > F.col("trust").cast("decimal(20,0)") * threshold
    ).select("host", F.lit("block").alias("host_verdict"))
    return ruled(located(pages), rules).join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def check_sql() -> str:
    """The same in SQL: every round is a table of its own."""
    def first(column):
        fits = "\n".join(
            f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p) if column == 'rule' else say}'"
            for h, p, say in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
        return f"case {fits} end"

    lower = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"
    pattern = LINK.replace("'", "''")
    parts = [f"""
with rest as (
  select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), located as (
  select page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest
), ruled as (
  select page_id, host, path, {first('rule')} as rule, {first('verdict')} as rule_verdict from located
), targets as (
  select host as source, {lower.format("unnest(regexp_extract_all(html, '" + pattern + "', 1))")} as target from located where host <> ''
), links as materialized (
  select source, target, count(*) as links from targets where source <> target group by all
), counted as (
  select host, count(*) filter (rule_verdict = 'allow') as trust, count(*) filter (rule_verdict = 'block') as distrust
  from ruled where rule is not null group by host
), s0 as materialized (
  select host, {UNIT}::hugeint * trust // greatest((select sum(trust) from counted), 1) as trust,
         {UNIT}::hugeint * distrust // greatest((select sum(distrust) from counted), 1) as distrust from counted
), arcs as materialized (
  select source as host, target as dest, true as forward, links, sum(links) over (partition by source) as whole from links
  union all select target, source, false, links, sum(links) over (partition by target) from links
)"""]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""s{k} as materialized (
  select host, ({100 - PASSED} * sum(t) + {PASSED} * sum(ti)) // 100 as trust, ({100 - PASSED} * sum(d) + {PASSED} * sum(di)) // 100 as distrust
  from (select host, trust as t, distrust as d, 0 as ti, 0 as di from s0
        union all
        select dest, 0, 0, case when forward then trust::hugeint * links // whole else 0 end,
               case when forward then 0 else distrust::hugeint * links // whole end
        from arcs join s{k - 1} using (host))
  group by host
)""")
    return ",\n".join(parts) + f"""
select page_id, r.host, path, rule,
       coalesce(rule_verdict, case when 100 * distrust > {THRESHOLD} * trust then 'block' end, 'allow') as verdict
from ruled r left join s{ROUNDS} s on r.host = s.host
"""


SQL = check_sql()

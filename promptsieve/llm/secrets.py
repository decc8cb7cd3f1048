"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text (NULL is
empty). The ledger, a folder of Parquet tables, holds the versions (path, version, blob), the
scanned pairs (blob, rule, rule version) and the findings (blob, rule, rule version, spans). A
commit scans only pairs of blob and rule version that it has not seen, one text for each blob,
and a report joins the findings back to all paths that hold the blob, copies and old versions
included. A changed rule has a new version and is scanned again on all blobs that come again.

Matches are leftmost and non-overlapping. Their places come from the same matcher: ``split``
gives the gaps and ``regexp_extract_all`` the matches, so a start is the length of what lies
before, a running sum over a text's matches. Patterns run only on texts that hold one of their
words (``gate``), and never backtrack over a long run, so long texts cost as much per character
as short ones.

Copies are collapsed before texts are shuffled, and joins are by blob, where Spark splits what
is skewed. Repeated rows are reported one by one. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptsieve.session import local_table, shared_folder


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regex whose matches are all consumed; those whose group ``group``
    has fewer than ``least`` characters are dropped. ``gate`` is a cheap condition on ``text``
    that every match needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    gate: str = "true"
    version: str = "1"
    base: bool = True


KEYS = "(?i:password|passwd|secret|token|api_?key)"
RULES = (
    Rule("assign", rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "contains(text, '=') or contains(text, ':')"),
    Rule("access", "AKIA[A-Z0-9]++", 0, 20, "contains(text, 'AKIA')"),
    Rule("hex", "[0-9a-f]{24,}+", 0, 24),
    Rule("private_key", "-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----", gate="contains(text, '-----BEGIN ')", version="1.1", base=False),
    Rule("bearer", r"Bearer\x20++[A-Za-z0-9._~+/-]{20,}+=*", gate="contains(text, 'Bearer ')", base=False),
    # Begins only where no character of a scheme stands before: a long run of them is read once.
    Rule("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/@]++@",
         gate="contains(text, '://') and contains(text, '@')", version="1.1", base=False),
)
VERSIONS, SCANNED, FINDINGS = "versions", "scanned", "findings"


def _hits(rule: Rule) -> Column:
    """Matches of a rule, NULL where the gate is closed or the pair is known."""
    new = ~F.array_contains("done", f"{rule.kind}@{rule.version}")
    return F.when(new & F.expr(rule.gate), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))


def _lengths(rule: Rule, hits: Column) -> Column:
    """For each match the lengths of the gap before it, of itself and of the part that is judged. A
    pattern looks at nothing around a match that its group depends on, so it is read off the match."""
    judged = F.transform(hits, lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group) if rule.group else h))
    gaps = F.transform(F.slice(F.split("text", rule.pattern, -1), 1, F.size(hits)), F.length)
    return F.when(F.size(hits) > 0, F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("hit"), judged.alias("judged")))


def _spans(found: DataFrame, least: DataFrame) -> DataFrame:
    """(blob, kind, rule_version, spans) of rows (blob, kind, rule_version, lengths). A start is the sum
    of what lies before: a running sum over the matches of a blob and rule, already in one task."""
    each = found.select("blob", "kind", "rule_version", F.posexplode("lengths").alias("place", "of"))
    so_far = Window.partitionBy("blob", "kind", "rule_version").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("of.gap") + F.col("of.hit")).over(so_far).cast("int"))
    good = ends.join(least, ["kind", "rule_version"]).where("of.judged >= least")
    span = F.struct((F.col("end") - F.col("of.hit")).alias("start"), "end")
    return good.groupBy("blob", "kind", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


class Ledger:
    """Tables below ``path``, in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark, "ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return reader.parquet(f"{self.path}/{name}")

    def versions(self) -> DataFrame:
        return self._table(VERSIONS, "path long, version string, blob string")

    def scanned(self) -> DataFrame:
        return self._table(SCANNED, "blob string, kind string, rule_version string")

    def findings(self) -> DataFrame:
        return self._table(FINDINGS, "blob string, kind string, rule_version string, spans array<struct<start:int,end:int>>")

    def _append(self, df: DataFrame, name: str, commit: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{commit}")

    def commit(self, paths: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> None:
        """Record a version of ``paths`` (path, text) and scan what is new. The scanned pairs are
        written last, so a commit that fails is scanned again when it is repeated."""
        texts = paths.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        self._append(texts.select("path", F.lit(version).alias("version"), "blob"), VERSIONS, version)
        own = self.spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version string")
        blobs = self.versions().where(F.col("version") == version).select("blob").distinct()
        known = self.scanned().join(own, ["kind", "rule_version"], "left_semi")
        done = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "rule_version")).alias("done"))
        todo = blobs.join(done, "blob", "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
        one = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
        open_ = one.join(todo, "blob").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        matched = open_.select("blob", "text", *(_hits(r).alias(f"hits{k}") for k, r in enumerate(rules)))
        found = matched.select("blob", F.inline(F.filter(F.array(*(
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), _lengths(r, F.col(f"hits{k}")).alias("lengths"))
            for k, r in enumerate(rules))), lambda x: F.size(x["lengths"]) > 0)))
        least = local_table(self.spark, [(r.kind, r.version, r.least) for r in rules], "kind string, rule_version string, least int")
        rows = _spans(found, least)
        self._append(rows, FINDINGS, version)
        pairs = todo.select("blob", F.explode(F.array_except(
            F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules)), F.coalesce("done", F.array().cast("array<string>")))).alias("pair"))
        self._append(pairs.select("blob", F.split("pair", "@")[0].alias("kind"), F.split("pair", "@")[1].alias("rule_version")), SCANNED, version)

    def report(self, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """path, n_<kind> of the base kinds, base_spans, spans for every row of a version."""
        own = self.spark.createDataFrame([(r.kind, r.version, k, r.base) for k, r in enumerate(rules)], "kind string, rule_version string, place int, base boolean")
        by_blob = (
            self.findings().join(own, ["kind", "rule_version"])
            .select("blob", "base", F.explode("spans").alias("s"), "place", "kind")
            .select("blob", "base", F.struct("s.start", "place", "kind", "s.end").alias("span")).distinct()
            .groupBy("blob").agg(
                F.array_sort(F.collect_list("span")).alias("every"),
                F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"))
        )

        def joined(name):
            text = F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
            return F.coalesce(F.array_join(text, ","), F.lit(""))

        def count(kind):
            return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

        counts = [count(r.kind) for r in rules if r.base]
        facts = by_blob.select("blob", *counts, joined("base").alias("base_spans"), joined("every").alias("spans"))
        whole = self.versions().where(F.col("version") == version).join(facts, "blob", "left")
        return whole.select("path", *(F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules if r.base),
                            F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans of every row: one commit to a new ledger."""
    ledger = Ledger(docs.sparkSession)
    ledger.commit(docs.select(F.col("doc_id").cast("long").alias("path"), "text"), "1")
    return ledger.report("1").withColumnRenamed("path", "doc_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

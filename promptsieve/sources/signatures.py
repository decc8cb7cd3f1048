"""Signature sources: YAML rule files and bundles."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.operators.signatures import Rule, RuleSet
from promptsieve.session import local_table

SIGNATURE = (
    "id string, name string, category string, severity string, action string, "
    "scan_target string, patterns array<string>"
)
SECTION = r"(?m)^# === .+\.yaml ===\n?"
_FIELDS = ("id", "name", "category", "severity", "action", "scan_target", "patterns")


def _row(entry: dict) -> dict:
    patterns = entry.get("patterns") or ([entry["pattern"]] if "pattern" in entry else [])
    return {
        "id": str(entry["id"]), "name": entry["name"],
        "category": entry.get("category", "unknown"), "severity": entry["severity"],
        "action": entry["action"], "scan_target": entry.get("scan_target", "request"),
        "patterns": [str(p) for p in patterns],
    }


def parse_signatures(content: str) -> list[dict]:
    """Signature rows of a YAML text, one or several documents."""
    rows: list[dict] = []
    for document in yaml.safe_load_all(content):
        if isinstance(document, dict):
            rows += [_row(e) for e in document.get("signatures") or []]
    return rows


def default_rules() -> RuleSet:
    """The packaged rule set, also where the package is a zip archive, as on the executors."""
    content = resources.files(__package__).joinpath("default_rules.yaml").read_text(encoding="utf-8")
    return RuleSet(tuple(
        Rule(**{**row, "patterns": tuple(row["patterns"])}) for row in parse_signatures(content)
    ))


def rules_dataframe(spark: SparkSession, rules: RuleSet) -> DataFrame:
    data = [
        (i, r.id, r.name, r.category, r.severity, r.action, r.scan_target, list(r.patterns))
        for i, r in enumerate(rules.rules)
    ]
    return local_table(spark, data, f"ordinal int, {SIGNATURE}")


def _parse_batches(keys: list[str], skip_bad: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    parsed = parse_signatures(row["content"] or "")
                except yaml.YAMLError:
                    if not skip_bad:
                        raise
                    continue
                out += [
                    {**{k: row[k] for k in keys}, "pos": i, **sig} for i, sig in enumerate(parsed)
                ]
            yield pd.DataFrame(out, columns=[*keys, "pos", *_FIELDS])

    return parse


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of one YAML file or of all ``*.yaml`` / ``*.yml`` below a directory.

    Columns: ordinal, id, name, category, severity, action, scan_target, patterns, version.
    A missing path gives no rows. Files are ordered by name, entries as written.
    """
    if not _exists(spark, path):
        return local_table(spark, [], f"ordinal int, {SIGNATURE}, version string")
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{yaml,yml}").text(path, wholetext=True)
        .select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    )
    parsed = files.mapInPandas(
        _parse_batches(["file"], skip_bad=False), f"file string, pos int, {SIGNATURE}"
    )
    # One window over a rule set: configuration of bounded size, not data.
    numbered = parsed.selectExpr(
        "cast(row_number() over (order by file, pos) - 1 as int) as ordinal", *_FIELDS
    )
    return numbered.withColumn("version", F.lit(read_signature_version(path, spark)))


def _file(spark: SparkSession, path: str):
    """(file system, path) as Hadoop resolves it, whatever the default file system is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _file(spark, path)
    return system.exists(at)


def read_signature_version(path: str, spark: SparkSession | None = None) -> str:
    """Text of the ``.version`` file beside the rules, '' if there is none. A file that is
    there but cannot be read is an error."""
    spark = spark or SparkSession.active()
    version = f"{path.rstrip('/')}/.version"
    return read_text(spark, version).strip() if _exists(spark, version) else ""


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file on any file system that Hadoop knows."""
    system, at = _file(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_bundles(bundles: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Bundle rows (bundle_id, version, tier, content, is_encrypted) -> one row per bundle
    with its signatures and, from ``licenses`` (bundle_id, expires_at), its expiry.

    Content is cut at ``# === name.yaml ===`` lines, else read as a YAML stream; a section
    that is not YAML is skipped. Rows without a bundle id are dropped.
    """
    kept = bundles.where(F.coalesce("bundle_id", F.lit("")) != "")
    sections = kept.select("bundle_id", F.posexplode(F.split("content", SECTION)).alias("section", "content"))
    parsed = sections.where(F.trim("content") != "").mapInPandas(
        _parse_batches(["bundle_id", "section"], skip_bad=True),
        f"bundle_id string, section int, pos int, {SIGNATURE}",
    )
    # A bundle is one downloaded file; its signatures fit one row by construction.
    item = F.struct("section", "pos", F.struct(*_FIELDS).alias("signature"))
    grouped = parsed.groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.signature).alias("signatures")
    )
    empty = F.array().cast(grouped.schema["signatures"].dataType)
    joined = kept.join(grouped, "bundle_id", "left")
    if licenses is None:
        joined = joined.withColumn("expires_at", F.lit(None).cast("timestamp"))
    else:
        joined = joined.join(licenses.select("bundle_id", "expires_at"), "bundle_id", "left")
    return joined.select(
        "bundle_id", "version", F.coalesce("tier", F.lit("free")).alias("tier"), "expires_at",
        F.coalesce("is_encrypted", F.lit(False)).alias("is_encrypted"),
        F.coalesce("signatures", empty).alias("signatures"),
    )

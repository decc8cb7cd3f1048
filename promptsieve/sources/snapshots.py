"""Versioned snapshots of a policy, for streams that run while it changes.

A version is a set of tables (category_policy, allowlist, settings), written below the folder under
its number; a marker is written last, so a reader never sees half a version. ``PolicyInForce`` is
what a stream scans with: for every micro-batch it takes the newest version that is sound, and
keeps the last good one while the newest is broken. The last good version is marked in the folder
too, so a restarted stream goes on with it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.session import local_table
from promptsieve.sources.policy import SCHEMAS

TABLES = ("category_policy", "allowlist", "settings")
DEFAULT_ACTION = "policy.default_action"


@dataclass(frozen=True)
class Policy:
    """Tables of one version, and the action of categories that it does not name."""

    version: int
    category_policy: DataFrame
    allowlist: DataFrame
    default_action: str


class PolicySnapshots:
    """Versions below ``folder``, which all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _marks(self, kind: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def mark(self, kind: str, version: int) -> None:
        path = f"{self.folder}/{kind}/version={version}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True).close()

    def publish(self, version: int, tables: dict[str, DataFrame]) -> None:
        """Write a version; tables that are not given are empty."""
        for name in TABLES:
            table = tables[name] if name in tables else local_table(self.spark, [], SCHEMAS[name])
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        self.mark("published", version)

    def published(self) -> list[int]:
        return self._marks("published")

    def last_good(self) -> int | None:
        return max(self._marks("good"), default=None)

    def load(self, version: int) -> Policy:
        """A version, read and judged: ValueError if it is not sound."""
        tables = {name: self.spark.read.parquet(f"{self.folder}/{name}/version={version}") for name in TABLES}
        for name, table in tables.items():
            missing = {f.split()[0] for f in SCHEMAS[name].split(", ")} - set(table.columns)
            if missing:
                raise ValueError(f"{name} has no column {', '.join(sorted(missing))}")
        outside = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
        rules = tables["category_policy"]
        found = rules.agg(
            F.count_if(F.col("category").isNull()).alias("nameless categories"),
            F.count_if(~F.coalesce(F.col("action").isin(*K.ACTION_RANK), F.lit(False))).alias("unknown actions"),
            F.count_if(outside("threshold") | outside("sensitivity")).alias("thresholds outside 0 to 1"),
            (F.count("category") - F.count_distinct("category")).alias("repeated categories"),
        ).first().asDict()
        found["clients without an id"] = tables["allowlist"].where("client_id is null").count()
        actions = [r.value for r in tables["settings"].where(F.col("name") == DEFAULT_ACTION).collect()]
        found["unknown default actions"] = sum(a not in K.ACTION_RANK for a in actions)
        wrong = [f"{n} {what}" for what, n in found.items() if n]
        if wrong:
            raise ValueError("; ".join(wrong))
        # A policy is configuration: as local rows it is known to be small, and joins broadcast it by that.
        local = {name: local_table(self.spark, [tuple(r) for r in tables[name].select(*_columns(name)).collect()], SCHEMAS[name])
                 for name in ("category_policy", "allowlist")}
        return Policy(version, **local, default_action=actions[0] if actions else "block")


def _columns(name: str) -> list[str]:
    return [f.split()[0].strip("`") for f in SCHEMAS[name].split(", ")]


class PolicyInForce:
    """The policy for the next batch: the newest sound version, else the last good one."""

    def __init__(self, snapshots: PolicySnapshots):
        self.snapshots, self.policy, self._broken = snapshots, None, set()

    def refresh(self) -> Policy:
        good = self.snapshots.last_good()
        if self.policy is None and good is not None:
            self.policy = self.snapshots.load(good)
        now = self.policy.version if self.policy else -1
        for version in reversed([v for v in self.snapshots.published() if v > now and v not in self._broken]):
            try:
                self.policy = self.snapshots.load(version)
            except Exception as error:  # noqa: BLE001 - a bad version must not stop the stream
                self._broken.add(version)
                warnings.warn(f"policy {version} is not taken: {error}", stacklevel=2)
            else:
                self.snapshots.mark("good", version)
                break
        if self.policy is None:
            raise ValueError("no version of the policy is sound")
        return self.policy

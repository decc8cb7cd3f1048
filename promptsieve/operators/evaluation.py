"""Detection accuracy against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rates(by: tuple[str, ...]) -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    precision = F.try_divide(tp, tp + fp)
    return [
        *by, "tp", "fp", "tn", "fn", tpr.alias("tpr"), tnr.alias("tnr"),
        precision.alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((tpr + tnr) / 2).alias("balanced_score"),
    ]


def evaluate(
    df: DataFrame, label: str = "label", predicted: str = "predicted", by: tuple[str, ...] = (),
    latency: str | None = None,
) -> DataFrame:
    """Confusion counts, TPR, TNR, precision, F1, balanced score and, if given, the mean
    latency; from BOOLEAN label and prediction, in one conditional aggregate."""
    y, p = F.col(label), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
        *([F.avg(latency).alias("mean_latency")] if latency else []),
    )
    return counts.select(*_rates(by), *(["mean_latency"] if latency else []))


def detection_rate_by(df: DataFrame, category: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of rows detected per category; for a benign category the false-positive rate."""
    return df.groupBy(category).agg(
        F.count("*").alias("n"), F.count_if(predicted).alias("detected"),
        F.avg(F.col(predicted).cast("double")).alias("rate"))


def threshold_sweep(scans: DataFrame, thresholds: list[float], label: str = "label") -> DataFrame:
    """``evaluate`` per policy threshold, over scans with confidence and a BOOLEAN label.

    Each threshold adds four conditional counts to one aggregate: no row is copied per
    threshold.
    """
    y = F.col(label)
    counts = []
    for i, t in enumerate(thresholds):
        p = (F.col("action") != "allow") & (F.col("confidence") >= t)
        counts += [F.count_if(c).alias(f"{n}{i}") for n, c in
                   (("tp", y & p), ("fp", ~y & p), ("tn", ~y & ~p), ("fn", y & ~p))]
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")])
        for i, t in enumerate(thresholds)
    ])
    return scans.agg(*counts).select(F.inline(rows)).select(*_rates(("threshold",)))


def compare_versions(results: DataFrame) -> DataFrame:
    """Change of the rates from version to version; NULL where the class mix differs, since
    such results do not compare. results: version_order, version, tp, fp, tn, fn, tpr, tnr,
    balanced_score. One row per version, so the unpartitioned window is small."""
    w = Window.orderBy("version_order")
    mix = F.struct((F.col("tp") + F.col("fn")).alias("attacks"), (F.col("tn") + F.col("fp")).alias("benign"))
    same = F.col("_mix") == F.lag("_mix").over(w)
    change = {
        f"{c}_change": F.when(same, F.col(c) - F.lag(c).over(w)) for c in ("tpr", "tnr", "balanced_score")
    }
    return (
        results.withColumn("_mix", mix)
        .withColumns({**change, "comparable": F.coalesce(same, F.lit(False))}).drop("_mix")
    )

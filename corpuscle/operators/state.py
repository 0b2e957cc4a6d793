"""Merging scans into issue state, and the history of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def suspects(existing: DataFrame, current: DataFrame, least: int = 3) -> DataFrame:
    """(detector, was): detectors with at least so many open issues of which the scan now has none."""
    had = existing.where("status = 'open'").groupBy("detector").agg(F.count("*").alias("was")).where(F.col("was") >= least)
    return had.join(current.select("detector").distinct(), "detector", "left_anti")


def merge_scan(existing: DataFrame, current: DataFrame, eligible: Column, least: int = 3) -> DataFrame:
    """(id, detector, action, status, reopen_count) after a scan.

    existing: id, detector, file, status, reopen_count; current: id, detector, file.
    New ids open; fixed ones that come back reopen. Open, set-aside, fixed and false
    positive ones that are gone are resolved, whether the scan covered their file or
    not, unless their detector is suspect or eligible is not true of the existing row
    (another language, an excluded path). Everything else stays as it was. Ids that
    repeat in current count once. One full outer join.
    """
    doubt = suspects(existing, current, least).select("detector", F.lit(True).alias("doubt"))
    old = existing.withColumn("scoped", F.coalesce(eligible, F.lit(False))).join(doubt, "detector", "left").select(F.col("id").alias("o_id"), F.col("detector").alias("o_detector"), "status", "reopen_count", "scoped", F.coalesce("doubt", F.lit(False)).alias("doubt"))
    both = old.join(current.select("id", "detector").distinct(), F.col("o_id") == F.col("id"), "full_outer")
    back = F.col("status").isin("fixed", "auto_resolved")
    gone = F.col("id").isNull()
    action = F.when(F.col("o_id").isNull(), "new").when(~gone & back, "reopened").when(~gone, "seen").when(F.col("status").isin("open", "wontfix", "fixed", "false_positive") & ~F.col("doubt") & F.col("scoped"), "resolved").otherwise("kept")
    out = both.withColumn("action", action)
    status = F.when(F.col("action").isin("new", "reopened"), "open").when(F.col("action") == "resolved", "auto_resolved").otherwise(F.col("status"))
    return out.select(F.coalesce("id", "o_id").alias("id"), F.coalesce("detector", "o_detector").alias("detector"), "action", status.alias("new_status"), (F.coalesce("reopen_count", F.lit(0)) + F.when(F.col("action") == "reopened", 1).otherwise(0)).cast("long").alias("reopen_count"))


def reopeners(appearances: DataFrame, least: int = 2) -> DataFrame:
    """(key, reopened): how often a key comes back after a scan without it; appearances: key, scan."""
    before = F.lag("scan").over(W.partitionBy("key").orderBy("scan"))
    gaps = appearances.select("key", "scan").distinct().withColumn("before", before)
    return gaps.groupBy("key").agg(F.count_if(F.col("scan") > F.col("before") + 1).alias("reopened")).where(F.col("reopened") >= least)


def phases(history: DataFrame) -> DataFrame:
    """history (scan, score) with the phase of each scan.

    In this order: first_scan; regression, a fall of more than 0.5; stagnation, three
    scans within 0.5; early_momentum, one of the first five scans above the very first;
    maintenance above 93; refinement above 80; middle_grind. History is one row a scan
    of a project and is ordered in one task. A null score compares with nothing.
    """
    w = W.orderBy("scan")
    n, b1, b2 = F.row_number().over(w), F.lag("score", 1).over(w), F.lag("score", 2).over(w)
    flat = (F.greatest("score", b1, b2) - F.least("score", b1, b2)) <= 0.5
    early = (n <= 5) & (F.col("score") > F.first("score").over(w))
    phase = F.when(n == 1, "first_scan").when(F.col("score") < b1 - 0.5, "regression").when((n >= 3) & flat, "stagnation").when(early, "early_momentum")
    return history.withColumn("phase", phase.when(F.col("score") > 93, "maintenance").when(F.col("score") > 80, "refinement").otherwise("middle_grind"))


def trend(history: DataFrame, last: int = 5, still: float = 0.5) -> DataFrame:
    """history (scan, gap) with the trend of the gap over the last scans: growing, shrinking or stable."""
    first = F.first("gap").over(W.orderBy("scan").rowsBetween(1 - last, 0))
    return history.withColumn("trend", F.when(F.col("gap") - first > still, "growing").when(first - F.col("gap") > still, "shrinking").otherwise("stable"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, start, length): stretches of equal values in order, gaps and islands."""
    w = W.partitionBy(key).orderBy(order)
    change = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    island = change.withColumn("_run", F.sum("_new").over(w))
    return island.groupBy(key, "_run", value).agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_run")


def overwritten(writes: DataFrame) -> DataFrame:
    """Rows (scope, seq, kind) that are writes directly followed by another write of the scope, unread."""
    nxt = F.lead("kind").over(W.partitionBy("scope").orderBy("seq"))
    return writes.withColumn("next_kind", nxt).where("kind = 'write' and next_kind = 'write'").drop("next_kind")

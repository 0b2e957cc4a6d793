"""Budgets, work queues and clusters of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}


def confidence_rank(confidence: Column) -> Column:
    """0 for high to 2 for low, 9 for unknown ones; a missing one counts as low."""
    out = F.when(confidence.isNull(), 2).otherwise(F.lit(9))
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def capped(issues: DataFrame, most: int) -> DataFrame:
    """The first issues of each detector by tier, confidence and id, with their place; 0 keeps all.

    Spark cuts each partition to most rows a group before the shuffle.
    """
    place = F.row_number().over(W.partitionBy("detector").orderBy("tier", confidence_rank(F.col("confidence")), "id"))
    out = issues.withColumn("place", place)
    return out.where(F.col("place") <= most) if most else out


def round_robin(shown: DataFrame, budget: int) -> DataFrame:
    """The issues of capped() taken in turn from the detectors until the budget is used; 0 keeps all.

    In each turn the detectors come in the order of their first issue: tier, confidence,
    id, then name. The first issues are one row a detector.
    """
    if not budget:
        return shown
    first = shown.where("place = 1").select(F.col("detector").alias("turn"), F.struct(F.col("tier"), confidence_rank(F.col("confidence")), F.col("id"), F.col("detector")).alias("ahead"))
    return shown.join(first, F.col("detector") == F.col("turn")).orderBy("place", "ahead").limit(budget).drop("turn", "ahead")


def hidden(issues: DataFrame, shown: DataFrame) -> DataFrame:
    """(detector, hidden): issues that a budget keeps back."""
    n = issues.groupBy("detector").agg(F.count("*").alias("n")).join(shown.groupBy("detector").agg(F.count("*").alias("m")), "detector", "left")
    return n.select("detector", (F.col("n") - F.coalesce("m", F.lit(0))).alias("hidden"))


def ranked(issues: DataFrame, impact: Column, top: int) -> DataFrame:
    """The work queue: the top issues by impact, then confidence and id, with their position."""
    best = issues.withColumn("impact", impact).orderBy(F.col("impact").desc(), confidence_rank(F.col("confidence")), "id").limit(top)
    return best.withColumn("position", F.row_number().over(W.orderBy(F.col("impact").desc(), confidence_rank(F.col("confidence")), "id")))


def clusters(issues: DataFrame, keys: tuple[str, ...], least: int = 2) -> DataFrame:
    """Open issues grouped by keys, groups of at least so many, with size and first id."""
    return issues.where("status = 'open'").groupBy(*keys).agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= least)


def profiles(issues: DataFrame, least_detectors: int = 2, least_files: int = 3) -> DataFrame:
    """(detectors, files): sets of detectors that meet in many files."""
    sets = issues.where("status = 'open'").groupBy("file").agg(F.array_sort(F.collect_set("detector")).alias("d")).where(F.size("d") >= least_detectors)
    return sets.groupBy(F.array_join("d", ",").alias("detectors")).agg(F.count("*").alias("files")).where(F.col("files") >= least_files)


def systemic(issues: DataFrame, least_files: int = 5) -> DataFrame:
    """(detector, tier, files): kinds of issue open in many files."""
    return issues.where("status = 'open'").groupBy("detector", "tier").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= least_files)

"""From issues to detector, dimension and health scores in three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.scalar import confidence_tenths
from corpuscle.operators.zones import UNSCORED

MODES = {"lenient": ("open",), "strict": ("open", "wontfix"), "verified_strict": ("open", "wontfix", "fixed", "false_positive")}
CAPS = ((6, 20), (3, 15), (1, 10))
ENOUGH, MECHANICAL, HOLISTIC = 200, 0.4, 10


def failing(issues: DataFrame) -> DataFrame:
    """One row for each issue and mode in which it fails: adds mode and tenths, its weight times ten.

    Issues of unscored zones and suppressed ones (a true column suppressed, where there
    is one) are left out; a null zone is production; a null status fails in no mode.
    """
    scored = issues.where(~F.coalesce(F.col("zone"), F.lit("production")).isin(*UNSCORED))
    if "suppressed" in issues.columns:
        scored = scored.where(~F.coalesce(F.col("suppressed"), F.lit(False)))
    modes = F.array(*[F.struct(F.lit(m).alias("m"), F.col("status").isin(*s).alias("f")) for m, s in MODES.items()])
    hit = F.transform(F.filter(modes, lambda x: x["f"]), lambda x: x["m"])
    return scored.withColumn("mode", F.explode(hit)).withColumn("tenths", confidence_tenths(F.col("confidence")))


def detector_stats(issues: DataFrame) -> DataFrame:
    """(detector, mode, failures, tenths): plain weighted failures."""
    return failing(issues).groupBy("detector", "mode").agg(F.count("*").alias("failures"), F.sum("tenths").alias("tenths"))


def _cap(n: Column) -> Column:
    out = F.lit(0)
    for least, cap in reversed(CAPS):
        out = F.when(n >= least, cap).otherwise(out)
    return out


def capped_stats(issues: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """As detector_stats(), each file's weight capped by how many issues it has: two levels of aggregation.

    Holistic issues (file "." and a true column holistic, where there is one) are of no
    file: each counts HOLISTIC times its weight, uncapped.
    """
    failed = failing(issues)
    whole = (F.col("file") == ".") & F.coalesce(F.col("holistic"), F.lit(False)) if "holistic" in issues.columns else F.lit(False)
    by_file = failed.groupBy("detector", "mode", whole.alias("whole_corpus"), *keys).agg(F.count("*").alias("n"), F.sum("tenths").alias("w"))
    capped = by_file.withColumn("w", F.when(F.col("whole_corpus"), F.col("w") * HOLISTIC).otherwise(F.least("w", _cap(F.col("n")))))
    return capped.groupBy("detector", "mode").agg(F.sum("n").alias("failures"), F.sum("w").alias("tenths"), F.count_if(~F.col("whole_corpus")).alias("files"))


def loc_weighted(issues: DataFrame, weight: str, order: str = "id") -> DataFrame:
    """(detector, mode, weighted): a file's issues weigh their sum, but no more than its first issue by order."""
    by_file = failing(issues).groupBy("detector", "mode", "file").agg(F.sum(weight).alias("w"), F.min_by(weight, order).alias("first_w"))
    return by_file.groupBy("detector", "mode").agg(F.sum(F.least("w", "first_w")).alias("weighted"))


def pass_rate(checks: Column, tenths: Column) -> Column:
    """1 for nothing to check; never below 0."""
    return F.when(checks <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), (checks * 10 - tenths) / (checks * 10)))


def detector_scores(stats: DataFrame, potentials: DataFrame) -> DataFrame:
    """stats with checks and the share that passes, rounded to six digits; detectors without issues pass."""
    modes = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    every = potentials.groupBy("detector").agg(F.sum("potential").alias("checks")).select("detector", "checks", modes)
    out = every.join(stats, ["detector", "mode"], "left").fillna(0, ["failures", "tenths"])
    return out.withColumn("pass_rate", F.round(pass_rate(F.col("checks"), F.col("tenths")), 6))


def dimension_scores(scores: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(dimension, mode, checks, failures, score) of detectors joined to dimension(detector, dimension)."""
    sums = scores.join(F.broadcast(dimensions), "detector").groupBy("dimension", "mode").agg(F.sum("checks").alias("checks"), F.sum("tenths").alias("tenths"), F.sum("failures").alias("failures"))
    return sums.withColumn("score", F.round(100 * pass_rate(F.col("checks"), F.col("tenths")), 1))


def health(dimensions: DataFrame, weights: DataFrame) -> DataFrame:
    """(mode, health): mean of dimension scores by weight, damped where checks are few; 60 % from subjective ones if any.

    weights: (dimension, weight, subjective).
    """
    w = dimensions.join(F.broadcast(weights), "dimension").withColumn("w", F.col("weight") * F.when(F.col("subjective"), 1.0).otherwise(F.least(F.lit(1.0), F.col("checks") / ENOUGH)))

    def mean(of: Column) -> Column:
        return F.sum(F.when(of, F.col("score") * F.col("w"))) / F.sum(F.when(of, F.col("w")))

    pools = w.groupBy("mode").agg(mean(~F.col("subjective")).alias("m"), mean(F.col("subjective")).alias("s"))
    both = F.when(F.col("m").isNull(), F.col("s")).when(F.col("s").isNull(), F.col("m")).otherwise(MECHANICAL * F.col("m") + (1 - MECHANICAL) * F.col("s"))
    return pools.select("mode", F.round(F.coalesce(both, F.lit(100.0)), 4).alias("health"))


def impact(scores: DataFrame, fixed: int = 1) -> DataFrame:
    """What a detector's score gains by so many fewer failures of mean weight."""
    mean = F.col("tenths") / F.nullif("failures", F.lit(0))
    after = pass_rate(F.col("checks"), F.greatest(F.col("tenths") - mean * fixed, F.lit(0.0)))
    return scores.withColumn("gain", F.round(100 * (F.coalesce(after, F.col("pass_rate")) - pass_rate(F.col("checks"), F.col("tenths"))), 4))


def reset_near_target(assessments: DataFrame, target: float, tolerance: float = 0.05, least: int = 2) -> DataFrame:
    """Assessments (dimension, score); where at least two sit on the target, those are reset to 0 and flagged."""
    on = F.round(F.abs(F.col("score") - target), 6) <= tolerance
    total = assessments.agg(F.count_if(on).alias("_on"))
    return assessments.crossJoin(F.broadcast(total)).withColumn("reset", on & (F.col("_on") >= least)).withColumn("score", F.when(F.col("reset"), 0.0).otherwise(F.col("score"))).drop("_on")

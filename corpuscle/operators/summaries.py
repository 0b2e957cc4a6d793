"""Aggregates over issues, actions and the history of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values
STRUCTURAL = ("large", "complexity", "gods", "concerns")


def merged_detector(detector: Column) -> Column:
    """The detector, with the structural ones under one name; unknown for null."""
    return F.when(detector.isin(*STRUCTURAL), "structural").otherwise(F.coalesce(detector, F.lit("unknown")))


def open_by_detector(issues: DataFrame) -> DataFrame:
    """(detector, n): open issues that are not suppressed, by merged_detector(). Repeated rows count; none for an empty table."""
    return issues.where("status = 'open' and not coalesce(suppressed, false)").groupBy(merged_detector(F.col("detector")).alias("detector")).agg(F.count("*").alias("n"))


def false_positive_rates(issues: DataFrame, least: int = 5) -> DataFrame:
    """(detector, zone, total, rate) of groups of at least so many issues with a false positive; a null zone is production."""
    groups = issues.groupBy(merged_detector(F.col("detector")).alias("detector"), F.coalesce("zone", F.lit("production")).alias("zone"))
    counts = groups.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "false_positive").alias("fp")).where((F.col("total") >= least) & (F.col("fp") > 0))
    return counts.select("detector", "zone", "total", (F.col("fp") / F.col("total")).alias("rate"))


def signal_density(issues: DataFrame, top: int = 20) -> DataFrame:
    """(file, detector_count, issue_count, detectors): the files of most detectors, two at least; ties by issues, then by file."""
    by_file = issues.where("detector is not null and detector != ''").groupBy("file").agg(F.count("*").alias("issue_count"), F.array_sort(F.collect_set("detector")).alias("d"))
    many = by_file.where(F.size("d") >= 2).select("file", F.size("d").cast("long").alias("detector_count"), "issue_count", F.array_join("d", ",").alias("detectors"))
    return many.orderBy(F.desc("detector_count"), F.desc("issue_count"), "file").limit(top)


def hotspots(files: DataFrame, top: int = 20) -> DataFrame:
    """(file, score): files (file, loc, complexity, components, monsters) of the highest score; nulls count as 0, ties by file."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("loc", "complexity", "components", "monsters")}
    score = zero["loc"] / 100 + zero["complexity"] + 3 * zero["components"] + 10 * zero["monsters"]
    return files.select("file", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "file").limit(top)


def structural(signals: DataFrame, complexity_least: int = 35, many: int = 3) -> DataFrame:
    """(file, signals, tier, confidence) of signals (file, kind, score): three and more make tier 4.

    A file with nothing but complexity signals needs a score of complexity_least.
    Equal signals of a file count once; a null score is 0.
    """
    by_file = signals.groupBy("file").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max(F.coalesce("score", F.lit(0))).alias("best"), F.bool_and(F.col("kind") == "complexity").alias("only"))
    kept = by_file.where(~F.col("only") | (F.col("best") >= complexity_least))
    big = F.size("kinds") >= many
    return kept.select("file", F.array_join("kinds", " / ").alias("signals"), F.when(big, 4).otherwise(3).alias("tier"), F.when(big, "high").otherwise("medium").alias("confidence"))


def signature_variance(functions: DataFrame, least_files: int = 3) -> DataFrame:
    """(name, files, shapes) of functions (name, file, params, returns) found in so many files with differing signatures."""
    shape = F.struct("params", "returns")
    return functions.groupBy("name").agg(F.countDistinct("file").alias("files"), F.countDistinct(shape).alias("shapes")).where((F.col("files") >= least_files) & (F.col("shapes") > 1))


def duplicate_constants(constants: DataFrame, least_files: int = 2) -> DataFrame:
    """(name, value, files) of constants (name, value, file) that several files define alike; null values never match."""
    return constants.where("name is not null and value is not null").groupBy("name", "value").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= least_files)


def unused_names(defined: DataFrame, imported: DataFrame) -> DataFrame:
    """defined (file, name) that no other file's import (file, name) names."""
    used = imported.select(F.col("file").alias("importer"), F.col("name").alias("used")).distinct()
    return defined.join(used, (F.col("name") == F.col("used")) & (F.col("file") != F.col("importer")), "left_anti")


def suppression(history: DataFrame, window: int = 5) -> DataFrame:
    """One row: last_ignored, last_raw, recent_scans, recent_ignored, recent_raw, recent_pct over the last scans (scan, ignored, raw); none without scans. Nulls are 0."""
    last = history.orderBy(F.desc("scan")).limit(max(1, window))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("ignored", "raw")}
    sums = last.agg(F.max_by(zero["ignored"], "scan").alias("last_ignored"), F.max_by(zero["raw"], "scan").alias("last_raw"), F.count("*").alias("recent_scans"), F.sum(zero["ignored"]).alias("recent_ignored"), F.sum(zero["raw"]).alias("recent_raw"))
    pct = F.when(F.col("recent_raw") > 0, F.least(F.lit(100.0), 100 * F.col("recent_ignored") / F.col("recent_raw"))).otherwise(0.0)
    return sums.where("recent_scans > 0").withColumn("recent_pct", F.round(pct, 1))


def retained(history: DataFrame, most: int = 20) -> DataFrame:
    """The last rows of history by scan; all if there are no more."""
    return history.orderBy(F.desc("scan")).limit(most)


def milestones(history: DataFrame, marks: tuple[int, ...] = (90, 80)) -> DataFrame:
    """history (scan, score) with the highest mark that a scan's score crosses upwards against the scan before; rows without one are left out."""
    before = F.lag("score").over(W.orderBy("scan"))
    crossed = F.coalesce(*[F.when((before < m) & (F.col("score") >= m), m) for m in marks])
    return history.withColumn("crossed", crossed).where("crossed is not null")


def decayed(reminders: DataFrame, shown: DataFrame, most: int = 3) -> DataFrame:
    """reminders (kind, keep) that were shown (kind, n) fewer than most times, or are kept always."""
    counts = shown.groupBy(F.col("kind").alias("shown_kind")).agg(F.sum("n").alias("shown_n"))
    joined = reminders.join(counts, F.col("kind") == F.col("shown_kind"), "left")
    return joined.where(F.coalesce("keep", F.lit(False)) | (F.coalesce("shown_n", F.lit(0)) < most)).drop("shown_kind", "shown_n")


def carried(before: DataFrame, now: DataFrame) -> DataFrame:
    """(dimension, score, carried): all of now and what before has of dimensions that now lacks."""
    old = before.join(now.select("dimension"), "dimension", "left_anti").select("dimension", "score", F.lit(True).alias("carried"))
    return now.select("dimension", "score", F.lit(False).alias("carried")).unionByName(old)


def lanes(actions: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, actions, issues, files): actions (kind, detector, n) by kind, with the distinct files (detector, file) they touch."""
    touched = actions.select("kind", "detector").distinct().join(files.select("detector", "file").distinct(), "detector").groupBy("kind").agg(F.countDistinct("file").alias("files"))
    sums = actions.groupBy("kind").agg(F.count("*").alias("actions"), F.sum("n").alias("issues"))
    return sums.join(touched, "kind", "left").select("kind", "actions", "issues", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def leverage(by_detector: DataFrame, fixable: DataFrame) -> DataFrame:
    """One row (total, fixable, share) of counts (detector, n) and the detectors with a fixer; share is 0 of nothing."""
    marked = by_detector.join(fixable.select("detector").distinct().withColumn("has", F.lit(True)), "detector", "left")
    sums = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("has"), F.col("n"))), F.lit(0)).alias("fixable"))
    return sums.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("fixable") / F.col("total"), 4)).otherwise(0.0))


def stale_wontfix(before: DataFrame, now: DataFrame, scan: int, decay: int = 20, loc_growth: int = 50, complexity_growth: int = 10) -> DataFrame:
    """(id, reasons): issues set aside that the scan still finds, too long ago or grown since.

    before: id, detector, since, loc, complexity of the time; now: id, loc, complexity.
    Growth counts for structural issues only; a null measure has not grown.
    """
    both = before.join(now.select("id", F.col("loc").alias("now_loc"), F.col("complexity").alias("now_complexity")), "id")
    old = scan - F.col("since") >= decay if decay > 0 else F.lit(False)
    grown = (F.col("detector") == "structural") & (F.coalesce(F.col("now_loc") - F.col("loc") >= loc_growth, F.lit(False)) | F.coalesce(F.col("now_complexity") - F.col("complexity") >= complexity_growth, F.lit(False)))
    reasons = F.array_compact(F.array(F.when(old, "scan_decay"), F.when(grown, "severity_drift")))
    return both.select("id", F.array_join(reasons, ",").alias("reasons")).where("reasons != ''")


def successors(gone: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, candidate): open issues of the detector and file of an issue (id, detector, file) that has gone, other than itself."""
    open_ones = issues.where("status = 'open'").select(F.col("id").alias("candidate"), F.col("detector").alias("its"), F.col("file").alias("at"))
    return gone.join(open_ones, (F.col("detector") == F.col("its")) & (F.col("file") == F.col("at")) & (F.col("id") != F.col("candidate"))).select("id", "candidate")


def snapshot_hash(issues: DataFrame, detector: str = "review") -> DataFrame:
    """One row (n, hash): the SHA-256 of the sorted ids of a detector's open issues, joined by |.

    The ids are sorted in one value, so this is for a detector whose open issues a person reads.
    """
    ids = issues.where((F.col("status") == "open") & (F.col("detector") == detector)).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return ids.select(F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", "|").cast("binary"), 256).alias("hash"))


def new_since(ids: DataFrame, triaged: DataFrame) -> DataFrame:
    """Distinct ids that were not triaged."""
    return ids.select("id").distinct().join(triaged.select("id"), "id", "left_anti")


def under_target(scored: DataFrame, stale: DataFrame, unscored: DataFrame, target: float) -> DataFrame:
    """Ids (id, score) below the target that are neither stale nor unscored; a null score is not below."""
    return scored.where(F.col("score") < target).select("id").distinct().join(stale.select("id"), "id", "left_anti").join(unscored.select("id"), "id", "left_anti")


def coverage_confidence(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """(dimension, confidence): the least confidence of a dimension's detectors; scores: dimension, detector; coverage: detector, confidence. Without coverage 1."""
    known = coverage.groupBy("detector").agg(F.min("confidence").alias("confidence"))
    return scores.join(known, "detector", "left").groupBy("dimension").agg(F.min(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


def score_bundle(health: DataFrame) -> DataFrame:
    """One row (overall, strict, verified) from the health of each mode; a missing mode is null."""
    def of(mode: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col("health")))

    return health.agg(of("lenient").alias("overall"), of("strict").alias("strict"), of("verified_strict").alias("verified"))

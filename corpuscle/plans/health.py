"""Queries over issues: scores, state, budgets and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import queue, scoring, state
from corpuscle.operators.zones import drop_by_policy
from corpuscle.plans.inputs import FAILING, ISSUES, issues
from corpuscle.plans.registry import query
from corpuscle.util import table

POLICY = (("test", "click"), ("vendor", "error"), ("vendor", "view"))
DIMENSIONS = (("click", "file health"), ("view", "file health"), ("error", "code quality"), ("purchase", "security"), ("signup", "test health"))
WEIGHTS = (("file health", 2.0), ("code quality", 1.0), ("security", 1.0), ("test health", 1.0))
PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in DIMENSIONS)
CAPPED = FAILING + ", by_file AS (SELECT detector, mode, file, day, count(*) AS n, sum(tenths) AS w FROM failing GROUP BY ALL), stats AS (SELECT detector, mode, CAST(sum(n) AS BIGINT) AS failures, CAST(sum(least(w, CASE WHEN n >= 6 THEN 20 WHEN n >= 3 THEN 15 ELSE 10 END)) AS BIGINT) AS tenths, count(*) AS files FROM by_file GROUP BY 1, 2)"
SCORED = CAPPED + ", checks AS (SELECT detector, CAST(count(*) AS BIGINT) AS checks FROM issues GROUP BY 1)"
BY_DIMENSION = SCORED + f", dims(detector, dimension) AS (VALUES {PAIRS}), dim AS (SELECT dimension, mode, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(tenths) AS BIGINT) AS tenths FROM checks JOIN stats USING (detector) JOIN dims USING (detector) GROUP BY 1, 2), scored AS (SELECT dimension, mode, checks, failures, round(100 * greatest(0.0, (checks * 10 - tenths) / (checks * 10)), 1) AS score FROM dim)"


def potentials(rows):
    return rows.groupBy("detector").agg(F.count("*").alias("potential"))


def capped(rows):
    return scoring.capped_stats(rows, ("file", "day"))


@query("q05_zone_counts", f"WITH {ISSUES} SELECT zone, count(DISTINCT file) AS files, count(*) AS n FROM issues GROUP BY 1")
def zone_counts(spark, d):
    return issues(spark, d).groupBy("zone").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))


@query("q06_zone_policy_filter", f"WITH {ISSUES}, p(zone, detector) AS (VALUES {', '.join(map(str, POLICY))}) SELECT zone, detector, count(*) AS n FROM issues ANTI JOIN p USING (zone, detector) GROUP BY 1, 2")
def zone_policy_filter(spark, d):
    policy = spark.createDataFrame(POLICY, "zone string, detector string")
    return drop_by_policy(issues(spark, d), policy).groupBy("zone", "detector").agg(F.count("*").alias("n"))


@query("q24_detector_stats", f"WITH {FAILING} SELECT detector, mode, count(*) AS failures, CAST(sum(tenths) AS BIGINT) AS tenths FROM failing GROUP BY 1, 2")
def detector_stats(spark, d):
    return scoring.detector_stats(issues(spark, d)).withColumn("tenths", F.col("tenths").cast("long"))


@query("q25_file_capped_scores", f"WITH {SCORED} SELECT detector, mode, checks, failures, tenths, files, round(greatest(0.0, (checks * 10 - tenths) / (checks * 10)), 6) AS pass_rate FROM checks JOIN stats USING (detector)")
def file_capped_scores(spark, d):
    rows = issues(spark, d)
    return scoring.detector_scores(capped(rows), potentials(rows)).select("detector", "mode", "checks", "failures", F.col("tenths").cast("long").alias("tenths"), "files", "pass_rate")


def dimensions(spark, d):
    rows = issues(spark, d)
    scores = scoring.detector_scores(capped(rows), potentials(rows))
    return scoring.dimension_scores(scores, spark.createDataFrame(DIMENSIONS, "detector string, dimension string"))


@query("q26_dimension_scores", f"WITH {BY_DIMENSION} SELECT dimension, mode, checks, failures, score FROM scored")
def dimension_scores(spark, d):
    return dimensions(spark, d).select("dimension", "mode", "checks", "failures", "score")


@query("q27_health", f"WITH {BY_DIMENSION}, ws(dimension, weight) AS (VALUES {', '.join(map(str, WEIGHTS))}) SELECT mode, round(sum(score * weight * least(1.0, checks / 200)) / sum(weight * least(1.0, checks / 200)), 4) AS health FROM scored JOIN ws USING (dimension) GROUP BY 1")
def health(spark, d):
    weights = spark.createDataFrame([(*w, False) for w in WEIGHTS], "dimension string, weight double, subjective boolean")
    return scoring.health(dimensions(spark, d), weights)


@query("q28_score_impact", f"WITH {SCORED} SELECT detector, mode, round(100 * (greatest(0.0, (checks * 10 - greatest(tenths - tenths / failures, 0)) / (checks * 10)) - greatest(0.0, (checks * 10 - tenths) / (checks * 10))), 4) AS gain FROM checks JOIN stats USING (detector)")
def score_impact(spark, d):
    rows = issues(spark, d)
    scores = scoring.detector_scores(capped(rows), potentials(rows))
    mean = scores.withColumn("tenths", F.col("tenths").cast("double"))
    gained = scoring.impact(mean.withColumn("tenths", F.col("tenths")))
    return gained.select("detector", "mode", "gain")


@query("q29_status_tier_rollup", f"WITH {ISSUES} SELECT coalesce(CAST(tier AS VARCHAR), 'all') AS tier, coalesce(status, 'all') AS status, count(*) AS n FROM issues GROUP BY GROUPING SETS ((tier, status), (tier), ())")
def status_tier_rollup(spark, d):
    n = issues(spark, d).rollup("tier", "status").agg(F.count("*").alias("n"))
    return n.select(F.coalesce(F.col("tier").cast("string"), F.lit("all")).alias("tier"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("q30_open_scope", f"WITH {ISSUES} SELECT starts_with(file, 'area1/') AS in_scope, count(*) AS n FROM issues WHERE status = 'open' GROUP BY 1")
def open_scope(spark, d):
    return issues(spark, d).where("status = 'open'").groupBy(F.startswith("file", F.lit("area1/")).alias("in_scope")).agg(F.count("*").alias("n"))


@query("q31_ignore_patterns", f"WITH {ISSUES}, p(pattern) AS (VALUES ('click::%'), ('area2/tests/%'), ('%::u3::%')) SELECT pattern, count(*) AS n FROM issues JOIN p ON CASE WHEN contains(pattern, '::') THEN id ELSE file END LIKE pattern GROUP BY 1")
def ignore_patterns(spark, d):
    patterns = spark.createDataFrame([("click::%",), ("area2/tests/%",), ("%::u3::%",)], "pattern string")
    fits = F.expr("case when contains(pattern, '::') then id else file end like pattern")
    return issues(spark, d).join(F.broadcast(patterns), fits).groupBy("pattern").agg(F.count("*").alias("n"))


def scans(spark, d):
    """Two scans of (detector, file) keys: the state before, and the current one, in which one detector found nothing."""
    rows = issues(spark, d)
    keyed = rows.withColumn("id", F.concat_ws("::", "detector", "file"))
    old = keyed.where("day % 2 = 0").groupBy("id", "detector", "file").agg(F.max_by("status", "event_id").alias("status")).withColumn("reopen_count", F.lit(0))
    new = keyed.where("day % 2 = 1 and detector != 'signup'").select("id", "detector", "file").distinct()
    return old, new


SCANS = ISSUES + ", keyed AS (SELECT *, detector || '::' || file AS k FROM issues), old AS (SELECT k, detector, file, arg_max(status, event_id) AS status FROM keyed WHERE day % 2 = 0 GROUP BY 1, 2, 3), new AS (SELECT DISTINCT k, detector FROM keyed WHERE day % 2 = 1 AND detector <> 'signup'), doubt AS (SELECT detector, count(*) AS was FROM old WHERE status = 'open' GROUP BY 1 HAVING count(*) >= 3 AND detector NOT IN (SELECT detector FROM new))"


@query("q32_scan_merge", f"""WITH {SCANS}, m AS (SELECT coalesce(new.k, old.k) AS id, coalesce(new.detector, old.detector) AS detector, status,
 CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NOT NULL AND status IN ('fixed', 'auto_resolved') THEN 'reopened' WHEN new.k IS NOT NULL THEN 'seen'
 WHEN status IN ('open', 'wontfix', 'fixed', 'false_positive') AND old.detector NOT IN (SELECT detector FROM doubt) AND NOT contains(old.file, '/vendor/') THEN 'resolved' ELSE 'kept' END AS action FROM old FULL JOIN new ON old.k = new.k)
 SELECT id, detector, action, CASE WHEN action IN ('new', 'reopened') THEN 'open' WHEN action = 'resolved' THEN 'auto_resolved' ELSE status END AS new_status, CAST(action = 'reopened' AS BIGINT) AS reopen_count FROM m""")
def scan_merge(spark, d):
    old, new = scans(spark, d)
    return state.merge_scan(old, new, ~F.contains("file", F.lit("/vendor/")))


@query("q33_suspects", f"WITH {SCANS} SELECT detector, was FROM doubt")
def suspects(spark, d):
    return state.suspects(*scans(spark, d))


@query("q34_reopen_counts", f"WITH {ISSUES}, a AS (SELECT DISTINCT detector || '::' || file AS key, day FROM issues), g AS (SELECT *, lag(day) OVER (PARTITION BY key ORDER BY day) AS b FROM a) SELECT key, count(*) FILTER (day > b + 1) AS reopened FROM g GROUP BY 1 HAVING count(*) FILTER (day > b + 1) >= 2")
def reopen_counts(spark, d):
    return state.reopeners(issues(spark, d).select(F.concat_ws("::", "detector", "file").alias("key"), F.col("day").alias("scan")))


CAP = ISSUES + ", capped AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY tier, crank, id) AS place FROM issues WHERE status = 'open')"


def open_issues(spark, d):
    return issues(spark, d).where("status = 'open'")


@query("q35_noise_budget", f"WITH {CAP} SELECT detector, count(*) - count(*) FILTER (place <= 10) AS hidden FROM capped GROUP BY 1")
def noise_budget(spark, d):
    rows = open_issues(spark, d)
    return queue.hidden(rows, queue.capped(rows, 10))


@query("q36_round_robin", f"WITH {CAP} SELECT c.id, c.detector, CAST(c.place AS BIGINT) AS place FROM capped c JOIN capped f ON f.detector = c.detector AND f.place = 1 WHERE c.place <= 10 ORDER BY c.place, f.tier, f.crank, f.id, c.detector LIMIT 23")
def round_robin(spark, d):
    return queue.round_robin(queue.capped(open_issues(spark, d), 10), 23).select("id", "detector", F.col("place").cast("long").alias("place"))


HISTORY = ISSUES + ", h AS (SELECT day AS scan, CAST(round(100.0 * count(*) FILTER (status <> 'open') / count(*), 4) AS DOUBLE) AS score, CAST(round(100.0 * count(*) FILTER (status = 'wontfix') / count(*), 4) AS DOUBLE) AS gap FROM issues GROUP BY 1)"


def history(spark, d):
    def share(status):
        return F.round(F.lit(100.0) * F.count_if(status) / F.count("*"), 4)

    return issues(spark, d).groupBy(F.col("day").alias("scan")).agg(share(F.col("status") != "open").alias("score"), share(F.col("status") == "wontfix").alias("gap"))


@query("q37_phase", f"WITH {HISTORY}, w AS (SELECT *, row_number() OVER o AS n, first_value(score) OVER o AS f, lag(score) OVER o AS b1, lag(score, 2) OVER o AS b2 FROM h WINDOW o AS (ORDER BY scan)) SELECT scan, score, CASE WHEN n = 1 THEN 'first_scan' WHEN score < b1 - 0.5 THEN 'regression' WHEN n >= 3 AND greatest(score, b1, b2) - least(score, b1, b2) <= 0.5 THEN 'stagnation' WHEN n <= 5 AND score > f THEN 'early_momentum' WHEN score > 93 THEN 'maintenance' WHEN score > 80 THEN 'refinement' ELSE 'middle_grind' END AS phase FROM w")
def phase(spark, d):
    return state.phases(history(spark, d).select("scan", "score"))


@query("q38_trend_last5", f"WITH {HISTORY}, w AS (SELECT scan, gap, first_value(gap) OVER (ORDER BY scan ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM h) SELECT scan, gap, CASE WHEN gap - f > 0.5 THEN 'growing' WHEN f - gap > 0.5 THEN 'shrinking' ELSE 'stable' END AS trend FROM w")
def trend_last5(spark, d):
    return state.trend(history(spark, d).select("scan", "gap"))


@query("q39_integrity_runs", "WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) SELECT conv_id, role, min(turn) AS start, count(*) AS length FROM c GROUP BY conv_id, role, g")
def integrity_runs(spark, d):
    return state.runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


WRITES = "w AS (SELECT user_id AS scope, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'write' ELSE 'read' END AS kind FROM events)"


@query("q40_overwritten_key", f"WITH {WRITES}, n AS (SELECT *, lead(kind) OVER (PARTITION BY scope ORDER BY seq) AS nk FROM w) SELECT scope, seq, kind FROM n WHERE kind = 'write' AND nk = 'write'")
def overwritten_key(spark, d):
    kind = F.when(F.col("event_type").isin("click", "purchase"), "write").otherwise("read")
    return state.overwritten(table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("q41_work_queue_topk", f"WITH {ISSUES} SELECT id, tenths * tier AS impact, row_number() OVER (ORDER BY tenths * tier DESC, crank, id) AS position FROM issues WHERE status = 'open' ORDER BY position LIMIT 50")
def work_queue_topk(spark, d):
    top = queue.ranked(open_issues(spark, d), scoring.confidence_tenths(F.col("confidence")) * F.col("tier"), 50)
    return top.select("id", F.col("impact").cast("long").alias("impact"), F.col("position").cast("long").alias("position"))


@query("q42_auto_clusters", f"WITH {ISSUES} SELECT detector, file, count(*) AS size, min(id) AS first FROM issues WHERE status = 'open' GROUP BY 1, 2 HAVING count(*) >= 2")
def auto_clusters(spark, d):
    return queue.clusters(issues(spark, d), ("detector", "file"))


@query("q43_concern_profiles", f"WITH {ISSUES}, s AS (SELECT file, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, count(DISTINCT detector) AS n FROM issues WHERE status = 'open' GROUP BY 1 HAVING count(DISTINCT detector) >= 2) SELECT detectors, count(*) AS files FROM s GROUP BY 1 HAVING count(*) >= 3")
def concern_profiles(spark, d):
    return queue.profiles(issues(spark, d))


@query("q44_systemic", f"WITH {ISSUES} SELECT detector, tier, count(DISTINCT file) AS files FROM issues WHERE status = 'open' GROUP BY 1, 2 HAVING count(DISTINCT file) >= 5")
def systemic(spark, d):
    return queue.systemic(issues(spark, d))

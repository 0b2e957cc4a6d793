"""Queries of report readers, predicates and summaries, over events, parts and customers in the roles of reports, issues and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import scalar
from corpuscle.operators import scoring, selection, summaries
from corpuscle.plans import health
from corpuscle.plans.inputs import FAILING, ISSUES, LINES, issues, lines
from corpuscle.plans.registry import query
from corpuscle.sources import reports
from corpuscle.util import table


def findings(spark, d):
    """Events as linter findings: event_id, file, no, said."""
    e = table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file"), (F.col("event_id") % 50 + 1).alias("no"), F.concat(F.lit("found "), "event_type").alias("said"))


FOUND = "SELECT event_id, 'src/u' || user_id || '.py' AS file, CAST(event_id % 50 + 1 AS BIGINT) AS line, 'found ' || event_type AS message FROM events"


def parsed(kind, rows, text):
    found = reports.read(kind, rows.select("event_id", text.alias("text")), "text", ("event_id",))
    return found.withColumn("line", F.col("line").cast("long"))


@query("q61_report_gnu", FOUND + " WHERE event_id % 10 <> 9")
def report_gnu(spark, d):
    column = F.when(F.col("event_id") % 2 == 0, ":7").otherwise("")
    place = F.concat("file", F.lit(":"), F.col("no").cast("string"), column, F.lit(": "), "said", F.lit("\nno place here"))
    return parsed("gnu", findings(spark, d), F.when(F.col("event_id") % 10 != 9, place).otherwise(F.col("said")))


@query("q62_report_golangci", FOUND)
def report_golangci(spark, d):
    one = F.struct(F.struct(F.col("file").alias("Filename"), F.col("no").alias("Line")).alias("Pos"), F.col("said").alias("Text"))
    return parsed("golangci", findings(spark, d), F.to_json(F.struct(F.array(one).alias("Issues"))))


@query("q63_report_json", FOUND)
def report_json(spark, d):
    def named(file, line, message):
        return F.to_json(F.array(F.struct(F.col("file").alias(file), F.col("no").alias(line), F.col("said").alias(message))))

    third = F.col("event_id") % 3
    text = F.when(third == 0, named("file", "line", "message")).when(third == 1, named("filename", "line_no", "text")).otherwise(named("path", "row", "reason"))
    return parsed("json", findings(spark, d), text)


@query("q64_report_rubocop", FOUND)
def report_rubocop(spark, d):
    offense = F.struct(F.struct(F.col("no").alias("line")).alias("location"), F.col("said").alias("message"))
    return parsed("rubocop", findings(spark, d), F.to_json(F.struct(F.array(F.struct(F.col("file").alias("path"), F.array(offense).alias("offenses"))).alias("files"))))


@query("q65_report_cargo", FOUND + " WHERE event_id % 4 <> 0")
def report_cargo(spark, d):
    span = F.struct(F.col("file").alias("file_name"), F.col("no").alias("line_start"))
    message = F.struct(F.concat("said", F.lit("\n  more")).alias("rendered"), F.array(span).alias("spans"))
    reason = F.when(F.col("event_id") % 4 == 0, "build-finished").otherwise("compiler-message")
    return parsed("cargo", findings(spark, d), F.concat(F.lit("not json\n"), F.to_json(F.struct(reason.alias("reason"), message.alias("message")))))


@query("q66_report_eslint", FOUND)
def report_eslint(spark, d):
    message = F.struct(F.col("no").alias("line"), F.col("said").alias("message"))
    return parsed("eslint", findings(spark, d), F.to_json(F.array(F.struct(F.col("file").alias("filePath"), F.array(message).alias("messages")))))


@query("q67_issue_pattern", f"WITH {ISSUES} SELECT pattern, count(*) AS n FROM issues JOIN (VALUES ('click::*'), ('u3'), ('area2/src'), ('error')) p(pattern) ON id = pattern OR pattern = 'click::*' AND id LIKE 'click::%' OR list_contains(string_split(id, '::'), pattern) OR starts_with(file, pattern || '/') GROUP BY 1")
def issue_pattern(spark, d):
    rows = issues(spark, d)
    fits = [F.when(selection.matches_pattern(p, F.col("id"), F.col("detector"), F.col("file")), p) for p in ("click::*", "u3", "area2/src", "error")]
    out = rows.select(F.explode(F.array_compact(F.array(*fits))).alias("pattern"))
    return out.groupBy("pattern").agg(F.count("*").alias("n"))


LOW = ", ".join(f"'{p}'" for p in selection.PLACEHOLDERS)
STARTS = " OR ".join(f"starts_with(lower(trim(n_name)), '{p}')" for p in selection.PLACEHOLDER_STARTS)


@query("q68_placeholder", f"SELECT n_name, lower(trim(n_name)) IN ({LOW}) OR length(n_name) < 8 OR {STARTS} AS placeholder FROM nation")
def placeholder(spark, d):
    return table(spark, d, "nation").select("n_name", selection.placeholder(F.col("n_name")).alias("placeholder"))


@query("q69_comment_lines", f"WITH {LINES} SELECT area, count(*) AS n, count(*) FILTER (regexp_matches(ltrim(line, ' '), '^(//|#|\\*|/\\*)')) AS comments, count(*) FILTER (contains(line, 'os.environ') OR contains(line, 'os.getenv') OR contains(line, 'process.env.') OR contains(line, 'import.meta.env')) AS lookups FROM lines GROUP BY 1")
def comment_lines(spark, d):
    line = F.col("line")
    return lines(spark, d).groupBy("area").agg(F.count("*").alias("n"), F.count_if(selection.comment_line(line)).alias("comments"), F.count_if(selection.environment_lookup(line)).alias("lookups"))


@query("q70_standalone_threshold", f"WITH {ISSUES} SELECT detector, count(*) AS n FROM issues WHERE NOT (detector = 'click' AND crank > 0 OR detector = 'view' AND crank > 1) GROUP BY 1")
def standalone_threshold(spark, d):
    registry = spark.createDataFrame([("click", "high"), ("view", "medium")], "detector string, least string")
    return selection.standalone(issues(spark, d), registry).groupBy("detector").agg(F.count("*").alias("n"))


@query("q71_impact_floor", f"WITH {ISSUES} SELECT detector, count(*) AS n FROM issues WHERE detector = 'signup' OR value / 1000 = 0 OR value / 1000 >= 0.05 GROUP BY 1")
def impact_floor(spark, d):
    rows = issues(spark, d)
    return rows.where(selection.above_floor(F.col("value") / 1000, F.col("detector") == "signup")).groupBy("detector").agg(F.count("*").alias("n"))


@query("q72_queue_stage", f"WITH {ISSUES}, f AS (SELECT bool_or(detector = 'none') AS i, bool_or(detector <> 'signup') AS o FROM issues) SELECT detector, count(*) AS n FROM issues, f WHERE CASE WHEN i THEN detector = 'none' WHEN o THEN detector <> 'signup' ELSE true END GROUP BY 1")
def queue_stage(spark, d):
    return selection.by_stage(issues(spark, d), F.col("detector") == "none", F.col("detector") == "signup").groupBy("detector").agg(F.count("*").alias("n"))


def renamed(spark, d):
    """Issues of which clicks are of the large detector and views of complexity; some are suppressed."""
    kind = F.when(F.col("detector") == "click", "large").when(F.col("detector") == "view", "complexity").otherwise(F.col("detector"))
    return issues(spark, d).withColumn("detector", kind).withColumn("suppressed", F.col("user_id") % 13 == 0)


MERGED = ISSUES + ", merged AS (SELECT * REPLACE (CASE WHEN detector IN ('click', 'view') THEN 'structural' ELSE detector END AS detector), user_id % 13 = 0 AS suppressed FROM issues)"


@query("q73_open_by_detector", f"WITH {MERGED} SELECT detector, count(*) AS n FROM merged WHERE status = 'open' AND NOT suppressed GROUP BY 1")
def open_by_detector(spark, d):
    return summaries.open_by_detector(renamed(spark, d))


@query("q74_false_positive_rates", f"WITH {MERGED} SELECT detector, zone, count(*) AS total, count(*) FILTER (status = 'false_positive') / count(*) AS rate FROM merged GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (status = 'false_positive') > 0")
def false_positive_rates(spark, d):
    return summaries.false_positive_rates(renamed(spark, d))


@query("q75_signal_density", f"WITH {ISSUES} SELECT file, count(DISTINCT detector) AS detector_count, count(*) AS issue_count, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors FROM issues GROUP BY 1 HAVING count(DISTINCT detector) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def signal_density(spark, d):
    return summaries.signal_density(issues(spark, d))


@query("q76_complexity_hotspots", "SELECT 'p' || p_partkey AS file, round(p_size * 17 / 100 + p_partkey % 37 + 3 * (p_partkey % 5) + 10 * (p_partkey % 3), 4) AS score FROM part ORDER BY 2 DESC, 1 LIMIT 20")
def complexity_hotspots(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    return summaries.hotspots(p.select(F.concat(F.lit("p"), key.cast("string")).alias("file"), (F.col("p_size") * 17).alias("loc"), (key % 37).alias("complexity"), (key % 5).alias("components"), (key % 3).alias("monsters")))


@query("q77_structural_merge", "WITH s AS (SELECT 'u' || user_id AS file, CASE event_type WHEN 'click' THEN 'large' WHEN 'error' THEN 'gods' ELSE 'complexity' END AS kind, event_id % 50 AS score FROM events), g AS (SELECT file, string_agg(DISTINCT kind, ' / ' ORDER BY kind) AS signals, count(DISTINCT kind) AS k, max(score) AS best, bool_and(kind = 'complexity') AS alone FROM s GROUP BY 1) SELECT file, signals, CASE WHEN k >= 3 THEN 4 ELSE 3 END AS tier, CASE WHEN k >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE NOT alone OR best >= 35")
def structural_merge(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "large").when(F.col("event_type") == "error", "gods").otherwise("complexity")
    return summaries.structural(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), kind.alias("kind"), (F.col("event_id") % 50).alias("score")))


@query("q78_signature_variance", "SELECT p_type AS name, count(DISTINCT p_brand) AS files, count(DISTINCT (p_size % 3) * 10 + p_partkey % 2) AS shapes FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3 AND count(DISTINCT (p_size % 3) * 10 + p_partkey % 2) > 1")
def signature_variance(spark, d):
    p = table(spark, d, "part")
    return summaries.signature_variance(p.select(F.col("p_type").alias("name"), F.col("p_brand").alias("file"), (F.col("p_size") % 3).alias("params"), (F.col("p_partkey") % 2).alias("returns")))


@query("q79_duplicate_constants", "SELECT c_mktsegment AS name, c_nationkey AS value, count(DISTINCT c_custkey % 50) AS files FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey % 50) >= 2")
def duplicate_constants(spark, d):
    c = table(spark, d, "customer")
    return summaries.duplicate_constants(c.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("value"), (F.col("c_custkey") % 50).alias("file")))


@query("q80_unused_names", "SELECT c_nationkey AS file, c_custkey AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 <> c_nationkey)")
def unused_names(spark, d):
    defined = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("name"))
    return summaries.unused_names(defined, table(spark, d, "orders").select((F.col("o_orderkey") % 25).alias("file"), F.col("o_custkey").alias("name")))


def scan_counts(spark, d):
    return issues(spark, d).groupBy(F.col("day").alias("scan")).agg(F.count_if(F.col("status") == "wontfix").alias("ignored"), F.count("*").alias("raw"))


COUNTS = ISSUES + ", h AS (SELECT day AS scan, count(*) FILTER (status = 'wontfix') AS ignored, count(*) AS raw FROM issues GROUP BY 1)"


@query("q81_suppression", f"WITH {COUNTS}, l AS (SELECT * FROM h ORDER BY scan DESC LIMIT 5) SELECT arg_max(ignored, scan) AS last_ignored, arg_max(raw, scan) AS last_raw, count(*) AS recent_scans, CAST(sum(ignored) AS BIGINT) AS recent_ignored, CAST(sum(raw) AS BIGINT) AS recent_raw, round(least(100.0, 100 * sum(ignored) / sum(raw)), 1) AS recent_pct FROM l")
def suppression(spark, d):
    return summaries.suppression(scan_counts(spark, d))


@query("q82_history_retention", f"WITH {COUNTS} SELECT * FROM h ORDER BY scan DESC LIMIT 20")
def history_retention(spark, d):
    return summaries.retained(scan_counts(spark, d))


@query("q83_milestones", f"WITH {health.HISTORY}, w AS (SELECT scan, score, lag(score) OVER (ORDER BY scan) AS b FROM h) SELECT scan, score, CASE WHEN b < 61 AND score >= 61 THEN 61 ELSE 60 END AS crossed FROM w WHERE b < 61 AND score >= 61 OR b < 60 AND score >= 60")
def milestones(spark, d):
    return summaries.milestones(health.history(spark, d).select("scan", "score"), (61, 60))


@query("q84_reminder_decay", "WITH r AS (SELECT DISTINCT user_id AS kind, user_id % 10 = 0 AS keep FROM events), s AS (SELECT user_id AS kind, count(*) AS n FROM events WHERE value >= 100 GROUP BY 1) SELECT kind, keep FROM r LEFT JOIN s USING (kind) WHERE keep OR coalesce(n, 0) < 3")
def reminder_decay(spark, d):
    e = table(spark, d, "events")
    reminders = e.select(F.col("user_id").alias("kind"), (F.col("user_id") % 10 == 0).alias("keep")).distinct()
    return summaries.decayed(reminders, e.where("value >= 100").select(F.col("user_id").alias("kind"), F.lit(1).alias("n")))


@query("q85_carry_forward", f"WITH {ISSUES}, b AS (SELECT detector, count(*) AS score FROM issues GROUP BY 1), n AS (SELECT detector, count(*) AS score FROM issues WHERE tier = 1 AND detector <> 'error' GROUP BY 1) SELECT detector AS dimension, score, false AS carried FROM n UNION ALL SELECT detector, score, true FROM b WHERE detector NOT IN (SELECT detector FROM n)")
def carry_forward(spark, d):
    def scores(rows):
        return rows.groupBy(F.col("detector").alias("dimension")).agg(F.count("*").alias("score"))

    rows = issues(spark, d)
    return summaries.carried(scores(rows), scores(rows.where("tier = 1 and detector != 'error'")))


@query("q86_work_lanes", f"WITH {ISSUES}, a AS (SELECT status AS kind, detector, count(*) AS n FROM issues WHERE tier <= 2 GROUP BY 1, 2), f AS (SELECT DISTINCT detector, file FROM issues), t AS (SELECT kind, count(DISTINCT file) AS files FROM a JOIN f USING (detector) GROUP BY 1) SELECT kind, count(*) AS actions, CAST(sum(n) AS BIGINT) AS issues, any_value(files) AS files FROM a JOIN t USING (kind) GROUP BY 1")
def work_lanes(spark, d):
    rows = issues(spark, d)
    return summaries.lanes(rows.where("tier <= 2").groupBy(F.col("status").alias("kind"), "detector").agg(F.count("*").alias("n")), rows)


@query("q87_fixer_leverage", f"WITH {ISSUES} SELECT count(*) AS total, count(*) FILTER (detector IN ('click', 'view')) AS fixable, round(count(*) FILTER (detector IN ('click', 'view')) / count(*), 4) AS share FROM issues WHERE status = 'open'")
def fixer_leverage(spark, d):
    counts = issues(spark, d).where("status = 'open'").groupBy("detector").agg(F.count("*").alias("n"))
    return summaries.leverage(counts, spark.createDataFrame([("click",), ("view",)], "detector string"))


@query("q88_stale_wontfix", f"WITH {ISSUES}, s AS (SELECT id, 31 - day >= 20 AS old, detector = 'click' AND (user_id % 80 >= 50 OR user_id % 15 >= 10) AS grown FROM issues WHERE status = 'wontfix') SELECT id, concat_ws(',', CASE WHEN old THEN 'scan_decay' END, CASE WHEN grown THEN 'severity_drift' END) AS reasons FROM s WHERE old OR grown")
def stale_wontfix(spark, d):
    rows = issues(spark, d)
    size, depth = F.col("event_id") % 100, F.col("event_id") % 20
    kind = F.when(F.col("detector") == "click", "structural").otherwise(F.col("detector"))
    before = rows.where("status = 'wontfix'").select("id", kind.alias("detector"), F.col("day").alias("since"), size.alias("loc"), depth.alias("complexity"))
    return summaries.stale_wontfix(before, rows.select("id", (size + F.col("user_id") % 80).alias("loc"), (depth + F.col("user_id") % 15).alias("complexity")), 31)


@query("q89_supersession", f"WITH {ISSUES} SELECT a.id, b.id AS candidate FROM issues a JOIN issues b USING (detector, file) WHERE a.status = 'fixed' AND b.status = 'open' AND a.id <> b.id")
def supersession(spark, d):
    rows = issues(spark, d)
    return summaries.successors(rows.where("status = 'fixed'").select("id", "detector", "file"), rows)


@query("q90_snapshot_hash", f"WITH {ISSUES} SELECT count(DISTINCT id) AS n, sha256(string_agg(DISTINCT id, '|' ORDER BY id)) AS hash FROM issues WHERE status = 'open' AND detector = 'signup'")
def snapshot_hash(spark, d):
    return summaries.snapshot_hash(issues(spark, d), "signup")


@query("q91_new_since_triage", f"WITH {ISSUES} SELECT DISTINCT file AS id FROM issues WHERE status = 'open' AND file NOT IN (SELECT file FROM issues WHERE status = 'fixed')")
def new_since_triage(spark, d):
    rows = issues(spark, d)
    return summaries.new_since(rows.where("status = 'open'").select(F.col("file").alias("id")), rows.where("status = 'fixed'").select(F.col("file").alias("id")))


@query("q92_under_target", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 5000 AND s_nationkey % 5 <> 0 AND s_nationkey % 7 <> 0")
def under_target(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("n"))
    return summaries.under_target(s, s.where("n % 5 = 0"), s.where("n % 7 = 0"), 5000)


@query("q93_coverage_confidence", f"WITH {ISSUES}, c AS (SELECT detector, min(value) AS confidence FROM issues WHERE detector <> 'view' GROUP BY 1) SELECT zone AS dimension, min(coalesce(confidence, 1.0)) AS confidence FROM (SELECT DISTINCT zone, detector FROM issues) LEFT JOIN c USING (detector) GROUP BY 1")
def coverage_confidence(spark, d):
    rows = issues(spark, d)
    return summaries.coverage_confidence(rows.select(F.col("zone").alias("dimension"), "detector").distinct(), rows.where("detector != 'view'").select("detector", F.col("value").alias("confidence")))


@query("q95_risk_levels", "WITH p AS (SELECT p_partkey, p_size * 15 AS loc, p_partkey % 25 AS i, p_partkey % 23 AS c FROM part), r AS (SELECT *, CASE WHEN i >= 10 OR c >= 20 OR loc >= 400 THEN 'high' WHEN i >= 4 OR c >= 12 OR loc >= 200 THEN 'medium' ELSE 'low' END AS risk FROM p) SELECT p_partkey, risk, CASE risk WHEN 'high' THEN CAST(0.6 AS DOUBLE) WHEN 'medium' THEN 0.5 ELSE 0.35 END AS least, CASE WHEN i <= 5 THEN 2 WHEN i <= 20 THEN 3 ELSE 4 END AS tier, CASE WHEN i <= 5 THEN 'high' ELSE 'medium' END AS confidence FROM r")
def risk_levels(spark, d):
    p = table(spark, d, "part")
    importers = F.col("p_partkey") % 25
    rows = p.select("p_partkey", scalar.risk_level(F.col("p_size") * 15, importers, F.col("p_partkey") % 23).alias("risk"), scalar.facade_tier(importers).alias("f"))
    return rows.select("p_partkey", "risk", scalar.quality_threshold(F.col("risk")).alias("least"), "f.tier", "f.confidence")


@query("q96_concern_fingerprint", f"WITH {ISSUES} SELECT file, substr(sha256('mixed::' || file || '::' || string_agg(DISTINCT detector, ',' ORDER BY detector)), 1, 16) AS fingerprint FROM issues GROUP BY 1")
def concern_fingerprint(spark, d):
    sets = issues(spark, d).groupBy("file").agg(F.collect_set("detector").alias("s"))
    return sets.select("file", scalar.concern_fingerprint(F.lit("mixed"), F.col("file"), F.col("s")).alias("fingerprint"))


@query("q97_key_typos", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name AND (levenshtein(a.n_name, b.n_name) <= 2 OR a.n_name || 's' = b.n_name)")
def key_typos(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a")), n.select(F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & scalar.one_edit_apart(F.col("a"), F.col("b")))


@query("q98_scalars", f"WITH {ISSUES} SELECT id, regexp_replace(regexp_replace(lower(id), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, array_to_string(string_split(file, '/')[1:2], '/') AS area, round(abs(value - 50), 6) <= 5 AS near, CASE status WHEN 'resolved' THEN 'fixed' ELSE status END AS status, greatest(10.0, least(90.0, value)) AS clamped FROM issues")
def scalars(spark, d):
    value = F.col("value")
    return issues(spark, d).select("id", scalar.slug(F.col("id")).alias("slug"), scalar.area(F.col("file")).alias("area"), scalar.near_target(value, 50, 5).alias("near"), scalar.status_of(F.col("status")).alias("status"), scalar.clamp(value, 10.0, 90.0).alias("clamped"))


@query("q99_score_bundle", f"WITH {health.BY_DIMENSION}, ws(dimension, weight) AS (VALUES {', '.join(map(str, health.WEIGHTS))}), m AS (SELECT mode, round(sum(score * weight * least(1.0, checks / 200)) / sum(weight * least(1.0, checks / 200)), 4) AS health FROM scored JOIN ws USING (dimension) GROUP BY 1) SELECT max(health) FILTER (mode = 'lenient') AS overall, max(health) FILTER (mode = 'strict') AS strict, max(health) FILTER (mode = 'verified_strict') AS verified FROM m")
def score_bundle(spark, d):
    return summaries.score_bundle(health.health(spark, d))


@query("q100_reset_near_target", "WITH a AS (SELECT s_suppkey AS dimension, round(s_acctbal) AS score FROM supplier), t AS (SELECT count(*) FILTER (abs(score - 5000) <= 500) AS n FROM a) SELECT dimension, CASE WHEN abs(score - 5000) <= 500 AND n >= 2 THEN 0.0 ELSE score END AS score, abs(score - 5000) <= 500 AND n >= 2 AS reset FROM a, t")
def reset_near_target(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dimension"), F.round("s_acctbal").alias("score"))
    return scoring.reset_near_target(s, 5000, 500)


@query("q101_loc_weighted", f"WITH {FAILING}, w AS (SELECT detector, mode, file, sum(user_id % 9 + tier) AS w, arg_min(user_id % 9 + tier, id) AS f FROM failing GROUP BY 1, 2, 3) SELECT detector, mode, CAST(sum(least(w, f)) AS BIGINT) AS weighted FROM w GROUP BY 1, 2")
def loc_weighted(spark, d):
    return scoring.loc_weighted(issues(spark, d).withColumn("weight", F.col("user_id") % 9 + F.col("tier")), "weight")

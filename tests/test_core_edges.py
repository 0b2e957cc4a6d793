"""Nulls, ties, repeated rows, empty tables and clashing names of the core's operators."""

from pyspark.sql import functions as F

from corpuscle.operators import queue, scoring, selection, state, summaries
from corpuscle.sources import reports

ISSUE = "id string, detector string, file string, zone string, status string, confidence string, tier int"


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_reports_of_nothing_and_of_rubbish(spark):
    given = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "null")], "k int, text string")
    for kind in reports.FORMATS:
        assert reports.read(kind, given, carry=("k",)).count() == 0
        assert reports.read(kind, given.limit(0), carry=("k",)).count() == 0


def test_report_entries_without_a_field(spark):
    given = spark.createDataFrame([('[{"file":"a","message":"m"},{"file":"","path":"b","line":"x","text":"m"},{"path":"c","row":7,"reason":"r"},{"line":1}]',)], "text string")
    assert values(reports.flat_json(given)) == [("a", 0, "m"), ("c", 7, "r")]
    assert values(reports.gnu(spark.createDataFrame([("a b.c:3:9: x:4: y\nnothing\n:1: z",)], "text string"))) == [("a b.c", 3, "x:4: y")]


def test_a_format_is_registered_once(spark):
    reports.register("own", reports.gnu)
    try:
        assert reports.read("own", spark.createDataFrame([("a:1: m",)], "text string")).count() == 1
        try:
            reports.register("own", reports.gnu)
            raise AssertionError("a taken name was accepted")
        except ValueError:
            pass
    finally:
        del reports.FORMATS["own"]


def test_patterns(spark):
    rows = spark.createDataFrame([("d::a.py::n", "d", "src/a.py"), (None, None, None), ("d::b.py::12ab34cd", "d", "src/lib/b.py")], "id string, detector string, file string")

    def hits(p):
        return rows.where(selection.matches_pattern(p, F.col("id"), F.col("detector"), F.col("file"))).count()

    assert [hits(p) for p in ("d", "d::*", "d::a", "src/lib/", "12ab34cd", "n", "x", "*", "")] == [2, 2, 1, 1, 1, 1, 0, 2, 0]


def test_holistic_issues_are_not_capped_and_suppressed_ones_do_not_count(spark):
    rows = [(str(i), "d", "a.py", None, "open", "high", 1, False, False) for i in range(6)] + [("h", "d", ".", "production", "open", "high", 1, True, False), ("s", "d", "b.py", "production", "open", "high", 1, False, True), ("n", "d", "c.py", "production", None, None, 1, None, None)]
    got = scoring.capped_stats(spark.createDataFrame(rows, ISSUE + ", holistic boolean, suppressed boolean"))
    assert values(got.where("mode = 'lenient'").select("failures", "tenths", "files")) == [(7, 20 + 100, 1)]


def test_a_file_weighs_no_more_than_its_first_issue(spark):
    rows = [("1", "d", "a", "production", "open", "high", 1, 5.0), ("2", "d", "a", "production", "open", "high", 1, 9.0), ("3", "d", "b", None, "open", None, 1, 2.0)]
    got = scoring.loc_weighted(spark.createDataFrame(rows, ISSUE + ", w double"), "w")
    assert values(got.where("mode = 'strict'").select("weighted")) == [(7.0,)]


def test_round_robin_follows_the_first_issue(spark):
    rows = [("z1", "zeta", "f", "p", "open", "high", 1), ("a1", "alpha", "f", "p", "open", "high", 3), ("a2", "alpha", "f", "p", "open", None, 3), ("z2", "zeta", "f", "p", "open", "odd", 1)]
    shown = queue.capped(spark.createDataFrame(rows, ISSUE), 5)
    assert [r.id for r in queue.round_robin(shown, 3).orderBy("place", F.desc("detector")).collect()] == ["z1", "a1", "z2"]
    assert queue.round_robin(shown.limit(0), 3).count() == 0


def test_phases(spark):
    def last(*scores):
        return state.phases(spark.createDataFrame(list(enumerate(scores)), "scan int, score double")).orderBy(F.desc("scan")).first().phase

    got = [last(50.0), last(50.0, 40.0), last(50.0, 50.1, 50.2), last(50.0, 60.0, 59.8), last(70.0, 60.0, 61.0), last(95.0, 80.0, 94.0), last(90.0, 80.0, 85.0), last(50.0, None)]
    assert got == ["first_scan", "regression", "stagnation", "early_momentum", "middle_grind", "maintenance", "refinement", "middle_grind"]


def test_merge_resolves_every_status_but_not_what_is_excluded(spark):
    old = spark.createDataFrame([(s, "d", "a", s, 0) for s in ("open", "wontfix", "fixed", "false_positive", "auto_resolved")] + [("x", "d", None, "open", 0), ("s1", "t", "a", "open", 0), ("s2", "t", "a", "open", 0), ("s3", "t", "a", "open", 0)], "id string, detector string, file string, status string, reopen_count int")
    new = spark.createDataFrame([("n", "d", "a"), ("n", "d", "a")], "id string, detector string, file string")
    got = {r.id: r.action for r in state.merge_scan(old, new, F.col("file") == "a").collect()}
    assert got == {"open": "resolved", "wontfix": "resolved", "fixed": "resolved", "false_positive": "resolved", "auto_resolved": "kept", "x": "kept", "s1": "kept", "s2": "kept", "s3": "kept", "n": "new"}


def test_summaries_of_empty_tables(spark):
    none = spark.createDataFrame([], ISSUE + ", suppressed boolean")
    for op in (summaries.open_by_detector, summaries.false_positive_rates, summaries.signal_density):
        assert op(none).count() == 0
    assert summaries.suppression(spark.createDataFrame([], "scan int, ignored int, raw int")).count() == 0
    assert values(summaries.leverage(spark.createDataFrame([], "detector string, n int"), spark.createDataFrame([], "detector string"))) == [(0, 0, 0.0)]
    assert values(summaries.snapshot_hash(none).select("n")) == [(0,)]


def test_summaries_with_nulls_ties_and_repeats(spark):
    rows = [("1", "gods", "b", None, "false_positive", "high", 1, None)] * 3 + [("2", "large", "a", "production", "open", "high", 1, None)] * 2 + [("3", None, "a", "test", "open", "low", 1, True), ("4", "odd", "a", "test", "open", "low", 1, False), ("5", "odd", "b", "test", None, "low", 1, False)]
    df = spark.createDataFrame(rows, ISSUE + ", suppressed boolean")
    assert values(summaries.open_by_detector(df)) == [("odd", 1), ("structural", 2)]
    assert values(summaries.false_positive_rates(df)) == [("structural", "production", 5, 0.6)]
    assert [r.file for r in summaries.signal_density(df).collect()] == ["b", "a"]
    signals = spark.createDataFrame([("a", "complexity", 40), ("a", "complexity", None), ("b", "complexity", 34), ("c", "large", None)], "file string, kind string, score int")
    assert values(summaries.structural(signals)) == [("a", "complexity", 3, "medium"), ("c", "large", 3, "medium")]

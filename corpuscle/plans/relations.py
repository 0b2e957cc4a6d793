"""Queries over graphs, and plain relational ones over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.scalar import loc_weight
from corpuscle.operators import census, graph
from corpuscle.plans.inputs import EDGES, edges
from corpuscle.plans.registry import query
from corpuscle.streaming import issues as stream
from corpuscle.util import table


@query("q10_degree_instability", f"WITH {EDGES}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in, round(sum(o) / (sum(i) + sum(o)), 4) AS instability FROM e GROUP BY 1")
def degree_instability(spark, d):
    return graph.degrees(edges(spark, d))


def nodes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))


@query("q11_orphans", f"WITH {EDGES} SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM edges)")
def orphans(spark, d):
    return graph.orphans(nodes(spark, d), edges(spark, d))


@query("q12_single_use", f"WITH {EDGES} SELECT dst AS node, min(src) AS user FROM edges GROUP BY 1 HAVING count(*) = 1")
def single_use(spark, d):
    return graph.single_use(edges(spark, d))


REACH = EDGES + ", reach AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT dst FROM reach JOIN edges ON src = node)"


@query("q13_reachable", f"WITH RECURSIVE {REACH} SELECT node FROM reach")
def reachable(spark, d):
    return graph.reachable(edges(spark, d), nodes(spark, d).where("node % 10 = 0")).select("node")


@query("q14_scc", f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b), m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT node, min(other) AS component, count(*) AS size FROM m GROUP BY 1 HAVING count(*) > 1")
def scc(spark, d):
    return graph.strong_components(edges(spark, d))


@query("q15_coupling_backwards", f"WITH {EDGES} SELECT src, dst FROM edges WHERE src % 5 = 0 AND dst % 5 <> 0")
def coupling_backwards(spark, d):
    return edges(spark, d).where("src % 5 = 0 and dst % 5 != 0")


@query("q16_boundary_candidates", f"WITH {EDGES} SELECT dst AS node, min(src % 5) AS area, count(*) AS users FROM edges WHERE dst % 5 = 0 GROUP BY 1 HAVING count(DISTINCT src % 5) = 1")
def boundary_candidates(spark, d):
    by = edges(spark, d).where("dst % 5 = 0").groupBy(F.col("dst").alias("node"))
    return by.agg(F.min(F.col("src") % 5).alias("area"), F.max(F.col("src") % 5).alias("most"), F.count("*").alias("users")).where("area = most").drop("most")


@query("q17_cross_area", f"WITH {EDGES} SELECT src % 5 AS a, dst % 5 AS b, count(*) AS n FROM edges WHERE src % 5 <> dst % 5 GROUP BY 1, 2")
def cross_area(spark, d):
    return edges(spark, d).groupBy((F.col("src") % 5).alias("a"), (F.col("dst") % 5).alias("b")).agg(F.count("*").alias("n")).where("a != b")


@query("q45_test_coverage", f"WITH RECURSIVE {REACH}, c AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 10 = 0 THEN 'direct' WHEN s_suppkey IN (SELECT node FROM reach) THEN 'transitive' ELSE 'untested' END AS state, greatest(0, s_acctbal) AS loc FROM supplier) SELECT state, count(*) AS n, round(sum(least(sqrt(loc), 50)), 4) AS potential FROM c GROUP BY 1")
def test_coverage(spark, d):
    found = graph.reachable(edges(spark, d), nodes(spark, d).where("node % 10 = 0"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.greatest(F.lit(0.0), "s_acctbal").alias("loc")).join(found, "node", "left")
    state = F.when(F.col("depth") == 0, "direct").when(F.col("depth") > 0, "transitive").otherwise("untested")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.sum(loc_weight(F.col("loc"))), 4).alias("potential"))


@query("q50_uncalled", "SELECT p_partkey FROM part WHERE p_size <= 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def uncalled(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").where("p_size <= 10").select("p_partkey").join(used, "p_partkey", "left_anti")


USES = "u AS (SELECT DISTINCT user_id % 5 AS dir, user_id AS file, event_type || day(ts) % 4 AS item FROM events)"


@query("q51_sibling_outliers", f"WITH {USES}, s AS (SELECT dir, count(DISTINCT file) AS size FROM u GROUP BY 1), c AS (SELECT dir, item FROM (SELECT dir, item, count(*) AS n FROM u GROUP BY 1, 2) JOIN s USING (dir) WHERE n < size AND n * 100 >= size * 60) SELECT f.dir, f.file, c.item FROM (SELECT DISTINCT dir, file FROM u) f JOIN c USING (dir) ANTI JOIN u ON u.dir = f.dir AND u.file = f.file AND u.item = c.item")
def sibling_outliers(spark, d):
    u = table(spark, d, "events").select((F.col("user_id") % 5).alias("dir"), F.col("user_id").alias("file"), F.concat("event_type", (F.dayofmonth("ts") % 4).cast("string")).alias("item"))
    return census.sibling_outliers(u, u.select("dir", "file"))


@query("q55_events_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) > 6 * 3600 * 1_000_000
    g = table(spark, d, "events").select("user_id", "ts", F.coalesce(gap, F.lit(False)).cast("int").alias("n"))
    s = g.withColumn("k", F.sum("n").over(W.partitionBy("user_id").orderBy("ts")))
    return s.groupBy("user_id", "k").agg(F.min("ts").alias("start"), F.count("*").alias("events")).drop("k")


@query("q56_region_rollup", "SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    j = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    r = j.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return r.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "orders", "total")


@query("q57_topk_customers", "WITH t AS (SELECT c_nationkey, c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS place FROM t) SELECT c_nationkey, c_custkey, total, place FROM r WHERE place <= 3")
def topk_customers(spark, d):
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    t = sums.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))
    return t.withColumn("place", place).where("place <= 3").select("c_nationkey", "c_custkey", "total", F.col("place").cast("long").alias("place"))


@query("q58_asof_last_error", "WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, e.ts AS last_error FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts")
def asof_last_error(spark, d):
    ev = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    err = F.when(F.col("event_type") == "error", F.col("ts"))
    last = F.last(err, ignorenulls=True).over(W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0))
    return ev.select("event_id", "event_type", last.alias("last_error")).where("event_type = 'purchase'").drop("event_type")


@query("q59_interval_join", "SELECT a.event_id AS error_id, count(*) AS clicks FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 12 HOUR GROUP BY 1")
def interval_join(spark, d):
    hours = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (12 * 3600))
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("t"), F.explode(F.array(hours, hours + 1)).alias("slot"))
    b = e.where("event_type = 'click'").select("user_id", "ts", hours.alias("slot"))
    return a.join(b, ["user_id", "slot"]).where("ts >= t and ts < t + interval 12 hours").groupBy("error_id").agg(F.count("*").alias("clicks"))


@query("q60_stream_daily", "SELECT date_trunc('day', ts) AS start, event_type AS detector, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark, d):
    return stream.run(stream.daily(stream.source(spark, d)), spark).withColumn("start", F.col("start").cast("timestamp_ntz"))

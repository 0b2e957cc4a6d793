"""Queries over files and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions.scalar import naming_convention, share_percent, word_set
from corpuscle.operators import census, similarity, text
from corpuscle.operators.graph import connected_components
from corpuscle.plans.inputs import FILES, LINES, LISTS, files, lines
from corpuscle.plans.registry import query
from corpuscle.util import table

RULES = (("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"), ("hex40", r"[0-9a-f]{40}"), ("licence", "[Ll]icen"))
SIGNALS = ((",", 1, 20), ("[0-9]+", 2, 5), ("[?!]", 3, 2))
HITS = LINES + ", rules(rule, pat) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in RULES) + "), hits AS (SELECT file, area, no, rule FROM lines, rules WHERE regexp_matches(line, pat))"
SETS = FILES + ", sets AS (SELECT lang, ws, min(file) AS rep FROM (SELECT lang, file, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda x: x <> ''))) AS ws FROM files) WHERE len(ws) > 0 GROUP BY 1, 2), near AS (SELECT * FROM (SELECT a.rep AS a, b.rep AS b, CAST(len(list_intersect(a.ws, b.ws)) AS BIGINT) AS shared, CAST(len(a.ws) + len(b.ws) AS BIGINT) AS both_n FROM sets a JOIN sets b ON a.lang = b.lang AND a.rep < b.rep AND len(a.ws) * 100 >= len(b.ws) * 80 AND len(b.ws) * 100 >= len(a.ws) * 80) WHERE shared * 100 >= (both_n - shared) * 80)"


@query("q01_large_docs", f"WITH {LISTS} SELECT file, loc FROM sizes WHERE loc > 20")
def large_docs(spark, d):
    return text.loc(files(spark, d)).where("loc > 20").select("file", "loc")


@query("q02_complexity_score", f"WITH {FILES}, s AS (SELECT file, CAST({' + '.join(f'{w} * greatest(0, len(regexp_extract_all(content, {p!r})) - {t})' for p, w, t in SIGNALS)} AS BIGINT) AS score FROM files) SELECT * FROM s WHERE score >= 30")
def complexity_score(spark, d):
    return text.complexity(files(spark, d), SIGNALS).where("score >= 30").select("file", "score")


def hits(spark, d):
    return text.rule_hits(lines(spark, d), RULES)


@query("q03_line_rule_hits", f"WITH {HITS} SELECT file, no, rule FROM hits")
def line_rule_hits(spark, d):
    return hits(spark, d).select("file", F.col("no").cast("long").alias("no"), "rule")


@query("q04_smells_by_file", f"WITH {HITS} SELECT file, rule, count(*) AS n, list_aggregate(list_sort(list(no))[1:10], 'string_agg', ',') AS at FROM hits GROUP BY 1, 2")
def smells_by_file(spark, d):
    return text.by_file(hits(spark, d))


@query("q07_exact_dup_clusters", f"WITH {FILES} SELECT sha256(content)[1:16] AS hash, count(*) AS size, min(file) AS first FROM files GROUP BY 1 HAVING count(*) > 1")
def exact_dup_clusters(spark, d):
    return similarity.exact_clusters(files(spark, d))


def near(spark, d):
    return similarity.near_pairs(similarity.word_sets(files(spark, d), word_set(F.col("content"))), 80)


@query("q08_near_dup_pairs", f"WITH {SETS} SELECT a, b, shared, both_n - shared AS total FROM near")
def near_dup_pairs(spark, d):
    return near(spark, d)


@query("q09_dup_components", f"WITH RECURSIVE {SETS}, e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node) SELECT node, min(root) AS component FROM reach GROUP BY 1")
def dup_components(spark, d):
    return connected_components(near(spark, d).select("a", "b"))


@query("q18_naming_majority", """WITH n AS (SELECT p_brand AS dir, CASE p_partkey % 7 WHEN 0 THEN 'kebab' WHEN 1 THEN 'kebab' WHEN 2 THEN 'flat' ELSE 'snake' END AS convention FROM part WHERE position(' ' IN p_name) > 0),
 c AS (SELECT dir, convention, count(*) AS n FROM n GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY dir) AS total, first_value(convention) OVER (PARTITION BY dir ORDER BY n DESC, convention) AS majority FROM c)
 SELECT dir, convention, n, majority FROM m WHERE convention <> majority AND n >= 5 AND n * 100 >= total * 15""")
def naming_majority(spark, d):
    k, lower = F.col("p_partkey") % 7, F.lower("p_name")
    name = F.when(k <= 1, F.replace(lower, F.lit(" "), F.lit("-"))).when(k == 2, F.replace(lower, F.lit(" "), F.lit(""))).otherwise(F.replace(lower, F.lit(" "), F.lit("_")))
    parts = table(spark, d, "part").where(F.contains("p_name", F.lit(" ")))
    return census.naming_outliers(parts.select(F.col("p_brand").alias("dir"), naming_convention(name).alias("convention")))


@query("q20_flat_dirs", f"WITH {FILES} SELECT area, count(*) AS n_files, count(DISTINCT lang) AS n_dirs, CASE WHEN count(*) >= 50 AND count(DISTINCT lang) >= 4 THEN 'fragmented' WHEN count(*) >= 50 THEN 'overload' ELSE 'ok' END AS verdict FROM files GROUP BY 1")
def flat_dirs(spark, d):
    n = files(spark, d).groupBy("area").agg(F.count("*").alias("n_files"), F.countDistinct("lang").alias("n_dirs"))
    return n.withColumn("verdict", F.when((F.col("n_files") >= 50) & (F.col("n_dirs") >= 4), "fragmented").when(F.col("n_files") >= 50, "overload").otherwise("ok"))


@query("q21_pattern_census", f"WITH {HITS} SELECT area, rule, count(DISTINCT file) AS files FROM hits GROUP BY 1, 2")
def pattern_census(spark, d):
    return text.census(hits(spark, d))


@query("q22_pattern_outliers", f"WITH {HITS}, c AS (SELECT rule, count(DISTINCT area) AS areas FROM hits GROUP BY 1), t AS (SELECT count(DISTINCT area) AS n FROM files) SELECT rule, areas FROM c, t WHERE n >= 5 AND areas * 10 < n * 7")
def pattern_outliers(spark, d):
    return text.rare_patterns(text.census(hits(spark, d)), files(spark, d), 0.7)


@query("q47_quantiles_nearest_rank", f"WITH {LISTS}, r AS (SELECT lang, loc, row_number() OVER (PARTITION BY lang ORDER BY loc) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM sizes) SELECT lang, CAST(p AS BIGINT) AS percent, loc FROM r, (VALUES (50), (90), (99)) q(p) WHERE i = n * p // 100")
def quantiles(spark, d):
    return census.nearest_rank(text.loc(files(spark, d)), "lang", "loc").withColumn("percent", F.col("percent").cast("long"))


@query("q48_tree_rollup", f"WITH {LISTS} SELECT coalesce(CASE WHEN lang IS NULL THEN area ELSE area || '/' || lang END, '') AS dir, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM sizes GROUP BY ROLLUP (area, lang)")
def tree_rollup(spark, d):
    return census.tree(text.loc(files(spark, d)))


@query("q49_loc_share", f"WITH {LISTS}, a AS (SELECT area, CAST(sum(loc) AS BIGINT) AS loc FROM sizes GROUP BY 1), t AS (SELECT CAST(sum(loc) AS BIGINT) AS n FROM a) SELECT area, loc, loc * 20 > n AS large FROM a, t")
def loc_share(spark, d):
    sized = text.loc(files(spark, d))
    total = sized.agg(F.sum("loc").alias("n"))
    return sized.groupBy("area").agg(F.sum("loc").alias("loc")).crossJoin(F.broadcast(total)).select("area", "loc", (share_percent(F.col("loc"), F.col("n"), 6) > 5).alias("large"))


@query("q53_benchmark_containment", f"WITH {FILES} SELECT file, item_id FROM files, benchmark WHERE contains(content, text)")
def benchmark_containment(spark, d):
    return text.containing(files(spark, d), table(spark, d, "benchmark"))


@query("q54_line_signals", f"WITH {LINES}, s AS (SELECT file, count(*) AS n, count(*) FILTER (length(line) <= 20) AS short, count(*) FILTER (regexp_matches(line, '[0-9]')) AS numeric FROM lines GROUP BY 1) SELECT file, n, short, numeric FROM s WHERE short * 10 > n * 3 ORDER BY short DESC, file LIMIT 20")
def line_signals(spark, d):
    s = lines(spark, d).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.length("line") <= 20).alias("short"), F.count_if(F.col("line").rlike("[0-9]")).alias("numeric"))
    return s.where("short * 10 > n * 3").orderBy(F.desc("short"), "file").limit(20)


@query("q46_review_staleness", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN d.doc_id % 9 = 0 THEN 'changed' WHEN DATE '2024-03-01' - (DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER)) > 30 THEN 'stale' ELSE 'fresh' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def review_staleness(spark, d):
    seen = table(spark, d, "labels").select(F.col("doc_id").alias("seen")).distinct()
    docs = table(spark, d, "documents").select("doc_id").join(seen, F.col("doc_id") == F.col("seen"), "left")
    age = F.datediff(F.lit("2024-03-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")))
    return docs.select("doc_id", F.when(F.col("seen").isNull(), "unreviewed").when(F.col("doc_id") % 9 == 0, "changed").when(age > 30, "stale").otherwise("fresh").alias("state"))

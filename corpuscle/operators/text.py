"""Detectors over the lines and the text of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame) -> DataFrame:
    """(file, area, no, line) of every line, from 1; the empty piece behind a last line break is none. Null content has no lines."""
    parts = F.split("content", "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("file", "area", F.posexplode(whole).alias("at", "line")).select("file", "area", (F.col("at") + 1).alias("no"), "line")


def loc(files: DataFrame) -> DataFrame:
    """files with loc, their number of lines, counted without exploding."""
    breaks = F.length("content") - F.length(F.translate("content", "\n", ""))
    return files.withColumn("loc", F.when(F.coalesce(F.col("content"), F.lit("")) == "", 0).when(F.endswith("content", F.lit("\n")), breaks).otherwise(breaks + 1).cast("long"))


def rule_hits(text_lines: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(file, area, no, rule) for every line and rule (name, pattern) that finds something in it: one pass over the lines."""
    found = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())
    return text_lines.select("file", "area", "no", F.explode(found).alias("rule"))


def by_file(hits: DataFrame, first: int = 10) -> DataFrame:
    """(file, rule, n, at): hits counted, with the first line numbers joined by commas."""
    return hits.groupBy("file", "rule").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("no")), 1, first), ",").alias("at"))


def complexity(files: DataFrame, signals: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """files with score: the sum over signals (pattern, weight, threshold) of weight times what goes beyond the threshold."""
    parts = [F.greatest(F.lit(0), F.regexp_count("content", F.lit(p)) - threshold) * weight for p, weight, threshold in signals]
    return files.withColumn("score", F.coalesce(sum(parts[1:], parts[0]), F.lit(0)).cast("long"))


def census(hits: DataFrame) -> DataFrame:
    """(area, rule, files): in how many files of an area a pattern occurs."""
    return hits.groupBy("area", "rule").agg(F.countDistinct("file").alias("files"))


def rare_patterns(counts: DataFrame, areas: DataFrame, share: float, least_areas: int = 5) -> DataFrame:
    """(rule, areas): patterns in less than a share of all areas, if there are enough areas."""
    total = areas.select("area").distinct().agg(F.count("*").alias("_all"))
    used = counts.groupBy("rule").agg(F.count("*").alias("areas"))
    return used.crossJoin(F.broadcast(total)).where((F.col("_all") >= least_areas) & (F.col("areas") < F.col("_all") * share)).select("rule", "areas")


def containing(files: DataFrame, needles: DataFrame) -> DataFrame:
    """(file, item_id) where a file's content contains the needle (item_id, text).

    Candidates share the needle's longest inner word, which must be a whole word of
    the content too, so that this is an equi-join; needles of fewer than three words
    are compared with every file.
    """
    words = F.split("text", " ")
    cut = needles.select("item_id", F.col("text").alias("needle"), F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("inner"))
    anchored = cut.withColumn("w", F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    long_ones = anchored.where("w != ''").select("item_id", "needle", "w")
    own = files.select("file", "content", F.explode(F.array_distinct(F.split("content", " "))).alias("w"))
    wanted = own.join(F.broadcast(long_ones.select("w").distinct()) if long_ones.count() <= 100_000 else long_ones.select("w").distinct(), "w", "left_semi")
    met = wanted.join(long_ones, "w").where(F.contains("content", "needle")).select("file", "item_id")
    short = anchored.where("w is null or w = ''").select("item_id", "needle")
    return met.unionByName(files.join(short, F.contains("content", "needle")).select("file", "item_id"))

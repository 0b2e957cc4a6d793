"""Figures about directories, names and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def naming_outliers(names: DataFrame, least: int = 5, percent: int = 15) -> DataFrame:
    """(dir, convention, n, majority) of conventions other than a directory's largest that enough names follow.

    names: dir, convention (null: none). Equal counts: the first convention by name is the majority.
    """
    n = names.where("convention is not null").groupBy("dir", "convention").agg(F.count("*").alias("n"))
    w = W.partitionBy("dir")
    best = F.first("convention").over(w.orderBy(F.desc("n"), "convention"))
    out = n.withColumn("total", F.sum("n").over(w)).withColumn("majority", best)
    return out.where((F.col("convention") != F.col("majority")) & (F.col("n") >= least) & (F.col("n") * 100 >= F.col("total") * percent)).select("dir", "convention", "n", "majority")


def nearest_rank(rows: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(key, percent, value): of n sorted values that at floor(n q), from zero.

    Values are counted first, so a hot key's window holds its distinct values only.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(key).orderBy(value)
    placed = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(key)))
    marks = placed.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    rank = F.floor(F.col("_n") * F.col("percent") / 100)
    return marks.where((rank >= F.col("_to") - F.col("_c")) & (rank < F.col("_to"))).select(key, "percent", value)


def tree(files: DataFrame) -> DataFrame:
    """(dir, files, loc) of every directory above the files (file, loc), the root as an empty name: partial sums at each depth."""
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(dirs).alias("dir"), "loc").groupBy("dir").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def sibling_outliers(uses: DataFrame, files: DataFrame, percent: int = 60) -> DataFrame:
    """(dir, file, item): files without an item that a share of their directory's files uses.

    uses: dir, file, item; files: dir, file.
    """
    size = files.groupBy("dir").agg(F.countDistinct("file").alias("size"))
    common = uses.distinct().groupBy("dir", "item").agg(F.count("*").alias("n")).join(size, "dir").where("n < size").where(F.col("n") * 100 >= F.col("size") * percent).select("dir", "item")
    return files.select("dir", "file").distinct().join(common, "dir").join(uses.select("dir", "file", "item").distinct(), ["dir", "file", "item"], "left_anti")

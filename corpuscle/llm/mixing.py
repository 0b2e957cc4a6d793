"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality, kept as the increasing
1 - u^(1/quality). A source whose target is k times its size and a fraction more
gives k complete epochs first; the fraction takes the documents of least key while
their prefix sum fits the budget, then the one whose size is nearest to what is left
(so a long document at the edge does not carry a source far off). Prefix sums are two-level: sums of key ranges
of about RANGE documents first, then one window inside the single range where the
budget ends. No source is sorted by one task, and what a document is worth is
decided from its own columns and one row of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm.words import WORD
from corpuscle.util import pin, table

WEIGHTS, CEILING, RANGE, MANY_SOURCES, SALT = (5.0, 2.0, 1.0), 3, 20_000, 10_000, 20_011
TWO53 = float(1 << 53)


def size_of(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """A document's quality weight in [0.1, 1]: lower the more of its characters are markup signs."""
    share = F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * share), F.lit(1.0))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_row: bool = False) -> DataFrame:
    """(id, src, size, p, tie) of every row: p in [0, 1) orders the documents of a source, tie breaks equal keys.

    keep_row adds the whole row as a struct, so that no column name can clash.
    """
    text = F.col(text_col)
    u = (F.pmod(F.xxhash64(F.lit(SALT), F.col(id_col), text), F.lit(1 << 53)) + 0.5) / TWO53
    keys = [F.col(id_col).alias("id"), F.col(source_col).alias("src"), size_of(text).alias("size"), (1 - F.pow(u, 1 / quality_of(text))).alias("p"), F.xxhash64(F.lit(SALT + 1), F.col(id_col), text).alias("tie")]
    return docs.select(*[F.struct("*").alias("row")] * keep_row, *keys)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(src, source_size, n, target) from one row (src, source_size, n) a source.

    Sources by code point, null last, take the weights in turn and share the whole
    size; a target stops at ceiling times its source's size and the excess is
    reshared by weight. Sorted by ceiling per weight the stopped sources come
    first, so one pass of running sums finds the level of all others.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last()))).withColumn("w", w).withColumn("cap", F.col("source_size") * ceiling)
    by = W.orderBy(F.col("cap") / F.col("w"), "i")
    left = F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", left / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    free = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.withColumn("free", free).select("src", "source_size", "n", F.least(F.col("cap").cast("double"), F.coalesce(F.col("free") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """One row a source from rows of with_keys(): target, epochs, ranges, edge, cut_p, cut_tie."""
    sizes = pin(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    want = targets(sizes).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    want = pin(want.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n") / RANGE)), "targets")
    ranged = join_plan(rows, want).withColumn("range", F.floor(F.col("p") * F.col("ranges")))
    sums = ranged.groupBy("src", "range").agg(F.sum("size").alias("in_range"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("in_range").over(W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before + in_range > rest").groupBy("src").agg(F.min(F.struct("range", "before")).alias("e"))
    edge = pin(edge.select("src", F.col("e.range").alias("edge"), F.col("e.before").alias("before")), "edges")
    want = want.join(edge, want["src"].eqNullSafe(edge["src"]), "left").drop(edge["src"])
    inside = join_plan(rows, want).where("floor(p * ranges) = edge")
    run = F.coalesce(F.sum("size").over(W.partitionBy("src").orderBy("p", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("run", F.col("before") + run).where("run + size <= rest").groupBy("src").agg(F.max(F.struct("p", "tie")).alias("c"), F.max(F.col("run") + F.col("size")).alias("filled"))
    cut = cut.select("src", F.col("c.p").alias("cut_p"), F.col("c.tie").alias("cut_tie"), "filled")
    want = want.join(cut, want["src"].eqNullSafe(cut["src"]), "left").drop(cut["src"])
    want = pin(want.withColumn("gap", F.when(F.col("edge").isNotNull(), F.col("rest") - F.coalesce("filled", "before"))), "cuts")
    spare = join_plan(rows, want).where(~_drawn() & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    last = spare.groupBy("src").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "p", "tie")).alias("f"))
    last = last.select("src", F.col("f.p").alias("last_p"), F.col("f.tie").alias("last_tie"))
    return pin(want.join(last, want["src"].eqNullSafe(last["src"]), "left").drop(last["src"]), "plan")


def _drawn() -> Column:
    """True for a row of the prefix that fits the fraction's budget."""
    at = F.floor(F.col("p") * F.col("ranges"))
    within = (at == F.col("edge")) & ((F.col("p") < F.col("cut_p")) | ((F.col("p") == F.col("cut_p")) & (F.col("tie") <= F.col("cut_tie"))))
    return (F.col("rest") > 0) & (F.col("edge").isNull() | (at < F.col("edge")) | F.coalesce(within, F.lit(False)))


def join_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source. Few sources are broadcast after counting; more are shuffled with them."""
    few = sources.count() <= MANY_SOURCES
    s = sources.withColumnRenamed("src", "of")
    return rows.join(F.broadcast(s) if few else s, rows["src"].eqNullSafe(s["of"])).drop("of")


def times() -> Column:
    """How often the mix takes a row of join_plan()."""
    last = F.coalesce((F.col("p") == F.col("last_p")) & (F.col("tie") == F.col("last_tie")), F.lit(False))
    return (F.col("epochs") + (F.coalesce(_drawn(), F.lit(False)) | last).cast("long")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of docs, all its columns, as many times as the mix takes it.

    Rows of null or empty text weigh nothing and follow their key; a null source is
    a source; equal rows share one fate. An empty table gives an empty mix.
    """
    sources = plan(pin(with_keys(docs, id_col, text_col, source_col), "keys"))
    taken = join_plan(with_keys(docs, id_col, text_col, source_col, keep_row=True), sources).select("row", times().alias("times"))
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = pin(with_keys(table(spark, sf_dir, "documents")), "keys")
    out = join_plan(rows, plan(rows))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (times() * F.col("size")).alias("taken"))

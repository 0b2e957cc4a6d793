"""URL filter: the ratio of two character language models.

URLs that the rules allow and those that they block train one model each: an
interpolated (Witten-Bell) variable-order Markov model over the characters of host
and path, up to ORDER characters of context. A URL that no rule fits is judged by its
length-normalised log-likelihood difference against a threshold calibrated on the
rules' own URLs. Everything is DataFrame operations: characters are exploded once
into counted n-grams, shorter n-grams are summed from longer ones, and probabilities
are joined upwards, each order reading the one below. Distinct URLs are judged once,
however many pages carry them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.util import pin, table

ORDER, ALPHABET, BINS, SPAN, SMALL_TABLE = 4, 256, 2000, 10.0, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, STOP = "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    pattern = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits, of equal ones the first given; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(r.text)).otherwise(out)
    return out


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """Rows (t, n, good, bad, gram): every character of t with its context, padded at the start."""
    chars = F.split(F.concat(F.lit(START * order), F.col("t"), F.lit(STOP)), "")
    framed = texts.withColumn("_c", F.filter(chars, lambda x: x != ""))
    inner = F.slice("_c", 1, F.size("_c") - order)

    def at(x: Column, i: Column) -> Column:
        return F.concat(x, *[F.element_at(F.col("_c"), i + 1 + k) for k in range(1, order + 1)])

    return framed.select("t", "n", "good", "bad", F.explode(F.transform(inner, at)).alias("gram"))


def ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, llr): log probability under the good model minus that under the bad, of every distinct gram.

    grams: (gram, good, bad), the longest n-grams with their counts in both classes.
    """
    level = [None] * (order + 1)
    level[order] = grams
    for k in range(order - 1, -1, -1):
        level[k] = pin(level[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), f"grams{k}")
    below = None
    for k in range(order + 1):
        context = F.col("gram").substr(F.lit(1), F.lit(k))
        here = level[k].withColumn("context", context)
        sums = here.groupBy("context").agg(*[f(F.col(x)).alias(f"{x}_{y}") for x in ("good", "bad") for y, f in (("n", F.sum), ("kinds", lambda c: F.sum((c > 0).cast("long"))))])
        here = here.join(sums, "context")
        if k:
            here = here.withColumn("tail", F.col("gram").substr(F.lit(2), F.lit(k))).join(below.withColumnRenamed("gram", "tail"), "tail")
        else:
            here = here.withColumns({"good_p": F.lit(1 / ALPHABET), "bad_p": F.lit(1 / ALPHABET)})
        # a context that a class never had leaves its shorter one's probability as it is
        p = {x: F.when(F.col(f"{x}_n") > 0, (F.col(x) + F.col(f"{x}_kinds") * F.col(f"{x}_p")) / (F.col(f"{x}_n") + F.col(f"{x}_kinds"))).otherwise(F.col(f"{x}_p")) for x in ("good", "bad")}
        below = pin(here.select("gram", p["good"].alias("good_p"), p["bad"].alias("bad_p")), f"chances{k}")
    return below.select("gram", (F.log("good_p") - F.log("bad_p")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """The difference at which as large a share of good rows falls below as of bad rows does not.

    Read from a histogram of BINS bins over [-SPAN, SPAN], which bounds what comes to the driver.
    """
    width = 2 * SPAN / BINS
    at = F.floor((F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN - width / 2)) + SPAN) / width)
    bins = scored.where("good + bad > 0").groupBy(at.alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("bin").collect()
    good, bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    if not good or not bad:
        return -SPAN if good or not bad else SPAN
    best, low_good, low_bad = (2.0, 0.0), 0, 0
    for r in bins:
        best = min(best, (abs(low_good / good - (1 - low_bad / bad)), r.bin * width - SPAN))
        low_good, low_bad = low_good + r.good, low_bad + r.bad
    return best[1]


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, order: int = ORDER, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns keep of every row, with host, path, rule, verdict and score.

    Score is null where a rule decides. A URL without host and path that no rule
    fits is blocked. Where the rules allow or block no URL at all there is nothing
    to learn: if they block some, all others are blocked, else they are allowed.
    """
    host, path = parts(F.col(url_col))
    named = pages.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], host.alias("host"), path.alias("path")).withColumn("rule", fitting(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r.text for r in rules if r.allow])
    texts = named.groupBy(F.concat("host", "path").alias("t")).agg(F.count("*").alias("n"), F.count_if(allowed).alias("good"), F.count_if(F.col("rule").isNotNull() & ~allowed).alias("bad"))
    texts = pin(texts, "urls")
    each = pin(_grams(texts, order).groupBy("t", "n", "good", "bad", "gram").agg(F.count("*").alias("times")), "grams")
    model = pin(ratios(pin(each.groupBy("gram").agg(F.sum(F.col("good") * F.col("times")).alias("good"), F.sum(F.col("bad") * F.col("times")).alias("bad")), "counts"), order), "ratios")
    small = model.count() <= SMALL_TABLE
    scored = each.join(F.broadcast(model) if small else model, "gram").groupBy("t", "good", "bad").agg((F.sum(F.col("llr") * F.col("times")) / F.sum("times")).alias("score"))
    scored = pin(scored, "scored")
    cut = threshold(scored)
    free = scored.where("good + bad = 0").select("t", "score")
    by_rule = named.where("rule is not null").withColumns({"verdict": F.when(allowed, "allow").otherwise("block"), "score": F.lit(None).cast("double")})
    by_model = named.where("rule is null").withColumn("t", F.concat("host", "path")).join(free, "t", "left").drop("t")
    verdict = F.when((F.col("host") != "") | (F.col("path") != ""), F.when(F.col("score") >= cut, "allow")).otherwise(None)
    out = by_rule.unionByName(by_model.withColumn("verdict", F.coalesce(verdict, F.lit("block"))))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "host", "path", "rule", "verdict", "score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    return judge(table(spark, sf_dir, "pages"))

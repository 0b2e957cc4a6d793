"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE_TENTHS = {"high": 10, "medium": 7, "low": 3}


def confidence_tenths(confidence: Column) -> Column:
    """Ten times the scoring weight of a confidence; unknown ones count as medium."""
    out = F.lit(CONFIDENCE_TENTHS["medium"])
    for name, weight in CONFIDENCE_TENTHS.items():
        out = F.when(confidence == name, weight).otherwise(out)
    return out


def loc_weight(loc: Column) -> Column:
    """The square root of a line count, 50 at most."""
    return F.least(F.sqrt(loc.cast("double")), F.lit(50.0))


def slug(text: Column) -> Column:
    """Lower case with every run of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def area(path: Column, parts: int = 2) -> Column:
    """The first parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, parts), "/")


def naming_convention(name: Column) -> Column:
    """kebab, snake, pascal, camel or flat; null for names of no convention."""
    return (
        F.when(name.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(name.rlike("^[a-z0-9]+$"), "flat")
    )


def word_set(text: Column) -> Column:
    """Distinct words of ASCII letters, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), "")


def risk_level(loc: Column, importers: Column, complexity: Column) -> Column:
    """high, medium or low by a module's size, its importers and its complexity; nulls raise nothing."""
    high = F.coalesce(importers >= 10, F.lit(False)) | F.coalesce(complexity >= 20, F.lit(False)) | F.coalesce(loc >= 400, F.lit(False))
    medium = F.coalesce(importers >= 4, F.lit(False)) | F.coalesce(complexity >= 12, F.lit(False)) | F.coalesce(loc >= 200, F.lit(False))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def quality_threshold(risk: Column) -> Column:
    """The least test quality of a risk level."""
    return F.when(risk == "high", 0.60).when(risk == "medium", 0.50).otherwise(0.35)


def facade_tier(importers: Column) -> Column:
    """(tier, confidence) of a facade by its importers."""
    return F.when(importers <= 5, F.struct(F.lit(2).alias("tier"), F.lit("high").alias("confidence"))).when(importers <= 20, F.struct(F.lit(3).alias("tier"), F.lit("medium").alias("confidence"))).otherwise(F.struct(F.lit(4).alias("tier"), F.lit("medium").alias("confidence")))


def concern_fingerprint(kind: Column, file: Column, signals: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of kind, file and sorted signals; null if one is null."""
    return F.substring(F.sha2(F.concat(kind, F.lit("::"), file, F.lit("::"), F.array_join(F.array_sort(signals), ",")).cast("binary"), 256), 1, 16)


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two names differ by an edit or two, or by a plural s only."""
    return (F.levenshtein(a, b) <= 2) & (a != b) | (F.concat(a, F.lit("s")) == b) | (F.concat(b, F.lit("s")) == a)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, rounded half up in decimals; 0 of nothing."""
    exact = part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.coalesce(F.round(exact, digits).cast("double"), F.lit(0.0))


def near_target(score: Column, target: float, tolerance: float = 0.05) -> Column:
    """True within tolerance of a target; rounded first so that the edge is inside."""
    return F.round(F.abs(score - target), 6) <= tolerance


def status_of(alias: Column) -> Column:
    """Current name of a status; resolved was an older name of fixed."""
    return F.when(alias == "resolved", "fixed").otherwise(alias)

"""Predicates that select issues and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
PLACEHOLDERS = ("", "changeme", "xxx", "yyy", "zzz", "placeholder", "test", "example", "dummy", "none", "null", "undefined", "todo", "fixme")
PLACEHOLDER_STARTS = ("your-", "your_", "<", "${", "{{")
ENVIRONMENT = ("os.environ", "os.getenv", "process.env.", "import.meta.env", "os.environ.get(", "os.environ[")
RANKS = {"high": 0, "medium": 1, "low": 2}
IMPACT_FLOOR = 0.05


def matches_pattern(pattern: str, id: Column, detector: Column, file: Column) -> Column:
    """Whether an issue answers to a pattern: its id, a glob of it, a prefix with ::, its last eight hexadecimal digits, its detector, file or folder, or a segment of its id.

    Null columns answer to nothing; an empty pattern matches only an empty id.
    """
    tests = [id == pattern, detector == pattern, file == pattern, F.startswith(file, F.lit(pattern.rstrip("/") + "/")) if pattern.rstrip("/") else F.lit(False)]
    if "*" in pattern:
        tests.append(id.rlike("(?s)^" + ".*".join(f"\\Q{part}\\E" if part else "" for part in pattern.split("*")) + "$"))
    if "::" in pattern:
        tests.append(F.startswith(id, F.lit(pattern)))
    elif pattern:
        tests.append(F.array_contains(F.split(id, "::"), F.lit(pattern)))
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def placeholder(value: Column) -> Column:
    """Whether a value stands for a secret rather than being one: a known dummy, a dummy's beginning, or fewer than eight characters. Null for null."""
    low = F.trim(F.lower(value))
    out = low.isin(*PLACEHOLDERS) | (F.length(value) < 8)
    for start in PLACEHOLDER_STARTS:
        out = out | F.startswith(low, F.lit(start))
    return out


def comment_line(line: Column) -> Column:
    """Whether a line is a comment by its first characters: //, #, * or /*."""
    return F.ltrim(line).rlike(r"^(//|#|\*|/\*)")


def environment_lookup(line: Column) -> Column:
    """Whether a line reads an environment variable."""
    out = F.lit(False)
    for name in ENVIRONMENT:
        out = out | F.contains(line, F.lit(name))
    return out


def rank(confidence: Column, other: int = 9) -> Column:
    """0 for high to 2 for low, and other for what is unknown or null."""
    out = F.lit(other)
    for name, r in RANKS.items():
        out = F.when(confidence == name, r).otherwise(out)
    return out


def standalone(issues: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Issues at their detector's least confidence or above; thresholds: (detector, least), one row a detector, a registry of fixed size.

    Detectors without a threshold keep all; a null confidence ranks as low.
    """
    limit = thresholds.select(F.col("detector").alias("registry_detector"), rank(F.col("least")).alias("registry_rank"))
    joined = issues.join(limit, F.col("detector") == F.col("registry_detector"), "left")
    own = rank(F.coalesce("confidence", F.lit("low")))
    return joined.where(F.col("registry_rank").isNull() | (own <= F.col("registry_rank"))).drop("registry_detector", "registry_rank")


def above_floor(impact: Column, kept: Column, floor: float = IMPACT_FLOOR) -> Column:
    """Whether an item survives the impact floor: kept is true for reviews; no impact (null or 0) survives too."""
    return F.coalesce(kept, F.lit(False)) | F.coalesce(impact == 0, F.lit(True)) | (impact >= floor)


def by_stage(items: DataFrame, initial: Column, endgame: Column) -> DataFrame:
    """Items by the state of the whole queue: initial reviews alone while there are any, endgame items only when nothing else is left.

    The flags are one row of one aggregate, joined to all items.
    """
    flags = items.agg(F.coalesce(F.bool_or(initial), F.lit(False)).alias("any_initial"), F.coalesce(F.bool_or(~initial & ~endgame), F.lit(False)).alias("any_other"))
    shown = F.when(F.col("any_initial"), initial).when(F.col("any_other"), ~endgame).otherwise(F.lit(True))
    return items.crossJoin(F.broadcast(flags)).where(shown).drop("any_initial", "any_other")

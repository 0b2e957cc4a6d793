"""Zones of files, and what they do to issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (zone, kind, pattern), first match wins.
RULES = (
    ("test", "dir", "tests"),
    ("generated", "dir", "generated"),
    ("vendor", "dir", "vendor"),
    ("test", "prefix", "test_"),
    ("test", "suffix", "_test"),
    ("config", "exact", "settings"),
    ("script", "contains", "script"),
)
UNSCORED = ("test", "config", "generated", "vendor")


def matches(path: Column, kind: str, pattern: str) -> Column:
    """One of the shapes of a zone pattern: directory, file name prefix, stem suffix, exact stem, or substring."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    shapes = {
        "dir": lambda: F.array_contains(dirs, pattern),
        "prefix": lambda: F.startswith(name, F.lit(pattern)),
        "suffix": lambda: F.endswith(stem, F.lit(pattern)),
        "exact": lambda: stem == pattern,
        "contains": lambda: F.contains(path, F.lit(pattern)),
    }
    return shapes[kind]()


def zone_of(path: Column, rules: tuple = RULES, default: str = "production") -> Column:
    """The zone of the first rule that fits; null paths are of the default zone."""
    out = F.lit(default)
    for zone, kind, pattern in reversed(rules):
        out = F.when(matches(path, kind, pattern), zone).otherwise(out)
    return out


def drop_by_policy(issues: DataFrame, policy: DataFrame) -> DataFrame:
    """Issues less those of a (zone, detector) pair that the policy names."""
    return issues.join(policy.select("zone", "detector"), ["zone", "detector"], "left_anti")


def scored_potential(total: Column, outside: Column) -> Column:
    """A potential less the files outside scoring, never negative."""
    return F.greatest(total - outside, F.lit(0))


def stamp(issues: DataFrame, zones: DataFrame, doubtful: tuple[str, ...] = ("generated", "vendor")) -> DataFrame:
    """issues with the zone of their file; in doubtful zones confidence drops to low."""
    z = zones.select("file", F.col("zone").alias("_z"))
    out = issues.drop("zone").join(z, "file", "left").withColumn("zone", F.coalesce("_z", F.lit("production"))).drop("_z")
    return out.withColumn("confidence", F.when(F.col("zone").isin(*doubtful), "low").otherwise(F.col("confidence")))

"""Licence scans by a positional rare-token index.

Each licence notice is a template of words with mandatory key phrases. Of every
template's key words those of highest inverse document frequency, counted over the
whole corpus, are looked up in each file; places in the file minus places in the
template give the offsets at which a template may lie, and offsets on which two or
more of its rare words agree are verified: every word of the key phrases must stand
at its place, so no notice is lost, whatever others the file holds. The share of all
template words in place is the score. All of it is DataFrame operations; only files
that hold all words of some key phrase go on to the look-up.
"""

from __future__ import annotations

import string

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.util import pin, table

WORD, RARE, AGREE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 4, 2
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    """A licence notice; keys are phrases of it that must all be in place."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> list[int]:
        """Places of the key phrases' words."""
        out, w = set(), self.words
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            out |= set(range(at, at + len(k)))
        return sorted(out)


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
)


def file_words(text: Column) -> Column:
    """A text's words with A-Z in lower case and other letters as they are; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def vocabulary_by_rarity(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> list[str]:
    """The templates' words, rarest first, by the number of rows of docs that hold them: one count a word comes to the driver."""
    words = sorted({w for t in templates for w in t.words})
    held = docs.select(F.explode(F.array_intersect(_strings(words), file_words(F.col(text_col)))).alias("w"))
    df = {r.w: r["count"] for r in held.groupBy("w").count().collect()}
    return sorted(words, key=lambda w: (df.get(w, 0), w))


def _starts(words: Column, phrase: str) -> Column:
    """All places at which a phrase's words stand consecutively."""
    p = phrase.split()
    places = F.sequence(F.lit(0), F.size(words) - len(p))

    def stands(i: Column) -> Column:
        out = F.get(words, i) == p[0]
        for k in range(1, len(p)):
            out = out & (F.get(words, i + k) == p[k])
        return out

    return F.when(F.size(words) >= len(p), F.filter(places, stands))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words, no labels and score zero. Rows that repeat
    id and text share their result; no row is lost or doubled.
    """
    spark = docs.sparkSession
    ranked = vocabulary_by_rarity(docs, templates, text_col)
    keys = sorted({tuple(sorted({t.words[i] for i in t.mandatory})) for t in templates} | {tuple(sorted(set(p.split()))) for p in base})
    extra = sorted({w for k in keys for w in k} - set(ranked))
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = pair.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "id").alias("k2"), F.explode(F.array(file_words(F.col("text")))).alias("words"))
    rows = rows.select("*", F.explode(F.array(F.array_intersect(_strings(ranked + extra), F.col("words")))).alias("own"))
    gate = F.exists(_literal([list(k) for k in keys], "array<string>"), lambda k: F.size(F.array_except(k, F.col("own"))) == 0)
    rows = rows.withColumn("gated", gate)
    some = {p: F.when(F.col("gated"), _starts(F.col("words"), p)) for p in base}
    none = F.array().cast("array<int>")
    rows = rows.select("id", "k1", "k2", F.size("words").cast("long").alias("n_words"), *[F.coalesce(c, none).alias(f"b{i}") for i, c in enumerate(some.values())], F.when(F.col("gated"), F.col("words")).alias("words"))
    rows = pin(rows, "licence_words")
    gated = rows.where("words is not null").select("k1", "k2", "words")
    rare = [[w for w in ranked if w in {t.words[i] for i in t.mandatory}][:RARE] for t in templates]
    postings = [{"w": w, "t": n, "p": i, "r": rare[n].index(w), "need": min(AGREE, len(rare[n]))} for n, t in enumerate(templates) for i, w in enumerate(t.words) if w in rare[n]]
    index = spark.range(1).select(F.inline(_literal(postings, "struct<w:string,t:int,p:int,r:int,need:int>")))
    looked = _strings(sorted({w for r in rare for w in r}))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(looked, h["w"]))
    seen = gated.select("k1", "k2", F.explode(hits).alias("h")).select("k1", "k2", "h.*")
    agreed = seen.join(F.broadcast(index), "w").groupBy("k1", "k2", "t", "need", (F.col("i") - F.col("p")).alias("off"))
    votes = agreed.agg(F.bit_or(F.expr("shiftleft(1, r)")).alias("v")).where(F.bit_count("v") >= F.col("need"))
    found = votes.join(gated.select("k1", "k2", "words").dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    facts = _literal([{"l": t.label, "w": t.words, "m": t.mandatory} for t in templates], "struct<l:string,w:array<string>,m:array<int>>")
    found = found.withColumn("f", F.element_at(facts, F.col("t") + 1))
    placed = F.filter(F.sequence(F.lit(0), F.size("f.w") - 1), lambda j: F.coalesce(F.get("words", F.col("off") + j) == F.get("f.w", j), F.lit(False)))
    found = found.select("k1", "k2", "f", placed.alias("placed")).where(F.size(F.array_except("f.m", "placed")) == 0)
    found = found.groupBy("k1", "k2").agg(F.collect_set("f.l").alias("added"), F.max(F.size("placed") / F.size("f.w")).alias("share"))
    starts = F.concat(*[F.col(f"b{i}") for i in range(len(base))])
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, label in enumerate(base.values())]), lambda x: x.isNotNull())))
    out = rows.drop("words").withColumns({"starts": starts, "base": base_labels}).join(found, ["k1", "k2"], "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0)))
    return out.select("id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

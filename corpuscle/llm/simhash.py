"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is 64 bits; two fingerprints link at RADIUS = 2 or fewer
differing bits. Each fingerprint is cut into a left and a right half of 32 bits.
If two of them differ in two bits at most, then either the left halves differ in
one bit at most, or the right halves are equal. So every fingerprint probes the
left table with the Hamming ball of radius one around its left half and the right
table with its right half, and the complete distance of what it meets is verified.

Halves that many fingerprints share (more than CROWD) would meet each other in
all pairs. A fingerprint in such a crowd leaves the tables and probes with the
ball of radius two around itself instead, which meets true links only. No link is
lost either way, and no bucket is read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.words import batches, lower_words
from corpuscle.operators.graph import connected_components
from corpuscle.util import pin, table

RADIUS, CROWD, SHINGLE, SEED = 2, 48, 3, 42
#: Texts of a shared shingle that are all compared with each other at once in similar_texts(); more meet its first text first.
CELL = 8
#: For similar_texts(): shingle width, longs of a fingerprint, differing bits that a similarity of 0.8 does not reach
#: (six standard deviations from its mean) in all and in the first two longs, and shingles below which bits say little.
WIDE, LANES, FAR, LOOK, TINY = 5, 6, 100, 45, 32


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for one without words."""
    w = lower_words(text)
    if not w:
        return 0
    if len(w) <= width:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - width + 1]
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 18):
        part = h[at : at + (1 << 18)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            h = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(h.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(_fingerprints(width), f"id {pair.schema['id'].dataType.simpleString()}, fp long")


def _left(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _right(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def ball(some: DataFrame, fps: DataFrame) -> DataFrame:
    """(p, fp): the fingerprints of fps within two bits of each p of some, other than itself, by enumerating its ball."""
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    one = some.select(F.col("fp").alias("p"), F.posexplode(bits).alias("i", "x")).select("p", "i", F.col("p").bitwiseXOR(F.col("x")).alias("q"))
    rest = F.slice(bits, F.col("i") + 2, F.lit(64))
    two = one.select("p", F.explode(F.concat(F.array("q"), F.transform(rest, lambda x: F.col("q").bitwiseXOR(x)))).alias("fp"))
    return two.join(fps.select("fp"), "fp").select("p", "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs among distinct fingerprints (column fp) at RADIUS or fewer bits."""
    fps = fps.select("fp", _left(F.col("fp")).alias("l"), _right(F.col("fp")).alias("r"))
    full = [fps.groupBy(k).count().where(F.col("count") > CROWD).select(k) for k in ("l", "r")]
    crowded = pin(fps.join(full[0], "l", "left_semi").select("fp").unionByName(fps.join(full[1], "r", "left_semi").select("fp")).distinct(), "crowded")
    lone = pin(fps.join(crowded, "fp", "left_anti").select("fp", "l", "r"), "lone")
    bit = [F.lit(1 << i) for i in range(32)]
    # flipping only bits that are 0 finds each pair from one of its ends
    flips = F.filter(F.array(*[F.when(F.col("l").bitwiseAND(x) == 0, F.col("l").bitwiseOR(x)) for x in bit]), lambda x: x.isNotNull())
    probes = lone.select(F.col("fp").alias("p"), F.explode(F.concat(F.array("l"), flips)).alias("l"))
    out = [probes.join(lone.select("fp", "l"), "l").where(_near("p", "fp") & ((F.shiftrightunsigned("p", 32) != F.col("l")) | (F.col("p") < F.col("fp")))).select("p", "fp")]
    out += [lone.select(F.col("fp").alias("p"), "r").join(lone.select("fp", "r"), "r").where(_near("p", "fp") & (F.col("p") < F.col("fp"))).select("p", "fp")]
    out += [ball(crowded, fps)]
    pairs = out[0].unionByName(out[1]).unionByName(out[2])
    return pairs.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp, component): the smallest id that links reach from a row's fingerprint.

    Null and empty texts have fingerprint zero and link like any other. Rows of
    one fingerprint are one class, so copies are never paired; repeated rows stay.
    Rows with a null id keep their row and never name a component.
    """
    rows = pin(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = pin(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    joined = connected_components(links(classes.select("fp")))
    root = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = root.groupBy("root").agg(F.min("first").alias("least"))
    named = root.join(least, "root").select("fp", F.col("least").alias("component"))
    return rows.join(named, "fp", "left").select("id", "fp", "component")


def _wide(h: np.ndarray) -> np.ndarray:
    """A text's LANES * 64 fingerprint bits."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(LANES):
            x = h * np.uint64(2 * k + 0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            count = np.zeros(64, np.int64)
            for at in range(0, len(x), 1 << 16):
                count += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(2 * count > len(h))
    return np.concatenate(out)


def _shingles(w: list[bytes]) -> np.ndarray:
    """The distinct hashes of a word list's five-word shingles, as signed longs in order."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(w) - WIDE + 1)].tolist()
    stops = ends[WIDE - 1 :].tolist() or [len(joined)]
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts)).view(np.int64))


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        rows = []
        for text in batch.column(1).to_pylist():
            w = lower_words(text)
            if not w:
                rows.append((None, None, None, None))
                continue
            h = _shingles(w)
            bits = np.packbits(_wide(h.view(np.uint64)), bitorder="little").view(np.int64)
            # a set of similarity 0.8 shares four fifths of these shingles, so at least one of the first fifth and one more
            rows.append((xxhash.xxh3_128_digest(b" ".join(w)), bits.tolist(), len(h), h[: len(h) - (4 * len(h) + 4) // 5 + 1].tolist()))
        longs = pa.list_(pa.int64())
        yield pa.record_batch([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), longs, pa.int64(), longs))]], ["id", "cls", "bits", "n", "heads"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        words = [w for w in map(lower_words, batch.column(0).to_pylist()) if w]
        yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()), pa.array([_shingles(w).tolist() for w in words], pa.list_(pa.int64()))], ["cls", "shingles"])


def _apart(a: str, b: str, lanes: int = LANES) -> Column:
    """Differing bits of the first lanes of two wide fingerprints."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, lanes)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _alike(pairs: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose shingle sets have a Jaccard similarity of 0.8 or more; texts are rows (id, text)."""
    bits = names.select("c", "bits", "n")
    both = pairs.distinct().join(bits.select(F.col("c").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m")), "a").join(bits.select(F.col("c").alias("b"), F.col("bits").alias("y"), "n"), "b")
    near = pin(both.where((_apart("x", "y") <= FAR) | (F.least("m", "n") < TINY)).select("a", "b", "m", "n"), "near_texts")
    wanted = names.join(near.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    wanted = pin(wanted.select("c", "cls", F.col("first").alias("id")), "wanted_texts")
    sets = texts.join(wanted.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(_sets, "cls binary, shingles array<long>")
    sets = pin(sets.join(wanted.select("c", "cls"), "cls").select("c", "shingles").dropDuplicates(["c"]), "shingle_sets")
    both = near.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(5 * shared >= 4 * (F.col("m") + F.col("n") - shared)).select("a", "b")


def _met(some: DataFrame, rows: DataFrame, also: Column | None = None) -> DataFrame:
    """(a, b): pairs of some and rows (cell, c, n, at, k, root) of one cell that sizes, places and first bits let be similar."""
    other = rows.select("cell", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "at", "k", "root")])
    joined = some.select("cell", "c", "n", "at", "k", "root").join(other, "cell")
    # all shared shingles stand at the first shared one or behind it
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    fits = (F.col("c") != F.col("c2")) & (5 * most >= 4 * (F.col("n") + F.col("n2") - most))
    fits = fits & ((_apart("k", "k2", 2) <= LOOK) | (F.least("n", "n2") < TINY))
    return joined.where(fits if also is None else fits & also).select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))


def _copies(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of names that links of similarity 0.8 or more join."""
    heads = names.select("c", "n", F.slice("bits", 1, 2).alias("k"), F.posexplode("heads").alias("at", "cell"))
    w = Window.partitionBy("cell")
    heads = heads.withColumns({"held": F.count("*").over(w), "lead": F.min("c").over(w), "root": F.lit(None).cast("long")}).where("held > 1")
    heads = pin(heads, "shared_shingles")
    lone, crowd = heads.where(F.col("held") <= CELL), heads.where(F.col("held") > CELL)
    lead = crowd.where("c = lead")
    # a text meets its crowds' leads by name, once each, however many cells they share
    met = _met(lone, lone, F.col("c") < F.col("c2")).unionByName(crowd.where("c != lead").select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")))
    found = pin(_alike(met, names, texts), "copies")
    joined = pin(connected_components(found), "copy_groups")
    # in a crowd, who is joined with its lead need not meet who is too; all others meet all of other groups
    root = joined.select(F.col("node").alias("c"), F.col("component").alias("own"))
    of = crowd.drop("root").join(root, "c", "left").withColumn("root", F.coalesce("own", "c"))
    of = of.join(lead.select("cell", F.col("c").alias("lead")).join(root.withColumnRenamed("c", "lead"), "lead", "left").select("cell", F.coalesce("own", "lead").alias("led")), "cell")
    of = pin(of.select("cell", "c", "n", "at", "k", "root", "led"), "crowds")
    rest = of.where("root != led")
    if rest.isEmpty():
        return joined
    more = _alike(_met(rest, of, F.col("root") != F.col("root2")), names, texts)
    return connected_components(found.unionByName(more))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of rows whose five-word shingles have a Jaccard similarity of 0.8 or more with another's.

    Shingles are taken in the order of their hashes: two such sets share one of the
    first n - ceil(0.8 n) + 1 of each, so texts that share one of those are met.
    Of these, pairs of too many differing fingerprint bits (six longs of SimHash) are
    passed over, and the rest are verified by their shingle sets. In a cell that more
    than CELL texts share, all are compared with its first text, and then those of
    other groups with each other. Texts of the same words are one class. component is
    the smallest id of a group of two rows or more; rows without id or words are in
    no group.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pair = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = pin(pair.mapInArrow(_signatures, f"id {kind}, cls binary, bits array<long>, n long, heads array<long>").where("cls is not null"), "signatures")
    names = pin(sig.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.first(F.struct("bits", "n", "heads")).alias("s")).select("cls", F.xxhash64("cls").alias("c"), "first", "rows", "s.*"), "text_classes")
    joined = _copies(names, pair)
    root = names.select("cls", "c", "first", "rows").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("component", "c")).drop("component")
    least = root.groupBy("root").agg(F.min("first").alias("component"), F.sum("rows").alias("size")).where("size > 1")
    grouped = pin(root.join(least, "root").select("cls", "component"), "text_groups")
    return sig.select("id", "cls").join(grouped, "cls").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, less those of a similar_texts() group other than its smallest id's."""
    gone = pin(similar_texts(docs, id_col, text_col).where("id != component").select(F.col("id").alias("_gone")).distinct(), "near_copies")
    gone = F.broadcast(gone) if gone.count() <= 300_000 else gone
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"))
    return held.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

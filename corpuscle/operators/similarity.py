"""Copies and near-copies of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.scalar import content_hash
from corpuscle.operators.graph import connected_components
from corpuscle.operators.sieve import passes, sieve
from corpuscle.util import pin

#: Sizes of one class of word sets go up by this factor; words that are cut into parts at once.
CLASS, WORDS_AT_ONCE = 1.3, 1 << 18
#: Sets of a component that are compared with as many in one task.
BLOCK = 256
#: Quarter bits of a part that is worth a join and of a word that is none of the COMMON ones; parts of a set that need not agree, as a share of its differing words; longs of parities at most.
RICH, RARE, COMMON, SPARE, LONGS = 16, 64, 1 << 15, 0.25, 16


def exact_clusters(files: DataFrame) -> DataFrame:
    """(hash, size, first): contents that two or more files share."""
    return files.groupBy(content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("size"), F.min("file").alias("first")).where("size > 1")


def word_sets(files: DataFrame, of: Column) -> DataFrame:
    """(rep, grp, words, n): the distinct words of every file rep that has any."""
    return files.select(F.col("file").alias("rep"), F.col("lang").alias("grp"), F.array_sort(of).alias("words")).withColumn("n", F.size("words")).where("n > 0")


def _classes(most: int) -> np.ndarray:
    """Largest size of each class, as far as the class of a set of most words and the two above it."""
    out = [1]
    while len(out) < 3 or out[-3] < most:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS)))
    return np.array(out, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(k: np.ndarray, n: np.ndarray, h: np.ndarray, worth: np.ndarray, threshold: int) -> Iterator[tuple]:
    """(slot, k, n, own, row, bits, longs) of sets, for each class above their own that they may have a partner in."""
    tops = _classes(int(n.max()))
    at, row = np.searchsorted(tops, n), np.repeat(np.arange(len(n)), n)
    for up in range(len(tops)):
        cls = at + up
        fits = cls < len(tops)
        cls = np.minimum(cls, len(tops) - 1)
        if up:
            fits &= n * 100 >= (tops[cls - 1] + 1) * threshold
        differ = 2 * tops[cls] * (100 - threshold) // (100 + threshold)
        fits &= differ > 0
        if not fits.any():
            if up:
                break
            continue
        spare = np.floor(differ * SPARE).astype(np.int64)
        parts = np.where(fits, differ + 1 + spare, 0)
        base = np.cumsum(parts) - parts
        used = fits[row]
        r, w, value = row[used], h[used], worth[used]
        place = base[r] + (_mixed(w) % parts[r].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, place, w)
        rich = np.bincount(place, value, len(total)) >= RICH
        of = np.repeat(np.arange(len(n)), parts)
        # a pair agrees in more parts than are spare, so a set with no more poor ones, which many share, does without them
        out = rich | (np.bincount(of[~rich], minlength=len(n)) > spare)[of]
        own = np.arange(len(total)) - base[of]
        slot = _mixed(_mixed(_mixed(total + np.uint64(1)) ^ own.astype(np.uint64)) ^ cls[of].astype(np.uint64))
        longs = np.where(fits, np.clip(-(-3 * tops[cls] // 256), 2, LONGS), 0)
        first = np.cumsum(longs) - longs
        spot = first[r] * 64 + (_mixed(w ^ np.uint64(0x9E3779B97F4A7C15)) % (longs[r] * 64).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(spot, minlength=int(longs.sum()) * 64) & 1).astype(np.uint8)
        yield slot[out], k[of[out]], n[of[out]], up == 0, of[out], np.packbits(odd, bitorder="little").view("<i8"), longs


def _worths(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that many sets of a group have, in order, and what each is worth in quarter bits.

    They only tell which parts many sets share, so that one set in 16 is enough to count.
    """
    some = hashed.where("k % 16 = 0").select("g", "h")
    sets = some.groupBy("g").agg(F.count("*").alias("sets"))
    words = some.select("g", F.explode("h").alias("w")).groupBy("g", "w").agg(F.count("*").alias("df")).where("df > 1").join(sets, "g")
    rows = words.select("w", (F.col("df") / F.col("sets")).alias("share")).orderBy(F.desc("share"), "w").limit(COMMON).collect()
    w, share = np.array([x[0] for x in rows], np.int64).view(np.uint64), np.array([x[1] for x in rows], np.float64)
    order = np.argsort(w)
    return w[order], np.minimum(RARE, np.round(-4 * np.log2(share[order]))).astype(np.int64)


def _worth(words: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(common[0]):
        return np.full(len(words), RARE)
    at = np.minimum(np.searchsorted(common[0], words), len(common[0]) - 1)
    return np.where(common[0][at] == words, common[1][at], RARE)


def _parts(threshold: int, common: tuple[np.ndarray, np.ndarray], bits: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            i = 0
            while i < len(k):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + WORDS_AT_ONCE, "right")) - 1)
                some = words[ends[i] : ends[j]]
                for slot, name, n, own, row, odd, longs in _cut(k[i:j], np.diff(ends[i : j + 1]), some, _worth(some, common), threshold):
                    out = [pa.array(slot.view(np.int64)), pa.array(name), pa.array(np.full(len(name), own))]
                    if bits:
                        each = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(longs))), pa.int32()), pa.array(odd))
                        out += [pa.array(n.astype(np.int32)), each.take(pa.array(row))]
                    yield pa.record_batch(out, ["slot", "k", "own", "n", "bits"][: len(out)])
                i = j

    return run


def near_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, shared, total), a < b: pairs of a group's distinct sets, by their smallest reps, whose Jaccard similarity is threshold percent or more.

    Two such sets of n and m words differ in (n + m) (100 - t) / (100 + t) words at most.
    With the words dealt by hash into more parts than that, they agree in a part as a
    whole, so pairs are an equi-join on parts; a class of sizes has one number of parts.
    Each differing word changes one bit of a set's parities: pairs with too many changed
    bits leave within the join. All that is left is verified. Counts are exact.
    """
    sets = pin(sets.where("grp is not null").select("rep", "grp", "words", "n", F.xxhash64("grp", "words").alias("k")), "word_sets")
    hashed = sets.select("k", F.col("grp").alias("g"), F.transform("words", lambda w: F.xxhash64("grp", w)).alias("h"))
    common = _worths(hashed)
    hashed = hashed.select("k", "h")
    names = hashed.mapInArrow(_parts(threshold, common, False), "slot long, k long, own boolean")
    shared = pin(names.groupBy("slot").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("own").alias("own")).where("lo < hi and own").select("slot"), "shared_parts")
    rows = hashed.mapInArrow(_parts(threshold, common, True), "slot long, k long, own boolean, n int, bits array<long>")
    rows = passes(rows, "slot", sieve(shared)).where("may").drop("may").repartition("slot").join(shared, "slot", "left_semi")
    # copies have one k, and their rows are the same
    rows = rows.groupBy("slot", "k").agg(*[F.first(c).alias(c) for c in ("n", "own", "bits")])
    # both sides are named anew, so that one shuffle serves both
    one, other = (rows.select(*[F.col(c).alias(f"{c}{i}") for c in rows.columns]) for i in (1, 2))
    changed = F.aggregate(F.zip_with("bits1", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fit = (F.col("k1") < F.col("k2")) & (F.col("own1") | F.col("own2")) & (F.col("n1") * 100 >= F.col("n2") * threshold) & (F.col("n2") * 100 >= F.col("n1") * threshold)
    met = one.join(other, F.col("slot1") == F.col("slot2")).where(fit & (changed * (100 + threshold) <= (F.col("n1") + F.col("n2")) * (100 - threshold)))
    met = pin(met.select("k1", "k2").distinct(), "met")
    wanted = pin(met.select(F.explode(F.array("k1", "k2")).alias("k")).distinct(), "wanted")
    held = passes(sets, "k", sieve(wanted)).where("may").join(wanted, "k", "left_semi")
    held = pin(held.groupBy("k", "grp", "words").agg(F.min("rep").alias("rep")), "met_sets")
    return _verified(held, pin(connected_components(met, "k1", "k2"), "met_groups"), threshold)


def _verified(sets: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """near_pairs() of the sets (k, grp, rep, words) of each component (node, component).

    Words travel with the sets of a component, not with its pairs, in cells of BLOCK sets by BLOCK.
    """
    rows = sets.join(groups.withColumnRenamed("node", "k"), "k")
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = pin(rows.join(blocks, "component").select("component", "blocks", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("at"), "grp", "rep", "words"), "met_rows")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.withColumn("to", every).select(F.xxhash64("component", "at", "to").alias("cell"), F.col("component").alias("c1"), F.col("grp").alias("g1"), F.col("rep").alias("a"), F.col("words").alias("x"))
    other = rows.withColumn("to", every).select(F.xxhash64("component", "to", "at").alias("cell"), F.col("component").alias("c2"), F.col("grp").alias("g2"), F.col("rep").alias("b"), F.col("words").alias("y"))
    near = (F.size("x") * 100 >= F.size("y") * threshold) & (F.size("y") * 100 >= F.size("x") * threshold)
    both = one.join(other, "cell").where((F.col("a") < F.col("b")) & (F.col("c1") == F.col("c2")) & (F.col("g1") == F.col("g2")) & near)
    # the explode of one element keeps the intersection from being made again for each use
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.explode(F.array(F.size(F.array_intersect("x", "y")))).alias("both"))
    both = both.select("a", "b", F.col("both").cast("long").alias("shared"), (F.col("sum") - F.col("both").cast("long")).alias("total"))
    return both.where(F.col("shared") * 100 >= F.col("total") * threshold)

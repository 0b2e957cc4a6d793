"""Embedding near-duplicates by E8 lattice hashing.

Each of TABLES random projections takes a unit vector to eight dimensions, where it
is decoded to the nearest point of the E8 lattice: its home cell. It is listed there,
and looks for others in its home cell and the PROBES neighbouring cells nearest to
it. A pair that meets is compared by sign sketches first, which spares vectors of
pairs that cannot link from being moved, and then by its exact cosine.

Vectors with equal components are one class, so copies are never paired with each
other; what a class links to counts once for each of its members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.graph import connected_components
from corpuscle.util import pin, table

COSINE, TABLES, PROBES, SCALE, SEED, SKETCH_BITS = 0.95, 5, 8, 8.0, 8, 21


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    f = np.rint(x)
    odd = np.flatnonzero(np.mod(f.sum(axis=1), 2) != 0)
    d = (x - f)[odd]
    k = np.abs(d).argmax(axis=1)
    f[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points to rows of eight numbers."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dim: int, tables: int = TABLES, scale: float = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table the projection and the shift; fewer than eight dimensions are padded with zeros."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(tables):
        q = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
        out.append((q * scale * np.sqrt(max(dim, 8) / 64), rng.uniform(-1, 1, 8)))
    return out


def _cells(tables: int, probes: int, scale: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, mix = minimal_vectors(), np.random.default_rng(SEED).integers(1, 1 << 62, 9, dtype=np.int64) | 1
        for batch in it:
            if not batch.num_rows:
                continue
            dims = np.array(batch.column(1).value_lengths())
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                v = x[(ends[rows] - dim)[:, None] + np.arange(dim)]
                v = v / np.linalg.norm(v / np.abs(v).max(axis=1)[:, None], axis=1)[:, None] / np.abs(v).max(axis=1)[:, None]
                planes = np.random.default_rng([SEED + 1, dim]).normal(size=(dim, 64))
                sketch = np.packbits(v @ planes > 0, axis=1, bitorder="little").view(np.int64).reshape(-1)
                found = []
                for t, (q, shift) in enumerate(projections(dim, tables, scale)):
                    y = v @ q + shift
                    home = nearest(y)
                    close = np.argsort(-((y - home) @ steps.T), axis=1, kind="stable")[:, :probes]
                    for point in [home, *(home + steps[close[:, k]] for k in range(close.shape[1]))]:
                        with np.errstate(over="ignore"):
                            found.append((np.rint(2 * point).astype(np.int64) * mix[:8]).sum(axis=1) + mix[8] * (t * 10_007 + dim))
                cells = np.stack(found, axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1)))
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(sketch), lists], ["cls", "sketch", "cells"])

    return run


def usable(v: Column) -> Column:
    """True for vectors that can link: no null, all components finite, not all zero."""
    x = F.transform(v, lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def _scaled(v: Column) -> Column:
    """A vector over its largest component, so that no square underflows or overflows."""
    top = F.array_max(F.transform(v, lambda c: F.abs(c.cast("double"))))
    return F.element_at(F.transform(F.array(top), lambda t: F.transform(v, lambda c: c.cast("double") / t)), 1)


def _cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors as scaled by _scaled()."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def links(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """(a, b), a < b: pairs of classes (cls, v) found with at least that cosine."""
    kind = classes.select("cls", F.col("v").cast("array<double>").alias("v"))
    cells = pin(kind.mapInArrow(_cells(tables, probes, scale), "cls long, sketch long, cells array<long>"), "cells")
    each = cells.select("cls", "sketch", F.posexplode("cells").alias("nth", "cell"))
    home = each.where(F.col("nth") % (probes + 1) == 0).select("cell", F.col("cls").alias("b"), F.col("sketch").alias("s"))
    met = each.join(home, "cell").where((F.col("cls") != F.col("b")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("s"))) <= SKETCH_BITS))
    pairs = met.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    scaled = pin(classes.select("cls", _scaled(F.col("v")).alias("v")), "scaled")
    one = pairs.join(scaled.select(F.col("cls").alias("a"), F.col("v").alias("x")), "a")
    both = one.join(scaled.select(F.col("cls").alias("b"), F.col("v").alias("y")), "b")
    return both.where((F.size("x") == F.size("y")) & (_cosine(F.col("x"), F.col("y")) >= cosine)).select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component, kept) of every row.

    Unusable vectors and rows with a null id link with nothing: no links, their own
    component. Vectors of different lengths never link. Equal rows count as copies.
    """
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    rows = pin(raw.select("id", "v", F.when(F.col("id").isNotNull() & usable(F.col("v")), F.xxhash64("v")).alias("cls")), "vectors")
    classes = pin(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    found = pin(links(classes.select("cls", "v"), cosine), "links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    root = classes.select("cls", "first", "n").join(connected_components(found).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls")).drop("component")
    least = root.groupBy("root").agg(F.min("first").alias("component"))
    named = pin(root.join(least, "root").join(linked, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component"), "named")
    out = rows.select("id", "cls").join(named, "cls", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").cast("long").alias("component_id"), "kept")

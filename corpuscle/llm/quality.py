"""Quality rules: hashed n-gram logistic regression over fixed counts.

Words, word pairs and trigrams of characters of a text are hashed to relative frequencies;
a logistic regression trained on labelled rows scores them, its output calibrated
on rows held out of the training. Training takes at most PER_CLASS labelled rows
of each class, those of least hash, which bounds the driver's work; scoring reads
every whole text in Arrow batches.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.words import batches, words
from corpuscle.util import table

PER_CLASS, BITS, THRESHOLD, LEAST_WORDS = 2000, 15, 0.5, 50
DIM = 3 << BITS
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Vocabulary(dict):
    """Numbers for the words of one batch, with their hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.crcs = array("I")

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.crcs.append(zlib.crc32(word))
        return at

    def ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.crcs, np.uint32)[ids] if len(ids) else np.zeros(0, np.uint32)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that a text holds twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    local = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    wide = int(local.max()) + 1
    pair = local[:-1] * wide + local[1:]
    if wide >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, back, seen = np.unique(pair[:-1] * wide + local[2:], return_inverse=True, return_counts=True)
    again = seen[back] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= again
    return int(mark.sum())


def counts(text: str | None, found: list[bytes], ids: np.ndarray) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; zeros for null."""
    if not text:
        return (0,) * 5
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids))


def positions(text: str | None, hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Hashed feature numbers of a text by family, each with its count."""
    mask = np.uint32((1 << BITS) - 1)
    pairs = (hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    b = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.zeros(0, np.uint32)
    tri = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS) if len(b) > 2 else b[:0]
    return [(x, max(len(x), 1)) for x in (hashes & mask, pairs + np.uint32(1 << BITS), tri + np.uint32(2 << BITS))]


@dataclass
class Model:
    """Weights over hashed features, a bias, and Platt's scale and shift."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, text: str | None, hashes: np.ndarray) -> float:
        return self.bias + sum(float(self.weights[x].sum(dtype=np.float64)) / n for x, n in positions(text, hashes))

    def chance(self, margin: float) -> float:
        """The calibrated chance that a text is of good quality."""
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -60, 60))))


def _sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        rows = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.fromiter(map(zlib.crc32, words(text)), np.uint32)
            x = np.zeros(DIM, np.float32)
            for at, n in positions(text, h):
                x += np.bincount(at, minlength=DIM).astype(np.float32) / n
            at = np.flatnonzero(x)
            rows.append((label, at.astype(np.int32).tobytes(), x[at].tobytes()))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["label", "at", "x"])


def _steps(at: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression with a small ridge, by Adam over all rows."""
    w, b = np.zeros(DIM + 1), 0.0
    m, v = np.zeros(DIM + 1), np.zeros(DIM + 1)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for t in range(1, rounds + 1):
        z = np.bincount(row, x * w[at], len(y)) + w[DIM]
        err = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.concatenate((np.bincount(at, x * err[row], DIM), [err.sum()])) + 1e-7 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 1.0 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    b = float(w[DIM])
    return w[:DIM], b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that calibrate margins, by Newton steps on smoothed targets; equal weight to both classes."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        g = np.array([(s * (p - t) * z).sum() + 1e-3 * (a - 1), (s * (p - t)).sum()])
        h = s * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, c = max(0.05, a - float(np.clip(step[0], -1, 1))), c - float(np.clip(step[1], -1, 1))
    return a, c


def _fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (weights, bias, scale, shift) from all labelled rows; none if a class has none."""
    got = [r for batch in it for r in batch.to_pylist()]
    y = np.array([r["label"] for r in got], float)
    if not got or y.min() == y.max():
        return
    n = [len(r["at"]) // 4 for r in got]
    at, x = (np.concatenate([np.frombuffer(r[k], t) for r in got]) for k, t in (("at", np.int32), ("x", np.float32)))
    got = None
    row = np.repeat(np.arange(len(y)), n)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        held[:] = False
    use = ~held[row]
    w, b = _steps(at[use], x[use].astype(float), (np.cumsum(~held) - 1)[row[use]], y[~held])
    z = np.bincount(row, x * w[at], len(y)) + b
    a, c = _platt(z[held], y[held]) if held.any() else (1.0, 0.0)
    yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (b, a, c))], ["weights", "bias", "scale", "shift"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from at most per_class labelled rows of each class; None if a class has none.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 poor; other rows and null
    ids are ignored). A document with both labels is no example; one with several
    texts counts with its first by hash. All of them are fitted in one task of an
    executor, at most twice per_class rows, and only the weights come to the driver.
    """
    order = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
    known = known.where("label = other")
    picked = None
    for q in (0, 1):
        one = known.where(F.col("label") == q).select("doc_id", "label").orderBy(order, "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # repeated rows are told apart by hash first, so that no more than one text of a document is featured
    text = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"))
    sparse = text.select("label", "t.text").mapInArrow(_sparse, "label int, at binary, x binary")
    rows = sparse.repartition(1).sortWithinPartitions(F.xxhash64("at", "x"), "label").mapInArrow(_fit, "weights binary, bias double, scale double, shift double").collect()
    return Model(np.frombuffer(rows[0].weights, np.float32), rows[0].bias, rows[0].scale, rows[0].shift) if rows else None


def _judged(model: Model | None, texts: list[str | None]) -> Iterator[tuple]:
    """Of each text: the five counts, base_failed, kept, chance."""
    vocabulary = Vocabulary()
    for text in texts:
        found = words(text)
        ids = vocabulary.ids(found)
        c = counts(text, found, ids)
        failed = c[0] < LEAST_WORDS or 100 * c[4] > 50 * c[0]
        p = 1.0 if model is None else model.chance(model.margin(text, vocabulary.hashes(ids)))
        yield (*c, failed, not failed and p >= THRESHOLD, p)


JUDGED = "id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chance double"


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five counts, base_failed, kept, chance) of every row.

    Null and empty texts have no words and fail the base rules. Without a model
    (no labelled rows of both classes) the base rules alone decide.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and astuple(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2 << 20):
            cols = list(zip(*_judged(sent.value and Model(*sent.value), batch.column(1).to_pylist()), strict=True))
            yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()], strict=True))], names)

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", *COUNTS, "base_failed", "kept", "chance"]
    return pair.mapInArrow(run, JUDGED.format(pair.schema["id"].dataType.simpleString()))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model and astuple(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2 << 20):
            kept = [x[6] for x in _judged(sent.value and Model(*sent.value), batch.column(0).to_pylist())]
            yield pa.record_batch([batch.column(1).filter(pa.array(kept))], ["row"])

    pair = docs.select(F.col(text_col).alias("text"), F.struct("*").alias("row"))
    return pair.mapInArrow(run, T.StructType([pair.schema["row"]])).select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumnRenamed("id", "doc_id")

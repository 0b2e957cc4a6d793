"""Language-model scoring with an Elias-Fano trie of words and word pairs.

Words are known by their 64-bit hash. Level one of the trie is the sorted hashes
with counts and quantised log probabilities; a word's number is its place. Level two
has, for each context word, the words seen after it: an Elias-Fano list of contexts,
monotone pointers to their ranges, and the successors' numbers counted from the last
number of the range before, found by successor search inside the range. Both levels
are files in the shared folder that workers map into memory, cut into shards whose
number grows with the training tokens.

Probabilities are Dirichlet-smoothed: p(w|c) = (n(c,w) + KAPPA p(w)) / (n(c) + KAPPA)
with p(w) = (n(w) + 1) / (N + V + 1). The context of a text's first token is the end
token. A pair's shard follows from its context; a context with more than a shard's
share of the tokens is spread over several by its successors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.eliasfano import EliasFano, get, load, put, save
from corpuscle.llm.words import batches, lower_words
from corpuscle.util import fresh_path, pin, table

KAPPA, STEP, SHARD_TOKENS, SHARD_WORDS, PAIRS, END = 20.0, 1 / 1024, 2_000_000, 2_000_000, 3_000_000, b"\n"
U = np.uint64


def key(word: bytes) -> int:
    """A word's hash, unsigned; the end token is a word that no text holds."""
    return xxhash.xxh64_intdigest(word)


def held_out(doc_id: Column) -> Column:
    """True for documents that are not learnt from. A null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        h = np.fromiter(map(key, seen), U, len(seen)).view(np.int64)
        return pa.record_batch([pa.array(h), pa.array(list(seen.values()), pa.int64())], ["h", "c"])

    seen: Counter = Counter()
    for batch in batches(it):
        for text in batch.column(0).to_pylist():
            seen.update(lower_words(text))
            seen[END] += 1
        if len(seen) > 1_000_000:
            yield flush()
            seen.clear()
    if seen:
        yield flush()


def _code(p: np.ndarray) -> np.ndarray:
    """Quantised -log10 of probabilities."""
    return np.round(-np.log10(p) / STEP).astype(np.uint16)


def _column(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def _build_words(folder: str, tokens: int, kinds: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_column(b, 0), _column(b, 1)) for b in it if b.num_rows]
        if not parts:
            return
        # h comes sorted as a signed number; the sign bit turned makes it unsigned in the same order
        h = np.concatenate([p[0] for p in parts]).view(U) ^ U(1 << 63)
        c = np.concatenate([p[1] for p in parts])
        path = f"{folder}/words-{int(h[0]):016x}.bin"
        save(path, put("keys", EliasFano.build(h)) | {"counts": c.astype(np.int64 if c.max() >> 31 else np.int32), "codes": _code((c + 1) / (tokens + kinds + 1))})
        yield pa.record_batch([pa.array([h[0]], pa.uint64()).view(pa.int64()), pa.array([len(h)], pa.int64()), pa.array([path])], ["first", "n", "path"])

    return run


class Trie:
    """The mapped files: word look-ups, pair look-ups and the shard of a pair."""

    def __init__(self, words: list[tuple[int, int, str]], pairs: dict[int, str], tokens: int, kinds: int, shards: int) -> None:
        self.firsts = np.array([w[0] for w in words], U)
        self.bases = np.concatenate(([0], np.cumsum([w[1] for w in words]))).astype(np.int64)
        self.word_paths, self.pair_paths, self.open = [w[2] for w in words], pairs, {}
        self.tokens, self.kinds, self.shards = tokens, kinds, shards

    def _file(self, path: str) -> dict:
        if path not in self.open:
            a = load(path)
            self.open[path] = {p: get(p, a) for p in {x.split(".")[0] for x in a if "." in x}} | {k: v for k, v in a.items() if "." not in k}
        return self.open[path]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes (unsigned); -1 for words that were not learnt."""
        h = h ^ U(1 << 63)
        out = np.full(len(h), -1, np.int64)
        shard = np.searchsorted(self.firsts, h, side="right") - 1
        for s in np.unique(shard[shard >= 0]).tolist():
            at = np.flatnonzero(shard == s)
            i, equal = self._file(self.word_paths[s])["keys"].successor(h[at])
            out[at[equal]] = i[equal] + self.bases[s]
        return out

    def facts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and codes of word numbers; 0 and the code of an unknown word for -1."""
        c, q = np.zeros(len(ids), np.int64), np.full(len(ids), _code(np.array([1 / (self.tokens + self.kinds + 1)]))[0], np.int64)
        shard = np.where(ids < 0, -1, np.searchsorted(self.bases, ids, side="right") - 1)
        for s in np.unique(shard[shard >= 0]).tolist():
            at = np.flatnonzero(shard == s)
            f, i = self._file(self.word_paths[s]), ids[at] - self.bases[s]
            c[at], q[at] = f["counts"][i], f["codes"][i]
        return c, q

    def shard(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A pair's shard; count is the context's."""
        spread = np.maximum(1, -(-count * self.shards // max(self.tokens, 1)))
        mix = (word.astype(U) * U(0x9E3779B97F4A7C15) >> U(33)).astype(np.int64)
        return (context + mix % spread) % self.shards

    def pairs(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Codes of known pairs (numbers, context's count); -1 for pairs that were not learnt."""
        out = np.full(len(word), -1, np.int64)
        if not len(word):
            return out
        shard = self.shard(context, word, count)
        order = np.lexsort((context, shard))
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, path in self.pair_paths.items():
            at = order[ends[s] : ends[s + 1]]
            if not len(at):
                continue
            f = self._file(path)
            own, back = np.unique(context[at], return_inverse=True)
            i, known = f["contexts"].successor(own.astype(U))
            i = np.where(known, i, 0)
            start, stop = f["starts"].access(i).astype(np.int64), f["starts"].access(i + 1).astype(np.int64)
            base = np.where(start > 0, f["words"].access(np.maximum(start - 1, 0)) + U(1), U(0))
            use = known[back]
            at, back = at[use], back[use]
            j, equal = f["words"].successor(base[back] + word[at].astype(U))
            equal &= j < stop[back]
            out[at[equal]] = f["codes"][j[equal]]
        return out


def _numbered(trie: Trie, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a batch's texts in turn: place among the distinct words; of these: numbers, counts, codes."""
    seen: dict[bytes, int] = {END: 0}
    put_in, tokens = seen.setdefault, []
    for text in texts:
        tokens.extend([put_in(w, len(seen)) for w in lower_words(text)])
        tokens.append(0)
    ids = trie.numbers(np.fromiter(map(key, seen), U, len(seen)))
    return np.array(tokens, np.int64), ids, *trie.facts(ids)


def _contexts(tokens: np.ndarray) -> np.ndarray:
    """Each token's context: the one before; texts end in the end token, so the next text's first token has it."""
    return np.concatenate((np.zeros(1, np.int64), tokens[:-1]))


def _pack(a: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers by significance, compressed."""
    return pa.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


PIECE = "shard long, n long, steps binary, words binary, counts binary"


def _count_pairs(args: tuple):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*args)

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            context, word = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)
            shard = trie.shard(context, word, trie.facts(context)[0])
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(trie.shards + 1))
            rows = []
            for s in range(trie.shards):
                at = order[ends[s] : ends[s + 1]]
                if len(at):
                    rows.append((s, len(at), _pack(np.diff(context[at], prepend=0)), _pack(word[at]), _pack(np.minimum(n[at], 0xFFFFFFFF))))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["shard", "n", "steps", "words", "counts"])

        held, size = [], 0
        for batch in batches(it):
            tokens, ids, _, _ = _numbered(trie, batch.column(0).to_pylist())
            held.append((ids[_contexts(tokens)].astype(U) << U(32)) | ids[tokens].astype(U))
            size += len(tokens)
            if size >= PAIRS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _build_pairs(args: tuple, folder: str):
    def run(rows: pa.Table) -> pa.Table:
        shard, keys, counts = rows["shard"][0].as_py(), [], []
        for r in rows.to_pylist():
            keys.append((np.cumsum(_unpack(r["steps"], r["n"])).astype(U) << U(32)) | _unpack(r["words"], r["n"]).astype(U))
            counts.append(_unpack(r["counts"], r["n"]))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n, keys = np.add.reduceat(counts[order], first), keys[first]
        context, word = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        trie = Trie(*args)
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
        base = np.concatenate(([0], np.cumsum(word[np.append(starts[1:], len(word)) - 1] + 1)))[own]
        total, _ = trie.facts(context)
        _, q = trie.facts(word)
        code = _code((n + KAPPA * 10 ** (-q * STEP)) / (total + KAPPA))
        path = f"{folder}/pairs-{shard}-{xxhash.xxh64_hexdigest(keys.tobytes())}.bin"
        save(path, put("contexts", EliasFano.build(context[starts])) | put("starts", EliasFano.build(np.append(starts, len(word)))) | put("words", EliasFano.build(word + base)) | {"codes": code})
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": pa.array([path])})

    return run


SCORES = "id {}, n_tokens long, n_known long, base_score double, score double"


def _score(args: tuple):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*args)
        for batch in batches(it, 4 << 20):
            tokens, ids, counts, codes = _numbered(trie, batch.column(1).to_pylist())
            context = _contexts(tokens)
            c, q = counts[tokens], codes[tokens]
            total = counts[context]
            base = np.log10((c + 1) / (trie.tokens + trie.kinds + 1))
            seek = np.flatnonzero((c > 0) & (total > 0))
            own, back = np.unique(context[seek] * len(ids) + tokens[seek], return_inverse=True)
            left, right = own // len(ids), own % len(ids)
            found = trie.pairs(ids[left], ids[right], counts[left])[back]
            score = np.log10(KAPPA / (total + KAPPA)) - q * STEP
            score[seek] = np.where(found >= 0, -found * STEP, score[seek])
            ends = np.flatnonzero(tokens == 0)
            starts = np.concatenate(([0], ends[:-1] + 1))
            yield pa.record_batch([batch.column(0), pa.array(ends - starts + 1), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def train(texts: DataFrame) -> tuple:
    """The arguments of a Trie over a table with the one column text; a null text is empty."""
    spark = texts.sparkSession
    folder = fresh_path(spark, "trie")
    counts = pin(texts.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not tokens:
        return [], {}, 0, 0, 1
    parts = max(1, -(-kinds // SHARD_WORDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kinds // 100_000)))
    built = pin(counts.repartitionByRange(parts, "h").sortWithinPartitions("h").mapInArrow(_build_words(folder, tokens, kinds), "first long, n long, path string"), "words")
    words = sorted((r.first % (1 << 64), r.n, r.path) for r in built.collect())
    shards = -(-tokens // SHARD_TOKENS)
    args = words, {}, tokens, kinds, shards
    pieces = texts.select("text").mapInArrow(_count_pairs(args), PIECE)
    pairs = pin(pieces.groupBy("shard").applyInArrow(_build_pairs(args, folder), "shard long, path string"), "pairs")
    return words, {r.shard: r.path for r in pairs.collect()}, tokens, kinds, shards


def score(docs: DataFrame, trained: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; null and empty texts are the end token alone."""
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(_score(trained), SCORES.format(pair.schema["id"].dataType.simpleString()))


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    trained = train(docs.where(~held_out(F.col("doc_id"))).select("text"))
    out = score(docs, trained)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(trained[2])).cast("long").alias("train_tokens"), "base_score", "score")

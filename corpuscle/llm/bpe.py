"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern, each match is encoded on its own. The
matches of a block of rows are reduced to distinct words. A word that is a token is
that token; of others a heap gives the next merge, the lowest rank among neighbouring
pieces, the leftmost first. A worker keeps the ids of the first KEPT words it meets,
which most of a text is made of, for all blocks that follow. Decoding concatenates
the tokens' bytes as binary pieces.

Null and empty texts and an empty table give no tokens; repeated rows and ids stay;
the id may be null and of any type.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.words import batches
from corpuscle.util import table

#: Bytes of text that are encoded at once, and words whose ids a worker keeps. They decide time and memory only, never a result.
BLOCK_BYTES, KEPT = 4 << 20, 1 << 17


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def _tokens(path: str) -> str:
    """JSON of the tokens' bytes by id, in base 64 as JSON has it."""
    ranks = read_ranks(path)
    tokens = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = base64.b64encode(token).decode()
    return json.dumps(tokens, separators=(",", ":"))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: pairs wait in a heap by rank and place, so that the time hardly exceeds the length."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    end, parts = len(word), [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(r, i, 2) for i in range(end - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= end or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
        if after[j] < end:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else end
            if right < end and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, len(parts[left]) + len(parts[right])))
    return [ranks[p] for p in parts if p]


@functools.lru_cache(maxsize=1)
def _kept(run: str) -> dict[str, tuple[int, ...]]:
    """The words that this worker has merged in a run, KEPT at most."""
    return {}


def _encoded(pattern: str, block_bytes: int, ranks, run_name: str):
    """Rows of (id, text) to rows of (id, ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table, kept = regex.compile(pattern).findall, ranks.value, _kept(run_name)

        def ids_of(word: str) -> tuple[int, ...]:
            found = kept.get(word)
            if found is None:
                found = tuple(merge_word(word.encode("utf-8", "surrogatepass"), table))
                if len(kept) < KEPT:
                    kept[word] = found
            return found

        for batch in batches(it, block_bytes):
            known: dict[str, int] = {}
            numbers = [np.array([known.setdefault(w, len(known)) for w in split(text)] if text else [], np.int32) for text in batch.column(1).to_pylist()]
            parts = [ids_of(w) for w in known]
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.fromiter(itertools.chain.from_iterable(parts), np.int32, int(ends[-1]))
            at = np.concatenate([np.zeros(0, np.int32), *numbers])
            # every word's ids in a row: a place in them is its word's first plus how far the row has come since that word's start
            sizes = (ends[1:] - ends[:-1])[at]
            stops = np.cumsum(np.concatenate((np.zeros(1, np.int64), sizes)))
            places = np.repeat(ends[at] - stops[:-1], sizes) + np.arange(int(stops[-1]))
            texts = stops[np.cumsum([0, *map(len, numbers)])]
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(texts, pa.int32()), pa.array(flat[places], pa.int32()))], ["id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids) of every row: the token numbers of its whole text, without special tokens.

    Null and empty texts give no tokens. Repeated rows and ids stay as they are.
    """
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("id", pair.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return pair.mapInArrow(_encoded(pattern, block_bytes, ranks, uuid.uuid4().hex), out)


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that a list of token numbers stands for, the tokens' bytes concatenated; none for an empty list, null for null.

    Strings hold any bytes here: a cast keeps them, and joining strings copies each piece once.
    """
    tokens = F.from_json(F.lit(_tokens(ranks_path)), "array<binary>")
    return F.array_join(F.transform(ids, lambda i: F.element_at(tokens, i + 1).cast("string")), "").cast("binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents."""
    coded = encode(docs, ranks_path, pattern)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks_path), 256).alias("decoded_sha256"))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token digests of every document by the 50k byte-level ranks."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""What the operators share: word splitting and column handling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Spark's regular expression for a word between ASCII white space; bytes.split() splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batches(it: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about most_bytes, so that memory is bounded by the longest text."""
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, n * most_bytes // max(batch.nbytes, 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)

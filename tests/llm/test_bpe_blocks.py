"""A worker's memory in encoding: small blocks, a bounded number of kept words, and the same ids."""

import random
from types import SimpleNamespace

import public_tokenizers as P
import pyarrow as pa
import tiktoken

from corpuscle.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_blocks_and_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    ranks = bpe.read_ranks(PATH)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshré語", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    given = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    out = list(bpe._encoded(P.PATTERN, given.nbytes // 8, SimpleNamespace(value=ranks), "a run")(iter([given])))
    assert len(out) >= 8 and len(bpe._kept("a run")) == 50
    got = [row for batch in out for row in batch.to_pylist()]
    assert [r["id"] for r in got] == list(range(len(texts)))
    assert [r["ids"] for r in got] == [encoding.encode_ordinary(t or "") for t in texts]
    # no run reads another's words
    assert not bpe._kept("another run")

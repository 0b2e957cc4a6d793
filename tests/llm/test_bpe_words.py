"""Words that the tables do not hold, against tiktoken, and decoding back to the same bytes."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from corpuscle.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["".join(rng.choices(letters, k=n)) for n in (1, 2, 40, 95, 96, 97, 300, 100_000)]
    out += ["a" * n for n in (3, 95, 96, 97, 5000)] + ["ab" * 48, "=" * 700, "é" * 60, "日本語" * 20, " " * 50 + "x", "\n" * 120, "tail \n"]
    return out + ["".join(rng.choices("aàβ語🙂-' \n\t1", k=60)) for _ in range(40)]


def test_words_of_any_length_equal_tiktoken(spark, encoding):
    given = [*texts(), None, "", None, "twice", "twice"]
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id int, text string")
    coded = bpe.encode(rows, PATH, P.PATTERN)
    got = coded.select("id", "ids", bpe.decode(coded["ids"], PATH).alias("back")).collect()
    assert sorted(r.id for r in got) == list(range(len(given)))
    for r in got:
        text = given[r.id] or ""
        assert r.ids == encoding.encode_ordinary(text)
        assert bytes(r.back) == text.encode()


def test_decode_of_nothing(spark):
    got = spark.createDataFrame([([],), (None,)], "ids array<int>").select(bpe.decode(bpe.F.col("ids"), PATH).alias("b")).collect()
    assert [r.b for r in got] == [b"", None]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0

"""Nulls, empty and repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import types as T

from corpuscle.llm import bpe, embeddings, licenses, lines, lm, mixing, quality, simhash, urls, warc

DOCS = "doc_id long, text string, source string, row string, id long, size long"
ROWS = [(1, "one two three four five six\none two three four five six", "a", "x", 9, 9), (2, None, None, None, None, None), (None, "some words", "a", "x", 1, 1), (3, "", "b", "", 0, 0), (1, "one two three four five six\none two three four five six", "a", "x", 9, 9), (4, "w " * 30000, "b", "y", 2, 2)]


@pytest.fixture(scope="module", params=[ROWS, []], ids=["rows", "none"])
def docs(spark, request):
    return spark.createDataFrame(request.param, DOCS)


def encode(df):
    import public_tokenizers as P

    return bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


RUNS = {
    "bpe": encode,
    "licences": licenses.scan,
    "lines": lines.dedup_lines,
    "simhash": simhash.near_duplicates,
    "quality": lambda df: quality.judge(df, None),
    "lm": lambda df: lm.score(df, lm.train(df.select("text"))),
    "mixing keys": mixing.with_keys,
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_each(docs, name):
    assert RUNS[name](docs).count() == docs.count()


def test_mix_and_keep_one(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and (mixed.count() > 0) == (docs.count() > 0)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}


def test_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("id", T.StringType())])
    data = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], None), (3, None, None), (4, [0.0, 0.0], "y"), (5, [float("nan"), 1.0], ""), (6, [None, 1.0], ""), (None, [1.0, 0.0], ""), (7, [1.0, 0.0], "")]
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(spark.createDataFrame(data, schema)).collect()}
    assert got[1] == got[2] == got[7] == (2, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6)) and got[None][0] == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string"
    data = [(1, "http://A.net/x", "h" * 200), (2, None, "h" * 200), (3, "no scheme", None), (None, "https://b.org/fr/1", "h" * 200), (4, "http://A.net/x", "")]
    for rows in (data, []):
        df = spark.createDataFrame(rows, schema)
        assert urls.judge(df).count() == len(rows)
        captures = warc.write_archives(df)
        back = {r.page_id: r for r in warc.read_archives(captures, warc.write_index(captures)).collect()}
        assert len(back) == len(rows)
        if rows:
            assert (back[2].record_type, back[2].refers_to, back[2].payload_bytes) == ("revisit", 1, 200)
            assert back[None].record_type == back[3].record_type == "response"

"""Groups of similar texts against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

from corpuscle.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if 5 * shared >= 4 * (len(x) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts)) if sum(find(j) == find(i) for j in range(len(texts))) > 1}


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r.component for r in simhash.similar_texts(rows).collect()}


@pytest.mark.parametrize("size", [6, 60, 200])
def test_pairs_near_the_limit(spark, size):
    rng, texts = random.Random(size), []
    for n in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(words), changed(rng, words, 1 + n % (size // 30 + 3) if size > 6 else 0) + (f" end{n}" if size == 6 and n % 2 else "")]
    want = groups(texts)
    assert 20 < len(want) and (size == 6 or len(want) < len(texts))
    assert found(spark, texts) == want


def test_crowds_that_are_no_star(spark):
    """A chain, in which no text is similar to all, and a passage that unrelated texts share."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for n in range(simhash.CROWD * 3):
        words[n % 200] = f"chain{n}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{n}" for n in range(60))
    texts += [passage + " " + " ".join(f"x{rng.random()}" for _ in range(60)) for _ in range(simhash.CROWD * 2)]
    for t in texts[-40:]:
        texts.append(changed(rng, t.split(), 2))
    assert found(spark, texts) == groups(texts)

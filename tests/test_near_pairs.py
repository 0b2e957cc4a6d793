"""Pairs of near word sets against all pairs, and what their search shuffles."""

import itertools
import random

from corpuscle.operators import similarity


def made(rng, size, grp, of):
    return grp, sorted(rng.sample(of, size))


def test_near_pairs_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng, words, sets = random.Random(5), [f"w{i}" for i in range(90)], []
    for size in (1, 2, 4, 5, 6, 9, 10, 17, 30, 60):
        for grp in ("a", "b", None):
            sets += [made(rng, size, grp, words) for _ in range(3)]
            for _ in range(6):
                g, w = rng.choice(sets[-3:])
                gone = set(rng.sample(w, min(len(w) - 1, rng.randint(0, max(1, size // 7)))))
                sets.append((g, sorted({*w} - gone | {*rng.sample(words, rng.randint(0, max(1, size // 8)))})))
    rows = [(f"f{i:03}", g, w, len(w)) for i, (g, w) in enumerate(sets)]
    first = {}
    for rep, g, w, _ in rows:
        first.setdefault((g, tuple(w)), rep)
    wanted = set()
    for ((g, x), a), ((h, y), b) in itertools.combinations(first.items(), 2):
        both = len({*x} & {*y})
        total = len({*x} | {*y})
        if g is not None and g == h and both * 100 >= total * 80:
            wanted.add((min(a, b), max(a, b), both, total))
    assert len(wanted) > 50
    got = [tuple(r) for r in similarity.near_pairs(spark.createDataFrame(rows, "rep string, grp string, words array<string>, n int"), 80).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_unlike_sets_of_the_same_few_words_do_not_meet(spark, monkeypatch):
    """Sets out of few words meet in nearly all pairs by any one word; only like ones are written out."""
    sizes, pin = {}, similarity.pin

    def counted(df, label):
        out = pin(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(similarity, "pin", counted)
    rng, words = random.Random(6), [f"w{i}" for i in range(600)]
    rows = [(f"f{i:03}", "a", sorted(rng.sample(words, 100)), 100) for i in range(400)]
    assert similarity.near_pairs(spark.createDataFrame(rows, "rep string, grp string, words array<string>, n int"), 80).count() == 0
    assert max(sizes[x] for x in sizes if x != "word_sets") < 400 * 399 / 2 / 20 and sizes["met"] < 10

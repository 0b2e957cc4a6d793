"""The ten operators against brute force on the driver's smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import duck_rows, spark_rows

from corpuscle.llm import registry
from corpuscle.llm.simhash import fingerprint

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_bpe_equals_tiktoken(spark, sf, docs):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, sf, "op1_byte_bpe")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_license_base_labels(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = rows(spark, sf, "op2_license_scan")
    assert len(got) == len(docs)
    for r in got:
        w = word.findall(lower(docs[r.doc_id].text))
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in phrases}
        starts = sum(at.values(), [])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        base = {phrases[p] for p, x in at.items() if x}
        assert r.base_labels == ",".join(sorted(base))
        assert base <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_mixing_targets(spark, sf, docs):
    got = rows(spark, sf, "op3_mixing")
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, sf, "op3_mixing")))
    size = {d: len(SPLIT.findall(r.text or "")) for d, r in docs.items()}
    names = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        w = sum(weight[s] for s in free)
        stop = {s for s in free if left * weight[s] / w > 3 * total[s]}
        if not stop:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * total[s] for s in stop}
        left -= sum(target[s] for s in stop)
        free -= stop
    taken = Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        longest = max(size[d] for d, r in docs.items() if r.source == s)
        assert abs(taken[s] - target[s]) <= max(longest, 1)


def test_line_dedup_keeps_one_of_equal_lines(spark, sf, docs):
    norm = lambda x: tuple(re.findall(r"[^\W_]+", x.lower()))
    got = {r.doc_id: r for r in rows(spark, sf, "op4_line_dedup")}
    assert got.keys() == docs.keys()
    before, after = Counter(), Counter()
    for d, r in docs.items():
        assert got[d].n_lines == (len(r.text.split("\n")) if r.text is not None else 0)
        before.update(filter(None, map(norm, (r.text or "").split("\n"))))
        left = (got[d].text or "").split("\n")
        after.update(filter(None, map(norm, left)))
        it = iter((r.text or "").split("\n"))
        assert got[d].n_kept == 0 or all(x in it for x in left)
    assert max(after.values()) == 1
    gone = set(before) - set(after)
    assert all(any(len(set(a) & set(b)) >= 0.5 * len(set(a)) for b in after) for a in gone)


def components(names, pairs):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in names}


def test_simhash_components(spark, sf, docs):
    import xxhash

    def slow(text):
        w = SPLIT.findall(lower(text))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {d: fingerprint(r.text) for d, r in docs.items()}
    some = sorted(docs)[:40]
    assert [fp[d] for d in some] == [slow(docs[d].text) for d in some]
    ids = sorted(docs)
    want = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = rows(spark, sf, "op5_simhash")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_embedding_recall(spark, sf):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(v)
    x = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in rows(spark, sf, "op6_embedding_dedup")}
    assert sorted(got) == ids
    true = linked.sum(axis=1)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_url_rules(spark, sf):
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows(spark, sf, "op7_url_filter")
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        m = re.search(r"://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]


def test_quality_counts(spark, sf, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hits = Counter()
    for r in rows(spark, sf, "op8_quality_rules"):
        text = docs[r.doc_id].text or ""
        w = SPLIT.findall(text)
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if SPLIT.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            hits[labels[r.doc_id] == int(r.kept)] += 1
    assert hits[True] > 0.7 * sum(hits.values())


def test_warc_equals_sql(spark, sf):
    got = spark_rows(registry.QUERIES["op9_warc"](spark, sf))
    assert got == duck_rows(sf, registry.ORACLES["op9_warc"])


def test_lm_base_score(spark, sf, docs):
    seen, held = Counter(), {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*SPLIT.findall(lower(r.text)), "\n"] for d, r in docs.items()}
    for d, w in tokens.items():
        if not held[d]:
            seen.update(w)
    n, v = sum(seen.values()), len(seen)
    model = uniform = 0.0
    for r in rows(spark, sf, "op10_lm_scores"):
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in seen for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
        model, uniform = model + r.score * r.held_out, uniform + r.base_score * r.held_out
    assert model > uniform

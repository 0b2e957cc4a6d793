"""Labels of files with several notices against a direct scan for every template's key words in place."""

import itertools
import re

from corpuscle.llm import licenses


def direct(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return {t.label for t in licenses.TEMPLATES for off in range(-len(t.words), len(w)) if all(0 <= off + i < len(w) and w[off + i] == t.words[i] for i in t.mandatory)}


def test_files_of_several_notices(spark):
    texts = [a.text + " and parts are " + b.text for a, b in itertools.permutations(licenses.TEMPLATES, 2)]
    texts += [" ".join(f"{t.text} file {n}" for n, t in enumerate(licenses.TEMPLATES)), "gnu general public of charge license version 3 mit"]
    texts += [f"common words software license version public gnu {n}" for n in range(20)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        # a base phrase is a label without any template in place
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == direct(texts[r.id]) | base

"""Licence scan against a plain search over the words."""

import random
import re

import numpy as np

from quire.llm import licenses, queries
from tests.conftest import SF_SMALL

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        got = set(filter(None, r.labels.split(",")))
        assert set(filter(None, r.base_labels.split(","))) <= got
        assert r.labels == ",".join(sorted(got)) and 0 <= r.score <= 1 and (r.score > 0) == bool(got)


def test_query_equals_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op3_license_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    for r in rows:
        assert ("cc-by-nc" in r.labels.split(",")) == ("CC BY-NC" in texts[r.doc_id])


def test_edge_rows(spark):
    texts = {
        1: None, 2: "", 3: "MIT License", 4: "mit\n\tLICENSE, mit-license (MIT license)", 5: "mit éLicense mit licenseé",
        6: "license general public license GENERAL PUBLIC LICENSE gpl", 7: "x " * 30000 + "Apache License" + " y" * 30000,
        8: "mit", 9: "license", 10: "the GNU Lesser General Public License", 11: "ｍit license", 12: "mit7 license mit_license",
        13: "BSD 3-Clause", 14: "All rights reserved.",
    }
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows + [(3, texts[3], "x", 1)], "doc_id long, text string, labels string, n_words int")
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(rows) + 1
    check(got, texts)
    by = {r.doc_id: r.labels for r in got}
    assert by[10] == "gpl,lgpl" and by[13] == "bsd" and by[14] == "all-rights-reserved"
    assert licenses.license_scan(docs.limit(0)).collect() == []


def flat_index(common=("the", "of", "this")):
    vocab = licenses.vocabulary()
    df = np.zeros(len(vocab))
    df[np.searchsorted(vocab, licenses.hash_words(list(common)))] = 1000
    return licenses.build_index(vocab, df, 1000)


def test_rare_words_decide_the_postings():
    index = flat_index()
    common = set(np.searchsorted(index.vocab, licenses.hash_words(["the", "of", "this"])).tolist())
    held = {x for x in common if index.first[x + 1] > index.first[x]}
    assert not held  # every template has two rarer words


def scan(index, *texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    return licenses.scan_batch(index, np.frombuffer(b"".join(raw), np.uint8), at)


def test_templates_are_proposed_by_position_and_verified_by_phrases():
    index = flat_index()
    notice = licenses.TEMPLATES[1][1]
    words = notice.split()
    out = scan(index, "intro words " + notice, " ".join(reversed(words)), " ".join(words[14:]), "mit license", "license mit", notice.replace("charge", "change"))
    assert out["labels"] == ["mit", "", "", "mit", "", ""]
    assert out["score"][0] > 0.99 > out["score"][3] >= 0.5 and out["score"][1] == 0
    assert out["n_base"] == [0, 0, 0, 1, 0, 0]


def test_every_place_of_a_base_phrase_is_found():
    rnd, index = random.Random(2), flat_index(["license", "mit"])
    texts = [" ".join(rnd.choices(["mit", "license", "apache", "general", "public", "x"], k=rnd.randint(0, 60))) for _ in range(200)]
    out = scan(index, *texts)
    for i, t in enumerate(texts):
        assert (out["n_words"][i], out["n_base"][i], out["first_word"][i], out["last_word"][i], out["base_labels"][i]) == brute(t)

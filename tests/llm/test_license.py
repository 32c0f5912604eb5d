"""The labels and scores of licence scans, against a plain search for every template at every place."""

from __future__ import annotations

import random
import re

import brute
import pytest

from wayloom.llm.license import NOTICES, TEMPLATES, TEXTS, license_scan, scanner


def plain(text: str) -> tuple[str, float]:
    """Labels of notices whose key phrases stand in place, and the best share of their words."""
    words, labels, score = brute.words(text), set(), 0.0
    for t in TEMPLATES:
        if t.slack:
            continue
        own = t.text.split()
        keys = [(at, [w.decode() for w in key]) for at, key in t.places()]
        for start in range(-len(own), len(words)):
            if all(start + at >= 0 and words[start + at : start + at + len(key)] == key for at, key in keys):
                labels.add(t.label)
                score = max(score, sum(start + i >= 0 and words[start + i : start + i + 1] == [w] for i, w in enumerate(own)) / len(own))
    return ",".join(sorted(labels)), score


@pytest.mark.parametrize("seed", range(40))
def test_notices_against_every_place(seed):
    rng = random.Random(seed)
    pieces = [t.text for t in NOTICES] + ["cc by", "general public license", "all rights reserved", "license version", "software"]
    words = " ".join(rng.choice(pieces) for _ in range(12)).split()
    for _ in range(rng.randint(0, 12)):
        words[rng.randrange(len(words))] = rng.choice(words)
    text = " ".join(words).upper()
    labels, score = scanner(tuple(t for t in TEMPLATES if not t.slack), {})([text.encode()])[0][5:]
    assert (labels, score) == (plain(text)[0], pytest.approx(plain(text)[1]))


@pytest.mark.parametrize("template", TEXTS, ids=lambda t: t.label)
def test_whole_texts_with_words_changed(template):
    rng = random.Random(3)
    keys = {w for k in template.keys for w in k.split()}
    scan = scanner(TEXTS, {})
    for changed in (0, 0.05, 0.1):
        words = [w if w in keys or rng.random() >= changed else rng.choice(("foo", "bar baz", "")) for w in template.text.split()]
        text = f"some words before {' '.join(words)} and some after"
        found = scan([text.encode()])[0]
        assert template.label in found[5].split(",") and found[6] >= 1 - 2 * changed
    for key in template.keys:  # without a mandatory phrase it is not that licence
        lost = template.text.replace(key, "something else")
        assert template.label not in scan([lost.encode()])[0][5].split(",") or any(t is not template and t.label == template.label for t in TEXTS)
    assert scan([" ".join(rng.sample(template.text.split(), len(template.text.split()))).encode()])[0][5] == ""


def test_scan_of_a_table(spark):
    mit = TEXTS[0].text
    rows = [(1, re.sub(" ", "\n", mit)), (1, None), (None, ""), (2, "Released under the MIT License.")]
    got = sorted((r.doc_id or 0, r.labels, r.score) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "", 0.0), (1, "", 0.0), (1, "mit", 1.0), (2, "mit", 1.0)]

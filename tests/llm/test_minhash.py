"""MinHash near-dedup against a plain version."""

import random
import re

import duckdb
import numpy as np
import pytest

from wayloom.llm import links, minhash
from wayloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, node string, band int, key long, id int, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows with ids of their own."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.85 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in docs])
    assert found(QUERIES["op11_minhash"](spark, f"/root/testdata/{sf}")) == sorted(want, key=repr)
    assert any(not x[3] for x in want)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert sorted(db.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({ORACLE_SQL['op11_minhash']})").fetchall()) == want


def family(rng, size, edits, first=0):
    """A text and copies of it, each edited in places of its own, and copies of copies."""
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    out = [list(base)]
    while len(out) < size:
        text = list(out[rng.randrange(len(out))])
        for _ in range(rng.choice(edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        out.append(text)
    return [(first + k, " ".join(t)) for k, t in enumerate(out)]


def test_one_large_group_of_copies_of_copies(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 16)
    monkeypatch.setattr(links, "PAIRS", 100)
    rows = family(random.Random(1), 250, (1, 2, 3, 4, 5)) + family(random.Random(2), 60, (2, 6), 1000)
    want = brute(rows)
    assert 20 < sum(x[3] for x in want) < 280
    assert found(minhash.minhash_groups(table(spark, rows))) == sorted(want, key=repr)


def test_nulls_short_texts_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (9, "One TWO"), (5, "one two three"), (6, "Ä b c d e f"), (7, "ä b c d e f"), (8, "Ä B c d e f")]
    assert found(minhash.minhash_groups(table(spark, rows))) == brute(rows)
    again = rows + [(5, "one two three"), (5, "other words of the same id here"), (None, "one two"), (None, "alone with words"), (None, None)]
    got = found(minhash.minhash_groups(table(spark, again)))
    assert len(got) == len(again)
    assert (None, 1, 4, False) in got and (None, 1, None, True) in got and (None, 0, None, True) in got
    assert [x for x in got if x[0] == 5] == [(5, 1, 5, True), (5, 1, 5, True), (5, 3, 5, True)]
    assert found(minhash.minhash_groups(table(spark, []))) == []


def test_odd_sketches_estimate_high_similarities(spark):
    rng = np.random.default_rng(2)
    for true, most in ((0.95, 0.04), (0.85, 0.08)):
        errors = []
        for _ in range(200):
            both = rng.integers(0, 1 << 63, 1000, np.uint64)
            n = round(1000 * (1 - true) / 2)
            x, y = both[: 1000 - n], both[n:]
            sketch = minhash.odd_sketches(np.stack([minhash.signature(x), minhash.signature(y)]))
            errors.append(minhash.estimate(sketch[:1], sketch[1:])[0] - true)
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < most / 2 and min(errors) > -0.2


def test_set_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 700, 20_000):
        both = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        cut = int(len(both) * 0.15)
        x, y = both[cut // 2 :], both[: len(both) - (cut - cut // 2)]
        s = links.set_sketches([x, y])
        assert links.sets_may_reach(0.85, np.array([len(x)]), np.array([len(y)]), s[:1], s[1:])[0]

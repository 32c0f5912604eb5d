"""The pipeline's stages against plain versions of their decisions."""

import random

import brute
import corpus_pipeline as pipeline

from wayloom.llm import simhash

SF = "/root/testdata/sf0.001"


def firsts(docs, pairs):
    """Ids that are the smallest of what pairs join."""
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def test_near_copies(spark):
    rng = random.Random(4)
    docs, lexicon = {}, [f"word{i}" for i in range(3000)]
    for k in range(60):
        base = [rng.choice(lexicon) for _ in range(300)]
        for v in range(5):
            words = list(base)
            for at in rng.sample(range(300), (0, 1, 2, 3, 12)[v]):
                words[at] = rng.choice(lexicon)
            docs[10 * k + v] = " ".join(words)
    docs |= {9001: None, 9002: "", 9003: " \n"}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, hi string")
    out = simhash.near_copies(df.union(df.limit(5)))
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    want = firsts(docs, brute.near_pairs(docs))
    assert want <= set(kept) and len(kept) == len(set(kept))
    # the fingerprints find nearly all links; a document is missed where all of its links are
    assert len(set(kept) - want) <= 0.1 * (len(docs) - len(want))


def test_near_copies_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs = [(a, b) for a, b in brute.near_pairs(texts) if brute.shingles(texts[a]) != brute.shingles(texts[b])]
    kept = {r.doc_id for r in dict(pipeline.STAGES)["SimHash near-dedup"](spark, docs, sf).collect()}
    want = firsts(texts, brute.near_pairs(texts))
    assert want <= kept
    found = sum(not {a, b} <= kept for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    assert len(kept - want) <= 0.1 * (len(texts) - len(want))


def test_near_copies_lose_no_text(spark):
    """Shared and null ids, repeated rows, texts without words, clashing names."""
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(1, many), (2, many), (2, "a wholly different text of some words"), (2, many + " w60"), (3, None), (3, ""), (None, " \n"), (None, many), (None, "one of no id"), (None, "one of no id"), (4, "x"), (4, "X"), (5, "x y")]
    df = spark.createDataFrame([(i, t, 7, "z", 1) for i, t in rows], "doc_id long, text string, row int, node string, hit int")
    out = simhash.near_copies(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [rows[0], rows[2], rows[4], rows[5], rows[6], rows[8], (4, "x"), rows[12]]
    assert [(i, (t or "").lower() or t) for i, t in got] == sorted(want, key=repr)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_language_stage_on_nulls_and_shared_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    more = [(1, None, "x", None, None), (1, "", None, None, 0), (None, "12 34", None, None, None), (None, "The words of this line are English, and so it is kept. " * 5, None, "s", 9)]
    odd = spark.createDataFrame(more, docs.schema)
    out = dict(pipeline.STAGES)["language ID"](spark, docs.union(odd), SF)
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == docs.columns
    assert (1, None) not in texts and (1, "") not in texts and (None, "12 34") not in texts and (None, more[3][1]) in texts


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()}
    names = docs.columns
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    stages = dict(pipeline.STAGES)
    told = stages["language ID"](spark, docs, SF)
    assert told.columns == names and len(texts(told)) > 0.95 * docs.count()
    lined = stages["line dedup"](spark, told, SF).persist()
    assert lined.columns == names and texts(lined).keys() == texts(told).keys()
    unique = stages["SimHash near-dedup"](spark, lined, SF)
    assert unique.columns == names
    assert texts(unique).keys() == firsts(texts(lined), brute.near_pairs(texts(lined)))
    clean = stages["benchmark decontamination"](spark, lined, SF)
    assert clean.columns == names
    assert texts(clean).keys() == {i for i, x in brute.contamination(texts(lined), items).items() if not x[4]}
    out = stages["byte-level BPE"](spark, clean, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: brute.sha((t or "").encode()) for i, t in texts(clean).items()}

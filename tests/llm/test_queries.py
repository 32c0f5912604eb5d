"""The registered queries on whole small tables, against plain versions."""

import base64
import struct
from collections import Counter

import brute
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from wayloom.llm import cws
from wayloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, *cols, sf=SF):
    return {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, sf).select("doc_id", *cols).collect()}


def test_simhash(spark, docs):
    assert rows(spark, "op1_simhash", "fingerprint", "component_id") == brute.simhash(docs)


def test_langid(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = rows(spark, "op2_langid", "held_out", "lang_pred", "score", sf=sf)
    assert found.keys() == truth.keys()
    held = [i for i, x in found.items() if x[0]]
    assert sum(found[i][1] == truth[i] for i in held) > 0.97 * len(held)
    assert all(0 <= x[2] <= 1 for x in found.values())


def test_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha((t or "").encode()))
    assert rows(spark, "op3_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 1024)
    assert rows(spark, "op4_token_counts", "n_bytes", "n_tokens", "over_limit") == want


def test_license(spark, docs):
    found = rows(spark, "op5_license", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == {i: brute.licences(t) for i, t in docs.items()}
    assert sum(x[1] for x in found.values())


def test_decontamination(spark, docs):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()}
    found = rows(spark, "op6_decontamination", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contamination(docs, items)


def test_decontamination_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet/*.parquet')" if t == "none" else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(db.execute(f"SELECT {','.join(cols)} FROM ({ORACLE_SQL['op6_decontamination']})").fetchall())
    assert sorted(map(tuple, QUERIES["op6_decontamination"](spark, SF).select(*cols).collect())) == want


def test_repeats(spark, docs):
    found = rows(spark, "op9_repeats", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = {i: tuple(rest) for i, *rest in brute.repeats(list(docs.items()))}
    assert found == want
    assert any(x[1] and x[1] < x[0] for x in want.values())


def jaccard(a, b):
    """Generalised Jaccard similarity of two texts' words; a text without words is one term itself."""
    x, y = (Counter(brute.words(t) or [t]) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_fingerprints(spark, docs):
    found = rows(spark, "op10_fingerprints", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    want, edited = brute.edits(docs), brute.edited_texts(docs)
    assert {i: x[:2] for i, x in found.items()} == {i: x[:2] for i, x in want.items()}
    for i in docs:
        for j in docs:
            if docs[i] == docs[j]:
                assert found[i][2] == found[j][2]
    alike = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) // 8)
    errors = []
    for i, x in found.items():
        assert len(x[2]) == len(x[3]) == 8 * cws.SAMPLES
        assert (alike(x[2], x[3]), alike(x[2], found[want[i][2]][2])) == x[4:]
        for near, true in ((x[4], jaccard(docs[i] or "", edited[i])), (x[5], jaccard(docs[i] or "", docs[want[i][2]] or ""))):
            errors.append(near - true)
            assert abs(near - true) <= 5 * (true * (1 - true) / cws.SAMPLES) ** 0.5 + 1 / cws.SAMPLES  # a share is a multiple of that
    # no bias beyond one standard error: the texts share most words, and with them their draws
    assert abs(sum(errors) / len(errors)) < 0.5 / cws.SAMPLES**0.5

"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from wayloom.llm import spelling
from wayloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, word string, tile long, n int, near string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def brute(rows):
    """{word: (n, n_near, form, form_n, root)} for rows (doc_id, text)."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    masked, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            masked[w[:k], w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for same in masked.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: x if x and n[x] >= 5 * n[w] else None for w, x in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n}


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
        got = found(QUERIES["op12_spelling"](spark, f"/root/testdata/{sf}"))
        assert got == brute([tuple(r) for r in docs])
        assert any(x[2] for x in got.values())
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        assert {r[0]: r[1:] for r in db.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({ORACLE_SQL['op12_spelling']})").fetchall()} == got


def test_edits_ties_chains(spark):
    texts = {"stands": 200, "standa": 30, "stanxa": 6, "stand": 50, "Standes": 5, "tands": 9, "stadns": 5, "otheré": 30, "other÷": 30, "others": 5, "ABCDEFÀ": 7, "abcdefà": 35}
    rows = [(None, " ".join([w] * k)) for w, k in texts.items()]
    got = found(spelling.spelling_variants(table(spark, rows)))
    assert got == brute(rows)
    assert got["stanxa"][2:] == ("standa", 30, "stands") and got["others"][2] == "otheré" and got["abcdefÀ"][4] == "abcdefà"


def test_nulls_long_words_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "z" * 70_000 + " " + "z" * 69_999), (None, None), (4, "×÷" * 4), (5, "..."), (6, "中文abcdefg中")] * 6
    assert found(spelling.spelling_variants(table(spark, rows))) == brute(rows)
    assert spelling.spelling_variants(table(spark, [])).count() == 0


def test_a_tile_of_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = ["prefix" + "".join(rng.choice("abc") for _ in range(rng.choice((5, 6)))) for _ in range(900)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(300))) for k in range(60)]
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "CELLS", 500)
    assert found(spelling.spelling_variants(table(spark, rows))) == brute(rows)

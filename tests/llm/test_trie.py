"""The prefix trie of conversations against a plain version and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from wayloom.llm import trie
from wayloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, d1 string, conv int, at int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn, sha(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, t in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - abs(c) % 100 * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(str(c) for c in m if whole[c] == p)))
        for p, m in members.items()
    )


def found(df):
    assert all(kind == "bigint" for name, kind in df.dtypes if name != "ends_sha256")
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    want = brute(map(tuple, spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert found(QUERIES["op13_trie"](spark, path)) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    assert sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_trie']})").fetchall()) == want


def made(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for k in range(rng.choice((0, 1, 2, 5, 9))):
            rows.append((c, rng.choice((k, k, k, None)), rng.choice(("user", None)), rng.choice(words)))
        rows.append((c, 0, "user", rng.choice(words)))
    return rows


@pytest.mark.parametrize("cells", [64, 1 << 14])
def test_nulls_ties_copies_and_false_alarms(spark, monkeypatch, cells):
    monkeypatch.setattr(trie, "LEAST_CELLS", cells)
    monkeypatch.setattr(trie, "CELLS", cells)
    rows = made(3, [*range(-230, 90, 3), *range(200, 460), 1 << 40, None], ["a", "b", None, "", "ünï" * 50])
    rows += rows[:40]
    assert found(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_one_long_conversation_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    long = [(700, k, "user", f"turn {k % 50}") for k in range(3000)]
    rows = long + [(c, k, r, t) for c in (701, 702) for _, k, r, t in long[: 3000 - c + 700]] + made(4, range(703, 760), ["a"])
    assert found(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_turnless_lonely_and_empty(spark):
    for rows in ([(7, 0, "user", "x")], [(7, None, None, None)], [(123, 0, "user", "x"), (124, 0, "user", "x")], [(None, 1, "a", "b")], []):
        assert found(trie.prefix_trie(table(spark, rows))) == brute(rows)

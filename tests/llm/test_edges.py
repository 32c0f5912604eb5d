"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import random
import time

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayloom.llm import bpe, cws, decontam, html, langid, license, linededup, simhash, suffixes, tokencount

LONG = " ".join(f"wort{i % 977}" for i in range(20_000))
ROWS = [
    (1, None), (2, ""), (3, "..."), (4, "one two three four five six"), (4, "one two three four five six"), (5, "One two THREE four five six"),
    (6, LONG), (7, LONG[5:]), (8, "a\n\na\nB\n" + "x" * 900), (None, "one two three four five six"), (9, "ÄÖ ß All rights reserved CC-BY cc by"),
]
SCHEMA = "doc_id long, text string, ids string, root string, line_id int, band int, version int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in rows], SCHEMA)


RANKS, COUNTS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PER_ROW = {
    "bpe": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, RANKS), RANKS),
    "counts": lambda d: tokencount.token_counts(d, COUNTS),
    "licence": license.license_scan,
    "langid": lambda d: langid.identify(d, None),
    "simhash": simhash.near_duplicates,
    "repeats": suffixes.remove_repeats,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(spark, name):
    assert PER_ROW[name](table(spark, ROWS)).count() == len(ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](table(spark, [])).count() == 0


def test_empty_tables_of_the_others(spark):
    none = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(table(spark, ROWS), items).agg({"n_hit": "sum"}).first()[0] == 0
    assert linededup.dedup_lines(none).count() == 0
    assert cws.edited_likeness(none).count() == 0
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_contamination_of_short_items(spark):
    items = {1: "two three", 2: "FIVE", 3: None, 4: "", 5: " ".join(LONG.split()[50:70])}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = {i: t for i, t in ROWS if i is not None}
    got = {r[0]: (r.n_words, r.n_hit, len(r["items"])) for r in decontam.contamination(table(spark, list(docs.items())), benchmark).collect()}
    assert got == {i: x[:3] for i, x in brute.contamination(docs, items).items()}


def test_repeats_of_periodic_text(spark):
    rows = [(1, "ab" * 1000), (2, "x" * 399), (3, "é" * 500), (4, None), (5, LONG[:3000]), (6, "q" + LONG[:3000])]
    got = sorted(tuple(r) for r in suffixes.remove_repeats(table(spark, rows)).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect())
    assert got == brute.repeats(rows)


def test_lines(spark):
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, ROWS)).collect() if r.doc_id}
    assert got[1] is None and got[2] == "" and got[8] == "a\n\nB\n" + "x" * 900
    assert got[5] == ""  # the same but for case as document 4
    assert linededup.dedup_lines(table(spark, ROWS)).columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_fingerprints_of_equal_texts(spark):
    found = cws.edited_likeness(table(spark, ROWS)).collect()
    assert len(found) == len(ROWS) and all(r.near_next is not None for r in found)
    same = {r.fingerprint for r in found if r.n_chars == 27 and r.doc_id in (4, None)}
    assert len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    # of the two rows of document 4 one follows the other, and its edited text is its own
    assert sorted(r.near_next for r in found if r.doc_id == 4)[1] == 1
    alone = cws.edited_likeness(table(spark, [(7, "one two three")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in alone] == [(7, 13, 1.0)]
    plain = sorted(map(tuple, cws.fingerprints(table(spark, ROWS)).collect()), key=repr)
    assert plain == sorted(((r.doc_id, r.fingerprint) for r in found), key=repr)


def test_each_row_is_judged_by_itself(spark):
    items = spark.createDataFrame([(1, " ".join(f"wort{i}" for i in range(30)))], "item_id long, text string")
    bad, good = " ".join(f"wort{i}" for i in range(20)), "nothing of the kind stands here at all"
    docs = table(spark, [(1, bad), (1, good), (None, bad), (None, good), (2, good), (2, good), (3, None)])
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, good), (None, good), (2, good), (2, good), (3, None)], key=repr)
    assert decontam.contamination(docs, items).count() == 7


def test_long_texts_are_scanned_in_proportion(spark):
    words = [f"w{i % 5003}" for i in range(320_000)]
    items = spark.createDataFrame([(1, " ".join(words[100:130]))], "item_id long, text string")
    parts = [(k, " ".join(words[k * 5000 : (k + 1) * 5000])) for k in range(64)]

    def seconds(rows):
        began = time.time()
        hit = decontam.contamination(table(spark, rows), items).agg({"n_hit": "sum"}).first()[0]
        return time.time() - began, hit

    seconds(parts)
    short, _ = seconds(parts)
    long, hit = seconds([(1, " ".join(words))])
    assert hit == 30 * 64 and long < 8 * short + 10  # one task does what eight share


def test_letters(spark):
    assert [langid.has_letter(t) for t in ("²", "12 .", "é", "x1")] == [False, False, True, True]


def test_covering_masks_reach_every_pair():
    masks = simhash.masks()
    pairs = [(1 << i) | (1 << j) for i in range(64) for j in range(64)]
    assert all(any(not d & m for m in masks) for d in pairs)


def test_layout(spark):
    page = "<title>t</title><h1>A &amp; b</h1><p>c<p>d <b>e</b><ul><li>f<li>g</ul><table><tr><td>1<td>22<tr><td>333<td>4</table><div hidden>no</div><script>no</script>"
    text = html.render(html.parse(page))
    assert text == "A & b\n\nc\n\nd e\n\n- f\n- g\n\n1   | 22\n333 | 4"
    assert html.extract_text(spark.createDataFrame([(1, None), (2, "<p"), (3, "<div>" * 5000 + "x")], "page_id long, html string").withColumnRenamed("x", "y")).count() == 3


@pytest.mark.parametrize("start, first", [("--5", 1), ("²", 1), ("9" * 5000, 1), ("-3", -3), ("+7", 7), (" 12 ", 12), ("", 1), ("-", 1), ("٣", 1)])
def test_starts_of_lists(spark, start, first):
    page = f'<ol start="{start}"><li>a<li>b</ol>'
    text = html.extract_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first().text
    assert text.split() == [f"{first}.", "a", f"{first + 1}.", "b"]


def test_lines_without_spaces(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("0123456789abcdef") for _ in range(200))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200))
    rows = [(1, base), (2, "Q" + base), (3, base[:100] + "Q" + base[100:]), (4, cjk), (5, "文" + cjk), (6, cjk[:100] + "文" + cjk[100:])]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {1: base, 2: "", 3: "", 4: cjk, 5: "", 6: ""}
    owner, hashes = linededup.shingle_hashes(["abcdefghijé𝄞", "abc", "abcdefghi"])
    assert owner.tolist() == [0, 0, 0, 0, 2] and len(set(hashes.tolist())) == 4 and hashes[4] == hashes[0]


def test_lines_of_a_large_bucket(spark, monkeypatch):
    """Families of lines that share every band with a hundred others and are near to none of its centres."""
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for family in range(60):
        own = draw(300)
        rows += [(3 * family + k, own + draw(6)) for k in range(3)]
    bands_of = linededup.bands_of
    monkeypatch.setattr(linededup, "bands_of", lambda rows: bands_of(rows).withColumn("band", F.lit(7).cast("long")).distinct())
    monkeypatch.setattr(linededup, "BLOCK", 50)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert got == {i: t if i % 3 == 0 else "" for i, t in rows}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>Hello <b>you</b>", "Hello you"),
        ("<html><head><meta charset=x>\n<script>no</script>Hello<p>you", "Hello\n\nyou"),
        ("<head><title>T</title></head><p>a", "a"),
        ("<head><title>T</title><body><p>a", "a"),
        ("<p>a<select><option>b<option selected>c</select>d", "a\nb\nc\nd"),
        ("<p>a <textarea>b &amp; c</textarea> d", "a b & c d"),
        ("<p>a <svg><title>no</title><path d='x'/><text>b</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "a b x=1"),
        ("<div><svg/>a<math/><p>b</div>", "a\n\nb"),
        ("<div><svg hidden/>a<svg hidden />b", "ab"),
        ("<details><summary>S</summary>closed</details><details open><summary>T</summary>shown</details>", "S\nT\nshown"),
        ("<table><tr><td colspan=2>wide cell<td>c<tr><td>1<td>22<td>3</table>", "wide cell | c\n1 | 22 | 3"),
        ("a < b <c d='x>y'>e <f 'g>h", "a < b e h"),
        ("<p>a<a href=\"x>b</a> c <b>d</b>", "ab c d"),
    ],
)
def test_all_visible_text(page, text):
    assert html.render(html.parse(page)) == text


@pytest.mark.parametrize("piece", ["<a \"", "<a '\">", "<div></p>", "<table><b></div>", "<blockquote>x", "<ul><li>x", "<table><tr><td>", "<", "<!--", "</", "<svg><path/>", "&", "<b x='"])
def test_broken_pages_take_time_in_proportion(piece):
    took = []
    for size in (125_000, 1_000_000):
        page = piece * (size // len(piece))
        began = time.time()
        assert len(html.render(html.parse(page))) <= 100 * size
        took.append(time.time() - began)
    assert took[1] < 24 * took[0] + 2


def shuffled_bytes(spark):
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_decontamination_shuffles_no_text_without_hits(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(f"{rng.getrandbits(60):x}" for _ in range(n))
    bad = text(20)
    rows = [(i, bad if i % 100 == 0 else text(1500)) for i in range(400)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, bad)], "item_id long, text string")
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r.doc_id: r.text for r in decontam.decontaminate(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert kept == {i: t for i, t in rows if i % 100}
    assert shuffled_bytes(spark) - before < 1_000_000  # the texts are of 9 MB

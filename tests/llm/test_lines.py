"""Fuzzy lines against a plain comparison of all lines with all others."""

from __future__ import annotations

import random
import tracemalloc

import pytest

from wayloom.llm import linededup
from wayloom.llm.linededup import SHINGLE, SIMILARITY, bands, dedup_lines


def shingles(line: str) -> set:
    line = line.strip().lower()
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)} or {line}


def plain_classes(lines: list[str]) -> tuple[list[int], list[tuple[int, int]]]:
    """The class of each line, and all links."""
    sets, root, links = [shingles(x) for x in lines], list(range(len(lines))), []

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= SIMILARITY * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links.append((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(lines))], links


def templates(rng: random.Random, n: int, changed: int, words: int = 60) -> list[str]:
    base = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(words)]
    out = []
    for k in range(n):
        line = list(base)
        for at in rng.sample(range(words), changed):
            line[at] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(line) + ("" if k % 3 else " end"))
    return out


@pytest.mark.parametrize("changed", [1, 2, 3])
def test_one_large_bucket_of_a_template(spark, changed):
    rng = random.Random(changed)
    lines = templates(rng, 300, changed) + ["".join(rng.choices("klmnopqrst ", k=80)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r["doc_id"] for r in dedup_lines(docs).collect() if r["text"]}
    classes, links = plain_classes(lines)
    firsts = {i for i, c in enumerate(classes) if c == i}
    # what is kept beside the first of each class are lines all of whose links the bands have missed
    assert links and firsts <= kept
    assert len(kept - firsts) <= 0.02 * (len(lines) - len(firsts))


def edited(rng: random.Random, low: int, high: int) -> tuple[str, str]:
    """A line of low to high letters and a similar, unequal one: lengthened, shortened or with a letter replaced."""
    while True:
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(low, high)))
        more, less, at = rng.choices("xyz", k=rng.randint(1, 1 + len(line) // 8)), rng.randint(1, 1 + len(line) // 8), rng.randrange(len(line))
        other = rng.choice((line + "".join(more), line[less:], line[:at] + "#" + line[at + 1 :]))
        x, y = shingles(line), shingles(other)
        if min(len(line), len(other)) >= SHINGLE and x != y and len(x & y) >= SIMILARITY * len(x | y):
            return line, other


@pytest.mark.parametrize("low, high", [(9, 14), (12, 20), (20, 40), (40, 100), (100, 300)])
def test_bands_find_similar_lines_of_any_length(low, high):
    rng = random.Random(low)
    pairs = [edited(rng, low, high) for _ in range(2000)]
    x, y = (bands(list(side)) for side in zip(*pairs, strict=True))
    assert (x == y).any(axis=1).mean() >= 0.95


def test_short_lines_and_copies_one_letter_longer(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(14, 20))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(lines + [x + "q" for x in lines])), "doc_id long, text string")
    left = [r["text"] for r in dedup_lines(docs).orderBy("doc_id").collect()]
    assert left[:400] == lines and sum(not x for x in left[400:]) >= 380


def test_lines_without_spaces(spark):
    base = "本页面由网站管理员维护任何人不得在未经许可的情况下转载或者修改其中的内容如有疑问请联系我们的客服人员谢谢合作"
    base += base[::-1]
    lines = [base, base[:20] + "了" + base[20:], "x" + base, "完全不同的一行文字与其他任何内容都没有关系只是为了测试而已"]
    got = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [lines[0], "", "", lines[3]]


def test_rows_are_told_apart_without_ids(spark):
    quick, other = "the quick brown fox jumps over the dog", "a wholly different line of words and more"
    rows = [(1, quick, 0), (None, quick, 1), (None, other, 2), (2, f"{other}\n{quick} x", 3), (2, "short", 4), (2, "short", 5), (3, None, 6), (4, "", 7), (5, "\n  \n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int").withColumnRenamed("__gone", "gone")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "gone"]
    by = {r["gone"]: r["text"] for r in got.collect()}
    assert len(by) == len(rows)
    assert by[0] == quick and by[1] == "" and by[2] == "" and by[3] == other
    assert sorted([by[4], by[5]]) == ["", "short"]
    assert by[6] is None and by[7] == "" and by[8] == "\n  \n"


@pytest.mark.parametrize("clash", ["__gone", "row", "doc", "his", "los", "signed", "at"])
def test_columns_of_any_name(spark, clash):
    docs = spark.createDataFrame([(1, "one line of text here", "a"), (2, "one line of text here", "b")], f"doc_id long, text string, {clash} string")
    assert sorted(map(tuple, dedup_lines(docs).collect())) == [(1, "one line of text here", "a"), (2, "", "b")]


def test_no_rows_and_very_long_lines(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=300_000))
    rows = [(1, long), (2, long[:1000] + "y" + long[1000:]), (3, "".join(rng.choices("abcdefgh ", k=300_000)))]
    got = {r["doc_id"]: len(r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] and not got[2] and got[3]


@pytest.mark.parametrize("job", ["bands", "sketches", "similar_pairs"])
def test_hashing_holds_little_more_than_its_lines(job):
    """Two megabytes of lines, the most that a worker takes at once; the arrays of all their shingles would take more."""
    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdefgh ", k=400)) + "x" for _ in range(5000)]
    run = {"bands": lambda: bands(lines), "sketches": lambda: linededup.sketches()(lines), "similar_pairs": lambda: linededup.similar_pairs()([{"x": x, "y": x} for x in lines])}[job]
    tracemalloc.start()
    try:
        run()
        assert tracemalloc.get_traced_memory()[1] < 48 * sum(map(len, lines)) / 2
    finally:
        tracemalloc.stop()


def test_stretches_of_any_length_give_the_same(monkeypatch):
    rng = random.Random(8)
    lines = ["".join(rng.choices("abc本𝄞", k=rng.choice((1, 8, 9, 10, 40, 300)))) for _ in range(300)] + ["a" * 30, "abcdefghi", ""]
    long = [x for x in lines if len(x) >= SHINGLE]
    pairs = [{"x": x, "y": y} for x, y in zip(long, [y[1:] + "q" for y in long], strict=True)]
    runs = []
    for stretch in (1, 500, 1 << 30):
        monkeypatch.setattr(linededup, "STRETCH", stretch)
        runs.append((bands(long).tolist(), linededup.sketches()(lines), linededup.similar_pairs()(pairs)))
    assert runs[0] == runs[1] == runs[2]
    for (s,), p in zip(runs[0][2], pairs, strict=True):
        x, y = shingles(p["x"]), shingles(p["y"])
        assert s == len(x & y) / len(x | y)
    assert [size for _, _, size, _ in runs[0][1]] == [len(shingles(x)) if len(x.strip()) >= SHINGLE else 0 for x in lines]


def test_pairs_that_their_sketches_part_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefghij ", k=200)) for _ in range(30)]
    lines = {k: x for k, x in enumerate([y.strip() for x in base for y in (x, x + "q", x[::-1])])}
    rows = [(k, line, 0, size, sketch) for k, (line, _, size, sketch) in enumerate(linededup.sketches()(list(lines.values())))]
    table = spark.createDataFrame(rows, "hi long, line string, lo long, size long, sketch array<long>")
    pairs = spark.createDataFrame([(a, b) for a in lines for b in lines if a < b and a // 3 - b // 3 in (0, -1)], "a long, b long")
    met = []
    plain = linededup.map_texts
    monkeypatch.setattr(linededup, "map_texts", lambda df, *args: (met.append(df.count()), plain(df, *args))[1])
    got = {(r.a, r.b) for r in linededup.similar(pairs, table).collect()}
    want = {(a, b) for a, b in pairs.collect() if len(shingles(lines[a]) & shingles(lines[b])) >= SIMILARITY * len(shingles(lines[a]) | shingles(lines[b]))}
    assert got == want and len(want) >= 30
    assert met == [len(want)]

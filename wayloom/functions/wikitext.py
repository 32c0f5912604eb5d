"""Wiki markup to plain text and sections; a small helper that runs on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import filterfalse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..llm.common import slices

SECTION = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
ARTICLE = T.StructType([T.StructField("lead", T.StringType()), T.StructField("sections", T.ArrayType(SECTION))])

#: What is removed, in this order.
COMMENT = re.compile(r"<!--.*?-->", re.S)
REFERENCES = (re.compile(r"<ref[^>/]*>.*?</ref>", re.S | re.I), re.compile(r"<ref[^>]*/>", re.I))
TAGS = re.compile(r"</?(?:small|big|center|div|span|sup|sub|br|gallery|poem|blockquote)[^>]*>", re.I)
QUOTES = re.compile(r"'{2,5}")
BRACES = re.compile(r"\{\{|\{\||\}\}|\|\}")
BRACKETS = re.compile(r"\[\[|\]\]")
MEDIA = re.compile(r"\s*(?:file|image|category|media)\s*:", re.I)
EXTERNAL = ((re.compile(r"\[(?:https?|//)\S+\s+([^\]]+)\]"), r"\1"), (re.compile(r"\[(?:https?|//)\S+\]"), ""))
TABLE_LINE = re.compile(r"\s*(?:\{\||\|\}|\||!)")
LIST_MARK = re.compile(r"^[*#:;]+\s*")
BLANKS = re.compile(r"[ \t]+")
BLANK_LINES = re.compile(r"\n{3,}")
HEADING = re.compile(r"\s*(={2,6})\s*(.*?)\s*\1\s*$")


def strip_braces(text: str) -> str:
    """What stands outside all templates and tables; stray closers stay, an unclosed opener swallows the rest."""
    kept, depth, at = [], 0, 0
    for m in BRACES.finditer(text):
        if m[0][0] == "{":
            if depth == 0:
                kept.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                at = m.end()
    return "".join(kept) + ("" if depth else text[at:])


def outermost(text: str) -> list[tuple[int, int]]:
    """Where the links that stand in no other link begin and end, brackets included; unclosed ones are none."""
    spans, opened = [], []
    for m in BRACKETS.finditer(text):
        if m[0] == "[[":
            opened.append(m.start())
        elif opened and len(opened) == 1:
            spans.append((opened.pop(), m.end()))
        elif opened:
            opened.pop()
    return spans


def replaced(text: str, by: Callable[[str], str]) -> str:
    """text with by(inside) for each outermost link, then without the brackets of external links."""
    ends = [0]
    parts = []
    for begin, end in outermost(text):
        parts += [text[ends[-1] : begin], "" if MEDIA.match(text, begin + 2) else by(text[begin + 2 : end - 2])]
        ends.append(end)
    out = "".join(parts) + text[ends[-1] :]
    for pattern, with_ in EXTERNAL:
        out = pattern.sub(with_, out)
    return out


def resolve_links(text: str) -> str:
    """Links give what stands after their last bar, or before it if that is nothing; links to media give nothing.

    What stands after the last bar has no bars, so a link in it gives all that it holds.
    """

    def label(inside: str) -> str:
        bar = inside.rfind("|")
        return inside if bar < 0 else replaced(inside[bar + 1 :], str) or inside[:bar]

    return replaced(text, label)


def without(text: str, *patterns: re.Pattern) -> str:
    return reduce(lambda t, p: p.sub("", t), patterns, text)


def clean(text: str) -> str:
    """Plain text: templates and links are read after comments and references are gone, and before tags and quotes go."""
    body = without(resolve_links(strip_braces(without(text, COMMENT, *REFERENCES))), TAGS, QUOTES)
    lines = (LIST_MARK.sub("", line) for line in filterfalse(TABLE_LINE.match, body.split("\n")))
    return BLANK_LINES.sub("\n\n", "\n".join(BLANKS.sub(" ", line).strip() for line in lines)).strip()


def sections_of(text: str) -> dict:
    """Headings are found in the raw lines; what comes before the first is the lead; empty sections are left out."""
    heads: list[tuple] = [(0, "", [])]
    for line in text.split("\n"):
        if m := HEADING.match(line):
            heads.append((len(m[1]), clean(m[2]), []))
        else:
            heads[-1][2].append(line)
    cleaned = [{"level": level, "title": title, "text": clean("\n".join(raw))} for level, title, raw in heads]
    return {"lead": cleaned[0]["text"], "sections": [s for s in cleaned[1:] if s["text"]]}


@F.pandas_udf(T.StringType())
def clean_wikitext(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else clean(t))


@F.pandas_udf(T.StringType())
def braces_stripped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else strip_braces(t))


@F.pandas_udf(T.StringType())
def links_resolved(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else resolve_links(t))


def java(pattern: re.Pattern) -> Column:
    """A pattern as the JVM reads it, with its flags."""
    flags = "".join(c for c, f in (("i", re.I), ("s", re.S)) if pattern.flags & f)
    return F.lit(f"(?{flags}U){pattern.pattern}")


def strip_comments_refs_tags(text: Column) -> Column:
    """text without comments, references, tags of layout and quotes of emphasis, in the JVM."""
    return reduce(lambda t, p: F.regexp_replace(t, java(p), F.lit("")), (COMMENT, *REFERENCES, TAGS, QUOTES), text)


def clean_lines(text: Column) -> Column:
    """text without lines of tables, without list marks, with single spaces and at most one blank line, in the JVM."""
    ends = F.lit(r"(?U)^\s+|\s+$")
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.regexp_like(x, F.lit(f"(?U)^{TABLE_LINE.pattern}")))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, java(LIST_MARK), F.lit("")), java(BLANKS), F.lit(" ")), ends, F.lit("")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), java(BLANK_LINES), F.lit("\n\n")), ends, F.lit(""))


def split_sections(rows: DataFrame) -> DataFrame:
    """rows with a, the lead and the sections (ARTICLE) of their column text.

    Texts are parsed and handed back in runs of a few megabytes, however many rows come at once.
    """
    at, schema = rows.columns.index("text"), T.StructType([*rows.schema.fields, T.StructField("a", ARTICLE)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                articles = pa.array([sections_of(t or "") for t in part.column(at).to_pylist()], arrow.field("a").type)
                kept = [column.cast(field.type) for column, field in zip(part.columns, arrow)]
                yield pa.RecordBatch.from_arrays([*kept, articles], schema=arrow)

    return rows.mapInArrow(run, schema)


def first_paragraphs(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != ""), 1, n), "\n\n")


def pick_section(sections: Column, candidates: tuple[str, ...]) -> Column:
    """Text of the first candidate heading whose last section has more than 40 characters."""

    def last(name: str) -> Column:
        hits = F.filter(sections, lambda s: F.lower(F.trim(s["title"])) == name)
        text = F.try_element_at(hits, F.lit(-1))["text"]
        return F.when(F.length(text) > 40, text)

    return F.coalesce(*(last(c) for c in candidates))


def long_sections(sections: Column, but: tuple[str, ...]) -> Column:
    """The first four sections of more than 200 characters down to level 3, but for descriptions; null if none."""
    long = F.filter(sections, lambda s: (s["level"] <= 3) & (F.length(s["text"]) > 200) & ~F.lower(F.trim(s["title"])).isin(*but))
    return F.nullif(F.array_join(F.slice(F.transform(long, lambda s: s["text"]), 1, 4), "\n\n"), F.lit(""))


def is_redirect(text: Column) -> Column:
    return F.startswith(F.lower(F.trim(text)), F.lit("#redirect"))

"""Histories of places from several wikis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint
from ..functions.text import title_keys
from ..functions.wikitext import first_paragraphs, is_redirect, long_sections, pick_section, split_sections

#: Headings in order of preference.
HISTORY = ("history", "recent events", "background", "recent history", "notable events", "events", "legends and history")
DUMP_HISTORY = ("history", "recent events", "background", "legends", "recent history")
DESCRIPTION = ("description", "geography", "layout", "the castle", "overview")
SOURCE = "struct<wiki:string,title:string,url:string,canon:string,license:string>"


def latest_revision(revisions: DataFrame, with_text: Callable[[DataFrame], DataFrame] = lambda last: last) -> DataFrame:
    """(title, rev_no, text) of the last revision of each page; a page whose last text is empty goes.

    The number is found first; texts join only for the last revisions, so that no aggregation carries texts. Where
    revisions name their texts instead of holding them, with_text adds the column text to the last ones alone.
    """
    last = revisions.groupBy("title").agg(F.max("rev_no").alias("rev_no"))
    found = with_text(revisions.join(last, ["title", "rev_no"], "left_semi"))
    return found.where("text IS NOT NULL AND text <> ''").dropDuplicates(["title", "rev_no"]).select("title", "rev_no", "text")


def wanted_titles(places: DataFrame) -> DataFrame:
    """(key, slug): the first place of each title key."""
    return places.select("slug", "place_idx", F.explode(title_keys(F.col("name"))).alias("key")).groupBy("key").agg(F.min_by("slug", "place_idx").alias("slug"))


def title_lookup(pages: DataFrame, places: DataFrame) -> DataFrame:
    """pages with the slug of the place that their title names."""
    return pages.join(wanted_titles(places), F.lower(pages["title"]) == F.col("key")).drop("key")


def pending_titles(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    return wanted.join(cached.select("wiki", "slug"), ["wiki", "slug"], "left_anti")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(title, page): where chains of (title, target) end; a chain that runs in a circle gives no page.

    Pointers jump twice as far each round, so rounds grow with the logarithm of the longest chain.
    """
    now = checkpoint(aliases.select("title", F.col("target").alias("page"), F.lit(False).alias("ended")))
    open_before = -1
    while True:
        ahead = now.select(F.col("title").alias("t"), F.col("page").alias("p"), F.col("ended").alias("e"))
        step = now.join(ahead, (F.col("page") == F.col("t")) & ~F.col("ended"), "left")
        ended = F.col("ended") | F.col("t").isNull() | F.coalesce("e", F.lit(False))
        now = checkpoint(step.select("title", F.coalesce("p", "page").alias("page"), ended.alias("ended")))
        still_open = now.where("NOT ended").count()
        if still_open in (0, open_before):  # a round that ends no chain leaves circles alone
            break
        open_before = still_open
    return now.where("ended").select("title", "page")


def extract(pages: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """pages (slug, title, text) with summary, description and history; redirects go, and empty texts count as null."""
    parsed = split_sections(pages.where(~is_redirect(F.col("text"))))
    s = F.col("a.sections")
    history = F.coalesce(pick_section(s, headings), long_sections(s, DESCRIPTION))
    return parsed.select(
        *pages.columns, F.nullif(first_paragraphs(F.col("a.lead"), 2), F.lit("")).alias("summary"),
        pick_section(s, DESCRIPTION).alias("description"), history.alias("history"),
    )


def dedupe_page_match(pages: DataFrame) -> DataFrame:
    """The first page by page_idx for each slug."""
    first = pages.groupBy("slug").agg(F.min("page_idx").alias("page_idx"))
    return pages.join(first, ["slug", "page_idx"], "left_semi")


def _source(wiki: str, alias: str, canon: str) -> Column:
    t = F.col(f"{alias}.title")
    fields = F.struct(F.lit(wiki).alias("wiki"), t.alias("title"), F.col(f"{alias}.url").alias("url"), F.lit(canon).alias("canon"), F.lit("CC BY-SA").alias("license"))
    return F.when(t.isNotNull(), fields)


def merge_lore_two(places: DataFrame, book: DataFrame, screen: DataFrame) -> DataFrame:
    """One row a place: book before screen in each field; both wikis' sources; the screen's history apart if both exist."""
    out = places.alias("p").join(book.alias("b"), "slug", "left").join(screen.alias("s"), "slug", "left")
    some = lambda c: F.coalesce(F.nullif(f"b.{c}", F.lit("")), F.nullif(f"s.{c}", F.lit(""))).alias(c)
    both = F.col("b.title").isNotNull() & F.col("s.title").isNotNull()
    return out.select(
        "slug", "p.name", (F.col("b.title").isNotNull() | F.col("s.title").isNotNull()).alias("hasLore"), some("summary"), some("description"), some("history"),
        F.when(both, F.col("s.history")).alias("screenHistory"), F.array_compact(F.array(_source("book", "b", "books"), _source("screen", "s", "screen"))).cast(f"array<{SOURCE}>").alias("sources"),
    )


def merge_lore_dump(lore: DataFrame, dump: DataFrame, wiki: str = "dump") -> DataFrame:
    """lore with a third source that comes first in each field and in sources, and replaces its own earlier entry."""
    out = lore.alias("l").join(dump.alias("d"), "slug", "left")
    some = lambda c: F.coalesce(F.nullif(f"d.{c}", F.lit("")), F.col(f"l.{c}")).alias(c)
    found = F.col("d.title").isNotNull()
    rest = F.filter("l.sources", lambda s: s["wiki"] != wiki)
    sources = F.when(found, F.concat(F.array(_source(wiki, "d", "books")), rest)).otherwise(F.col("l.sources"))
    return out.select("slug", "l.name", (F.col("l.hasLore") | found).alias("hasLore"), some("summary"), some("description"), some("history"), "l.screenHistory", sources.alias("sources"))


def lore_gain(before: DataFrame, dump: DataFrame) -> DataFrame:
    """One row: pages matched, articles and histories that the third source adds."""
    met = before.alias("l").join(dump.alias("d"), "slug")
    return met.agg(
        F.count("*").alias("matched"), F.count_if(~F.col("l.hasLore")).alias("gained_articles"),
        F.count_if(F.nullif("d.history", F.lit("")).isNotNull() & F.col("l.history").isNull()).alias("gained_histories"),
    )

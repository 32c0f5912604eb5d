"""Names, numbers and small presentation texts as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def slugify(name: Column) -> Column:
    """Compatibility-decomposed, without what is not ASCII; runs of others than letters and digits become '-'."""
    ascii_only = F.regexp_replace(_decomposed(F.coalesce(name, F.lit(""))), r"[^\x00-\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unnamed"))


def coerce_int(text: Column) -> Column:
    """Whole part of a number in text; null for blank or malformed text."""
    return F.trim(text).try_cast("double").try_cast("int")


def title_keys(name: Column) -> Column:
    """The name in lower case, and the same without the first 'the ' wherever it stands."""
    low = F.lower(name)
    at = F.instr(low, "the ")
    short = F.when(at > 0, F.concat(F.substring(low, F.lit(1), at - 1), F.substring(low, at + 4, F.length(low)))).otherwise(low)
    return F.array_distinct(F.array(low, short))


def plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def humanise_days(days: Column) -> Column:
    """Hours below a day, days below two weeks, then weeks, and from 30 days on months and weeks."""
    whole = lambda c: F.floor(c + 0.5).cast("long")
    total = whole(days)
    months = F.floor(total / 30).cast("long")
    rest = whole((total - months * 30) / 7)
    long_text = F.when(rest > 0, F.concat(plural(months, "month"), F.lit(", "), plural(rest, "week"))).otherwise(plural(months, "month"))
    return (
        F.when(days < 1.0 / 24, "less than an hour")
        .when(days < 1, plural(whole(days * 24), "hour"))
        .when(days < 14, plural(total, "day"))
        .when(months == 0, F.concat(whole(total / 7).cast("string"), F.lit(" weeks")))
        .otherwise(long_text)
    )


def html_paragraphs(text: Column, most: int) -> Column:
    """The first blocks of text between blank lines, escaped, each in <p>."""

    def wrapped(block: Column) -> Column:
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            block = F.replace(block, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit("<p>"), block, F.lit("</p>"))

    blocks = F.filter(F.split(text, "\n\n"), lambda b: F.trim(b) != "")
    return F.array_join(F.transform(F.slice(blocks, 1, most), lambda b: wrapped(F.trim(b))), "")


def article_url(base: str, title: Column, encode: bool) -> Column:
    """base and the title with underscores; encoded, all but unreserved characters and '/' in percent form."""
    name = F.replace(title, F.lit(" "), F.lit("_"))
    if encode:
        name = F.url_encode(name)
        for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
            name = F.replace(name, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), name)

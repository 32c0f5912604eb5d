"""Token counts without a shuffle of pre-tokens.

Two tiers on the map side: a broadcast table with the token counts of frequent pre-tokens, and behind it a cache in
each Python worker that asks the tokenizer for whatever the table lacks. The table comes from a bounded sample and
only saves work: what it lacks is encoded, so no count depends on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_texts
from .pretokens import splitter

#: Entries of a worker's cache; beyond it the cache starts again from the broadcast table.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are counted but not kept.
KEPT_CHARS = 64


def frequent_lengths(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", sample_docs: int = 1000, sample_chars: int = 20_000, entries: int = 65_536
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a sample: sample_docs documents of at most sample_chars characters.

    The bound on the broadcast is entries * KEPT_CHARS characters.
    """
    text = F.col(text_col)
    sample = docs.select(text.alias("text")).where(F.char_length(text) <= sample_chars).orderBy(F.xxhash64("text"), "text").limit(sample_docs)
    split, seen = splitter(), Counter()
    for row in sample.toLocalIterator():
        seen.update(p for p in split(row[0]) if len(p) <= KEPT_CHARS)
    pieces = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    counts = Tokenizer.from_file(tokenizer_path).encode_batch_fast(pieces, add_special_tokens=False)
    return dict(zip(pieces, map(len, counts), strict=True))


def counter(tokenizer_path: str, frequent: dict[str, int]) -> Callable[[list], list[tuple]]:
    """A function from texts to (n_tokens,), exact for any table of frequent pre-tokens."""
    tokenizer = Tokenizer.from_file(tokenizer_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    split, lengths = splitter(), dict(frequent)

    def pieces_of(text: str) -> tuple[int, list[str]]:
        """Strings of special tokens count one each, and split what stands round them."""
        parts, n = [text], 0
        for s in special:
            if s in text:
                cut = [p.split(s) for p in parts]
                n += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
        return n, split(text) if len(parts) == 1 else [p for part in parts for p in split(part)]

    def count(texts: list) -> list[tuple]:
        nonlocal lengths
        cut = [pieces_of(t) if t else (0, []) for t in texts]
        wanted = set().union(*(pieces for _, pieces in cut))
        missing = list(wanted.difference(lengths))
        if len(lengths) + len(missing) > CACHE_ENTRIES:
            lengths = dict(frequent)
            missing = list(wanted.difference(lengths))
        lengths |= zip(missing, map(len, tokenizer.encode_batch_fast(missing, add_special_tokens=False)), strict=True)
        out = [(n + sum(map(lengths.__getitem__, pieces)),) for n, pieces in cut]
        for p in missing:
            if len(p) > KEPT_CHARS:
                del lengths[p]
        return out

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs, in one pass and without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and repeated or null ids each give a row of their
    own; an empty table gives an empty result; other columns are ignored. Long texts are counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text_col))
    rows = docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    counted = map_texts(rows, lambda: counter(tokenizer_path, shared.value), "n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

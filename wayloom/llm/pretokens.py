"""Splitting text into pre-tokens exactly as the Rust tokenizer libraries do."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import public_tokenizers
from tokenizers import Regex, pre_tokenizers

#: Below this code point (Latin letters) all Unicode versions agree on letters, numbers and white space.
SETTLED = 0x250


def _class(kind: str) -> str:
    return "".join(f"\\U{c:08x}" for c in range(SETTLED) if unicodedata.category(chr(c))[0] == kind)


def splitter() -> Callable[[str], list[str]]:
    """A function that gives the pre-tokens of a text.

    Latin text is split by the re module with the pattern's classes spelt out; any other text by the library itself,
    as its Unicode tables may be of another version than Python's.
    """
    letters, numbers, spaces = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    pattern = pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    find = re.compile(pattern.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")).findall
    unsettled = re.compile(f"[^\\x00-{chr(SETTLED - 1)}]").search
    library = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")

    def split(text: str) -> list[str]:
        if text.isascii() or not unsettled(text):
            return find(text)
        return [piece for piece, _ in library.pre_tokenize_str(text)]

    return split

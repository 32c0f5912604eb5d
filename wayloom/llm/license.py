"""License scans by a positional index of rare words.

Each template is a sequence of words with one or more mandatory key phrases: a notice, or a whole licence text. The index
keeps, for the few words of a template that are rarest in the scanned corpus, the positions where they stand in it. A
file's words are looked up in the index; each find votes for the place where the template would begin. A notice needs
all its votes at one place; a whole text needs most of them, at places no more than its slack apart, as words may be
added or left out. Such places are verified: every key phrase must stand word for word where the template has it, within
the slack.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: How many of its rarest words a notice and a whole text put into the index, and the share of a whole text's that must vote.
RARE_WORDS, TEXT_WORDS, VOTES = 3, 16, 0.6
#: By how many words a whole text may be longer or shorter between its places.
SLACK = 12


@dataclass(frozen=True)
class Template:
    """keys: the phrases that must stand at their places in the text; all of it if there are none."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    slack: int = 0

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    def places(self) -> list[tuple[int, list[bytes]]]:
        """Each key phrase with its offset in the template."""
        words, out = self.words, []
        for key in self.keys or (self.text,):
            k = key.encode().split()
            out.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        return out


#: The phrases that every scan looks for.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Notices of common licences, lower case, without punctuation.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute this software",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
)
#: Whole licence texts, lower case, without punctuation.
TEXTS = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense"), slack=SLACK,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is "
        "provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed",
        ("redistribution and use in source and binary forms", "must reproduce the above copyright notice"), slack=SLACK,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
        ("permission to use copy modify and or distribute this software", "appear in all copies"), slack=SLACK,
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("under the apache license version 2 0", "except in compliance with the license"), slack=SLACK,
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"), slack=SLACK,
    ),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"), slack=SLACK,
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
        "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain", "commercial or non commercial"), slack=SLACK,
    ),
)
TEMPLATES = BASE + NOTICES + TEXTS

find_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and anything outside ASCII; A-Z count as a-z."""
    return find_words(text.lower()) if text else []


def document_frequency(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """In how many texts of docs each template word stands: one row a word, as many as the templates have."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count() -> Callable[[list], list[tuple]]:
        return lambda texts: [([w.decode() for w in vocabulary.intersection(words_of(t))],) for t in texts]

    rows = docs.select(F.lit(1).alias("one"), F.col(text_col).cast("binary").alias("text"))
    found = map_texts(rows, count, "words array<string>").select(F.explode("words").alias("word")).groupBy("word").count()
    return {r["word"].encode(): r["count"] for r in found.collect()}


def scanner(templates: tuple[Template, ...], frequency: dict[bytes, int]) -> Callable[[list], list[tuple]]:
    """A function from texts to (n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    needed, places, stands = [], [t.places() for t in templates], [t.words for t in templates]
    for k, t in enumerate(templates):
        # of a notice only its key phrases must stand, so only their words lead to it
        certain = dict(enumerate(stands[k])) if t.slack else {at + i: w for at, key in places[k] for i, w in enumerate(key)}
        idf = {i: -math.log1p(frequency.get(w, 0)) for i, w in certain.items()}
        rare = sorted(certain, key=lambda i: (-idf[i], i))[: TEXT_WORDS if t.slack else RARE_WORDS]
        for i in rare:
            index[certain[i]].append((k, i))
        needed.append(math.ceil(VOTES * len(rare)) if t.slack else len(rare))

    def stands_near(words: list[bytes], key: list[bytes], at: int, slack: int) -> bool:
        return any(words[i : i + len(key)] == key for i in range(max(at - slack, 0), at + slack + 1))

    def found_at(k: int, votes: list[tuple[int, int]], words: list[bytes]) -> Iterator[int]:
        """The verified beginnings of template k by its votes (start, word of the template)."""
        slack, low = templates[k].slack, 0
        inside: Counter = Counter()
        done = None
        for start, i in votes:
            inside[i] += 1
            while votes[low][0] < start - slack:
                inside[votes[low][1]] -= 1
                if not inside[votes[low][1]]:
                    del inside[votes[low][1]]
                low += 1
            if len(inside) < needed[k] or done == votes[low][0]:
                continue
            first = done = votes[low][0]
            # the places of a whole text are told by the middle of its votes
            middle = (first + start) // 2
            if all((slack or middle + at >= 0) and stands_near(words, key, middle + at, slack) for at, key in places[k]):
                yield middle

    def share(k: int, start: int, words: list[bytes]) -> float:
        slack = templates[k].slack
        near = (words[max(start + i - slack, 0) : max(start + i + slack + 1, 0)] for i in range(len(stands[k])))
        return sum(w in ws for w, ws in zip(stands[k], near, strict=True)) / len(stands[k])

    def scan(text: bytes | None) -> tuple:
        words = words_of(text)
        votes: dict[int, list] = defaultdict(list)
        for at, w in enumerate(words):
            for k, i in index.get(w, ()):
                votes[k].append((at - i, i))
        starts, labels, base_labels, score = [], set(), set(), 0.0
        for k, own in votes.items():
            t = templates[k]
            for start in found_at(k, sorted(own), words):
                labels.add(t.label)
                if score < 1:
                    score = max(score, share(k, start, words))
                if t.base:
                    base_labels.add(t.label)
                    starts.append(start)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
        )

    return lambda texts: [scan(t) for t in texts]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    score is the largest share of a found template's words that stand in place, within its slack. A null text has no words, no labels
    and score 0; repeated rows and null ids each give a row of their own; an empty table gives an empty result; other
    columns are ignored. The words' frequencies are counted over all of docs; nothing is shuffled but those counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(document_frequency(docs, text_col, templates))
    text: Column = F.col(text_col).cast("binary")
    return map_texts(
        docs.select(F.col(id_col), text.alias("text")),
        lambda: scanner(templates, shared.value),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )

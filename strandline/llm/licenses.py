"""Fuzzy search for short licence notices.

A notice that occurs with at most k edits holds at least one of any k + 1
pieces of it unchanged (pigeonhole).  One automaton finds all pieces of all
notices in a single pass; around each hit, bounded-error matching of the
``regex`` library verifies the edits and gives the span, which must be of whole
words and hold the words that name the licence unedited.  Texts are searched as
their lower-cased words with one blank between, so line breaks and punctuation
inside a notice cost no edits.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm.common import LOWER, TEXT_WORDS, bounded_batches, pieces, utf8

# Phrases whose exact places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Well-known notices, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "released under the isc license": "isc",
    "licensed under the isc license": "isc",
    "spdx license identifier isc": "isc",
    "licensed under the apache license version 2 0": "apache",
    "released under the apache license version 2 0": "apache",
    "spdx license identifier apache 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu general public license version 2": "gpl-2",
    "under the terms of the gnu general public license version 3": "gpl-3",
    "spdx license identifier gpl 2 0": "gpl-2",
    "spdx license identifier gpl 3 0": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "spdx license identifier lgpl 2 1": "lgpl",
    "spdx license identifier lgpl 3 0": "lgpl",
    "gnu affero general public license": "agpl",
    "spdx license identifier agpl 3 0": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3",
    "released under the bsd 2 clause license": "bsd-2",
    "released under the bsd 3 clause license": "bsd-3",
    "licensed under the bsd 2 clause license": "bsd-2",
    "licensed under the bsd 3 clause license": "bsd-3",
    "spdx license identifier bsd 2 clause": "bsd-2",
    "spdx license identifier bsd 3 clause": "bsd-3",
    "subject to the terms of the mozilla public license": "mpl",
    "released under the mpl license": "mpl",
    "licensed under the mpl license": "mpl",
    "spdx license identifier mpl 2 0": "mpl",
    "made available under the terms of the eclipse public license": "epl",
    "released under the epl license": "epl",
    "licensed under the epl license": "epl",
    "spdx license identifier epl 2 0": "epl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under a creative commons attribution sharealike": "cc-by-sa",
    "licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "licensed under a creative commons attribution noderivatives": "cc-by-nd",
    "licensed under a creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "licensed under a creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "dedicated to the public domain under cc0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Words that name a licence or its version. A span must hold exactly those of its notice, each unedited.
NAMING = frozenset(
    "mit isc apache gnu gpl lgpl agpl lesser affero bsd mpl mozilla epl eclipse cc cc0 by sa nc nd creative commons attribution sharealike noncommercial noderivatives noderivs share alike non commercial derivatives"
    " unencumbered 0 1 2 3 4 5".split())
# Of these, words that make another licence of the one they stand beside.
MODIFIERS = frozenset("sa nc nd sharealike noncommercial noderivatives noderivs share non no".split())
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def seeds_of(notice: str) -> list[tuple[int, str]]:
    """The k + 1 pieces of a notice, with where they begin."""
    cuts = np.linspace(0, len(notice), edits_of(notice) + 2).astype(int).tolist()
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _search(searched: tuple[str, ...]) -> tuple[ahocorasick.Automaton, dict[str, regex.Pattern]]:
    found, by_seed = ahocorasick.Automaton(), {}
    for notice in searched:
        for at, seed in seeds_of(notice):
            by_seed.setdefault(seed, []).append((notice, at))
    for seed, where in by_seed.items():
        found.add_word(seed, (len(seed), where))
    found.make_automaton()
    return found, {n: regex.compile(rf"(?b)(?:{regex.escape(n, special_only=True)}){{e<={edits_of(n)}}}") for n in searched}


def notices(text: str, searched: tuple[str, ...] = tuple(NOTICES)) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) in a text of words; of spans of a notice that overlap, that with the fewest edits.

    Every seed's own window is searched, so no better match elsewhere hides a
    notice; a window is no longer than a notice and its edits.
    """
    automaton, patterns = _search(searched)
    windows: dict[str, set[tuple[int, int]]] = {}
    for last, (size, where) in automaton.iter(text):
        for notice, at in where:
            k = edits_of(notice)
            begin = max(0, last + 1 - size - at - k)
            windows.setdefault(notice, set()).add((begin, min(len(text), begin + len(notice) + 2 * k + 1)))
    found = []
    for notice, own in windows.items():
        heap: list[tuple[int, int, int, int, int]] = []

        def look(begin: int, end: int, notice: str = notice, heap: list = heap) -> None:
            if end - begin >= len(notice) - edits_of(notice) and (m := patterns[notice].search(text, begin, end)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), begin, end))

        for begin, end in own:
            look(begin, end)
        taken: list[tuple[int, int, int]] = []
        while heap:
            edits, start, stop, begin, end = heapq.heappop(heap)
            at = bisect.bisect(taken, (start, stop, edits))
            clash = next((s for s in taken[max(0, at - 1) : at + 1] if s[0] < stop and start < s[1]), None)
            if clash is None:
                taken.insert(at, (start, stop, edits))
            else:
                # What is beside the better span may hold another.
                look(begin, clash[0])
                look(clash[1], end)
        found += [(notice, *span) for span in taken]
    return found


def whole_notices(text: str, searched: tuple[str, ...] = tuple(NOTICES), naming: frozenset[str] = NAMING) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) of spans of whole words that hold the ``naming`` words of their notice, in order, and no others.

    A span that begins or ends inside a word takes that word in or leaves it
    out, whichever costs fewer edits; the edits of all its words must be within
    the notice's bound.  So no edit falls on the word that names the licence,
    and a span beside a word that makes another licence of it is none.  Of spans
    of different notices that overlap, that with the most characters stays,
    an edit counting as many as allow one; then that with the fewest edits.
    """
    found = []
    _, patterns = _search(searched)
    for notice, start, end, _ in notices(text, searched):
        start, end = start + len(text[start:end]) - len(text[start:end].lstrip(" ")), end - len(text[start:end]) + len(text[start:end].rstrip(" "))
        before, after = text.rfind(" ", 0, start) + 1, text.find(" ", end) if " " in text[end:] else len(text)
        begins = {before, start if before == start else text.find(" ", start) + 1 or len(text)}
        ends = {after, end if after == end else text.rfind(" ", 0, end)}
        best = None
        for a in begins:
            for b in ends:
                if 0 <= a < b and (m := patterns[notice].fullmatch(text, a, b)) and (best is None or (sum(m.fuzzy_counts), a, b) < best):
                    best = (sum(m.fuzzy_counts), a, b)
        if best is None:
            continue
        edits, a, b = best
        named = [w for w in notice.split() if w in naming]
        if [w for w in text[a:b].split() if w in naming] != named:
            continue
        beside = {w for w in (*text[max(0, a - 40) : a].split()[-1:], *text[b : b + 40].split()[:1])}
        if named and beside & MODIFIERS:
            continue
        found.append((CHARS_PER_EDIT * edits - len(notice), edits, a, b, notice))
    kept: list[tuple[int, int, str, int]] = []
    for _, edits, a, b, notice in sorted(found):
        at = bisect.bisect(kept, (a,))
        if all(y <= a or b <= x for x, y, *_ in kept[max(0, at - 1) : at + 1]):
            kept.insert(at, (a, b, notice, edits))
    return [(notice, a, b, edits) for a, b, notice, edits in kept]


def base_places(text: str) -> list[tuple[int, str]]:
    """(word, label) of all exact places of the base phrases."""
    found, padded = [], f" {text} "
    for phrase, label in BASE.items():
        at, word, counted = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, counted = word + padded.count(" ", counted, at), at
            found.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    return found


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))
_BASE_PLACE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, searched: dict[str, str] = NOTICES, naming: frozenset[str] = NAMING) -> DataFrame:
    """(doc_id, n_words, base, spans): exact places and fuzzy spans in every text.

    ``base`` holds the word where a base phrase begins and its label; ``spans``
    the label, first and last word, edits and similarity (1 less edits over the
    notice's length) of each verified notice.  Null and empty texts have no
    words and empty lists.  Extra columns are ignored.

    ``searched`` gives the notices, as lower-cased words with one blank
    between, and their labels: a list that a task can hold, however long the
    texts are.  ``notice_table`` makes one from a table.  Which spans count is
    said at ``whole_notices``; ``naming`` gives the words that must be unedited.
    Texts are compared by bytes, so a letter of two bytes in place of another
    costs two edits.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    to_words = np.where(TEXT_WORDS[LOWER], LOWER, 32).astype(np.uint8).tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_words, base, spans = [], [], []
            for first, last in pieces(offsets):
                for i in range(first, last):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().translate(to_words).split(b" ")
                    own = [w for w in own if w]
                    text = b" ".join(own).decode("latin-1")
                    n_words.append(len(own))
                    base.append([{"word": w, "label": x} for w, x in base_places(text)] if "license" in text else [])
                    hits = whole_notices(text, tuple(searched), naming)
                    blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32) if hits else None
                    word = lambda at: int(np.searchsorted(blanks, at))  # noqa: B023, E731
                    spans.append([
                        {"label": searched[n], "first_word": word(s), "last_word": word(e - 1), "edits": k, "similarity": 1 - k / len(n)}
                        for n, s, e, k in hits
                    ])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(base, _BASE_PLACE), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "base", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, base array<struct<word: long, label: string>>, spans array<struct<label: string, first_word: long, last_word: long, edits: int, similarity: double>>")


def notice_table(table: DataFrame, most: int = 100_000) -> dict[str, str]:
    """The notices of a table (notice, label), as words; more than ``most`` are an error, never cut."""
    rows = table.select("notice", "label").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} notices")
    to_words = bytes(int(LOWER[b]) if TEXT_WORDS[LOWER[b]] else 32 for b in range(256))
    words = {" ".join((r["notice"] or "").encode().translate(to_words).decode("latin-1").split(" ")): r["label"] for r in sorted(rows, key=lambda r: (r["notice"] or "", r["label"] or ""))}
    return {" ".join(w.split()): label for w, label in words.items() if w.split()}


def license_digest(docs: DataFrame) -> DataFrame:
    """The registered query: counts, places, labels and the best similarity."""
    from pyspark.sql import functions as F

    found = scan_licenses(docs)
    base, own = F.col("base.label"), F.col("spans.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["first_word"].alias("first_word"), s["last_word"].alias("last_word"), s["edits"].alias("edits"))).alias("spans"),
    )

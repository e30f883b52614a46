"""Operator 4: fuzzy search for short license notices.

Texts become word streams: A-Z in lower case, words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], single spaces between
them. A notice that may differ in k edits is split into k+1 pieces; whatever the edits, one piece stays
intact (pigeonhole), so exact search for the pieces finds every place where the notice can be. There the
regex library's bounded-error matching (`(?e)(?<= )(?:notice){e<=k}(?= )`) verifies the edits and reports them (substituted, inserted
and lost letters) with the span, which begins and ends at word borders. A span counts if it is the notice misspelt and not other
words: word by word, each is the notice's own with at most one edit for each four letters (none below four) or two neighbours exchanged, its first letter kept or
lost, and is no word of its own (`OTHER`); whole words may stand between or be missing, letter by letter and space counted as edits; and
all edits are k at most. Or it differs in its spacing only. So "all rights preserved" is no "all rights reserved", and "open software licensee"
no license.

Notices with k = 0 are their own piece, and all places where their words stand are reported. Null and empty texts have no
words and no match. Whole texts are searched, in time linear in their length; a text is handled by itself, so an empty
table, repeated rows, rows without doc_id and extra columns need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, texts_of, words_of


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int
    base: bool = False


#: Phrases and labels.
BASE = (
    Notice("cc-by", "cc by", 0, True),
    Notice("gpl", "general public license", 0, True),
    Notice("reserved", "all rights reserved", 0, True),
)
#: Notices of well-known licences and reservations, with the edits that each may have.
NOTICES = (
    *BASE,
    Notice("afl", "academic free license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("agpl", "gnu agpl", 0),
    Notice("apache", "licensed under the apache license", 3),
    Notice("apache", "apache license", 1),
    Notice("apache", "apache license version 2 0", 2),
    Notice("apache", "apache software license", 2),
    Notice("artistic", "the artistic license", 1),
    Notice("beerware", "the beer ware license", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "2 clause bsd", 0),
    Notice("bsd", "3 clause bsd", 0),
    Notice("bsd", "bsd 2 clause", 0),
    Notice("bsd", "bsd 3 clause", 0),
    Notice("bsd", "bsd license", 1),
    Notice("bsd", "the bsd license", 0),
    Notice("bsl", "boost software license", 2),
    Notice("cc", "creative commons attribution", 2),
    Notice("cc", "creative commons license", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-nd", "cc by nd", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc0", "creative commons zero", 1),
    Notice("cc0", "cc0 1 0 universal", 0),
    Notice("cddl", "common development and distribution license", 3),
    Notice("cpl", "common public license", 1),
    Notice("ecl", "educational community license", 2),
    Notice("epl", "eclipse public license", 1),
    Notice("eupl", "european union public licence", 2),
    Notice("gfdl", "gnu free documentation license", 2),
    Notice("gpl", "general public license", 1),
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl", "gnu gpl", 0),
    Notice("gpl", "gpl v2", 0),
    Notice("gpl", "gpl v3", 0),
    Notice("gpl", "gpl version 2", 0),
    Notice("gpl", "gpl version 3", 0),
    Notice("gpl", "gplv2", 0),
    Notice("gpl", "gplv3", 0),
    Notice("gpl", "this program is free software you can redistribute it and or modify it", 5),
    Notice("isc", "isc license", 1),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("lgpl", "gnu lgpl", 0),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("lgpl", "gnu library general public license", 2),
    Notice("mit", "mit license", 1),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "licensed under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("mpl", "mozilla public license", 1),
    Notice("mpl", "mpl 2 0", 0),
    Notice("ms-pl", "microsoft public license", 2),
    Notice("ncsa", "university of illinois ncsa open source license", 4),
    Notice("odbl", "open database license", 1),
    Notice("ofl", "sil open font license", 1),
    Notice("osl", "open software license", 1),
    Notice("postgresql", "the postgresql license", 1),
    Notice("psf", "python software foundation license", 3),
    Notice("public-domain", "released into the public domain", 2),
    Notice("public-domain", "dedicated to the public domain", 2),
    Notice("reserved", "all rights reserved", 1),
    Notice("reserved", "no part of this publication may be reproduced", 4),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
    Notice("zlib", "zlib license", 1),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 5),
)

#: Words that are near a notice's word and no misspelling of it.
OTHER = frozenset((b"licensee", b"licensees", b"licenses", b"licences", b"licensing", b"licensor", b"licensors", b"publics", b"generally", b"publicly", b"rightly", b"preserved", b"reversed"))

MATCH = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,edits:int,substituted:int,inserted:int,lost:int,first_word:long,n_words:long,found:string>>"
NAMES = ("label", "base", "edits", "substituted", "inserted", "lost", "first_word", "n_words", "found")
_MATCH = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("substituted", pa.int32()), ("inserted", pa.int32()), ("lost", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("found", pa.string())])))])


def pieces(words: str, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of near equal length with their places in the notice."""
    data, n = words.encode(), edits + 1
    cuts = [len(data) * k // n for k in range(n + 1)]
    return [(a, data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for x in a:
        before, row[0] = row[0], row[0] + 1
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (x != y))
    return row[-1]


def word_edits(found: bytes, word: bytes) -> int | None:
    """The edits by which found is a misspelling of the word; None if it is another word."""
    if found == word:
        return 0
    if len(word) < 4 or found in OTHER:
        return None
    if found == word[1:]:
        return 1
    if len(found) == len(word) and found[:1] == word[:1]:
        apart = [k for k, (a, b) in enumerate(zip(found, word, strict=True)) if a != b]
        if len(apart) == 2 and apart[1] == apart[0] + 1 and found[apart[0]] == word[apart[1]] and found[apart[1]] == word[apart[0]]:
            return 2  # neighbours changed places
    edits = edit_distance(found, word) if found[:1] == word[:1] else len(word)
    return edits if edits <= len(word) // 4 else None


def misspelt(found: list[bytes], words: list[bytes], most: int) -> int | None:
    """The fewest edits by which found is a misspelling of words, both ends included; None if it is something else."""
    if len(found) != len(words) and b"".join(found) == b"".join(words) and abs(len(found) - len(words)) <= most:
        return abs(len(found) - len(words))
    row: list[int | None] = [None] * (len(words) + 1)  # fewest edits with so many of the words used
    row[0] = 0
    for k, a in enumerate(found):
        before, row = row, [None] * (len(words) + 1)
        for j, b in enumerate(words):
            ways = []
            if before[j] is not None and (edits := word_edits(a, b)) is not None:
                ways.append(before[j] + edits)
            if before[j + 1] is not None and 0 < k < len(found) - 1:  # a word more
                ways.append(before[j + 1] + len(a) + 1)
            if row[j] is not None and 0 < j < len(words) - 1:  # a word less
                ways.append(row[j] + len(b) + 1)
            row[j + 1] = min((w for w in ways if w <= most), default=None)
        # nothing else may follow the last word, nor stand before the first
        row[0] = None
    return row[-1]


class Finder:
    """Finds one notice in a word stream that has a space at either end."""

    def __init__(self, notice: Notice):
        import regex

        self.notice, self.data = notice, notice.words.encode()
        self.words, self.pieces = self.data.split(), pieces(notice.words, notice.edits)
        if notice.edits:
            self.fuzzy = regex.compile(rb"(?e)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(self.data), notice.edits))

    def windows(self, stream: bytes) -> Iterator[tuple[int, int]]:
        """Where a piece is, widened to the whole notice and a space at either end, and merged."""
        k, spans = self.notice.edits + 1, []
        for offset, piece in self.pieces:
            at = stream.find(piece)
            while at >= 0:
                spans.append((max(0, at - offset - k), min(len(stream), at - offset + len(self.data) + k)))
                at = stream.find(piece, at + 1)
        start, end = -1, -1
        for a, b in sorted(spans):
            if a > end and end >= 0:
                yield start, end
            start, end = (start, max(end, b)) if a <= end else (a, b)
        if end >= 0:
            yield start, end

    def find(self, stream: bytes, border: np.ndarray) -> list[tuple[int, int, int, tuple[int, int, int]]]:
        """(first word, number of words, edits, and the regex's substituted, inserted and lost letters) of all matches. border: the
        places of the stream's spaces."""
        n, number = len(self.words), lambda at: int(np.searchsorted(border, at))
        if not self.notice.edits:
            found, wanted = [], b" %s " % self.data
            at = stream.find(wanted)
            while at >= 0:
                found.append((number(at), n, 0, (0, 0, 0)))
                at = stream.find(wanted, at + 1)
            return found
        best: dict[int, tuple] = {}
        for start, end in self.windows(stream):
            for m in self.fuzzy.finditer(stream, start, end, overlapped=True):
                first, size = number(m.start() - 1), m.group().count(b" ") + 1
                # the span itself, or as many words as the notice has where it begins or beside
                for a, k in ((first, size), *((first + d, n) for d in (0, -1, 1))):
                    if 0 <= a and a + k < len(border):
                        edits = misspelt(stream[border[a] + 1 : border[a + k]].split(b" "), self.words, self.notice.edits)
                        if edits is not None:
                            best[a] = min(best.get(a, (a, k, edits, m.fuzzy_counts)), (a, k, edits, m.fuzzy_counts), key=lambda x: x[2])
        return sorted(best.values())


def matches_of(text: str, finders: list[Finder]) -> tuple[int, list[tuple]]:
    """Number of words and the matches (label, base, edits, letters substituted, inserted and lost, first word, words, what was found)."""
    words = words_of(text)
    stream = b" %s " % b" ".join(words) if words else b""
    border, found = None, []
    for f in finders:
        if not any(p in stream for _, p in f.pieces):
            continue
        if border is None:
            border = np.flatnonzero(np.frombuffer(stream, np.uint8) == 32)
        for first, size, edits, counts in f.find(stream, border):
            found.append((f.notice.label, f.notice.base, edits, *counts, first, size, b" ".join(words[first : first + size]).decode("utf-8", "replace")))
    return len(words), found


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words and all matches of every document."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Finder(n) for n in notices]

        def rows() -> Iterator[tuple]:
            for batch in found:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                    n, got = matches_of(text, finders)
                    yield doc_id, n, [dict(zip(NAMES, g, strict=True)) for g in got]

        yield from batches(rows(), _MATCH, 5_000)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCH)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; base columns from the matches of the base phrases, the score from the closest match."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    closeness = F.transform("matches", lambda m: 1.0 - m["edits"] / F.greatest(F.lit(1), F.length(m["found"])).cast("double"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.greatest(F.lit(0.0), F.coalesce(F.array_max(closeness), F.lit(0.0))).alias("score"),
    )

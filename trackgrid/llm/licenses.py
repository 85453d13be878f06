"""License scans: exact base phrases, and short notices found with a bounded number of edits.

A text is brought to lower case and reduced to words joined by single spaces.
A notice that may have k edits is cut into k + 1 seeds; with k edits at most,
one seed is untouched (the pigeonhole principle), so an exact search for seeds
finds every candidate. Around each, the ``regex`` library matches the notice
with at most k edits, which confirms it and gives its span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices in words as they are read here, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the bsd license": "bsd",
    "mozilla public license version 2 0": "mpl",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution": "cc",
    "this work is licensed under the creative commons": "cc",
    "eclipse public license version 2 0": "epl",
    "boost software license version 1 0": "bsl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    "this document is confidential and proprietary": "proprietary",
}
#: One edit (a letter put in, left out or changed) is allowed for so many letters of a notice.
LETTERS_PER_EDIT = 12
SCHEMA = """doc_id long, n_words long, base array<struct<label:string,start:long>>,
 notices array<struct<label:string,notice:int,start:long,stop:long,edits:int,first_word:long,last_word:long>>"""

#: How bytes are read: A-Z as a-z, other ASCII marks as space; bytes of other characters stay.
_READ = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256)
)


def read_words(text: bytes) -> bytes:
    """The words of UTF-8 ``text``, joined by single spaces."""
    return b" ".join(text.translate(_READ).split())


def places_of(phrase: bytes, words: bytes) -> Iterator[int]:
    """Byte offsets where the words of ``phrase`` stand as whole words, overlaps included."""
    at = words.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
            yield at
        at = words.find(phrase, at + 1)


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """``notice`` in ``edits`` + 1 parts of about equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Finds ``notices`` (words -> label) with up to one edit for ``letters_per_edit`` letters."""

    def __init__(self, notices: dict[str, str] = NOTICES, letters_per_edit: int = LETTERS_PER_EDIT):
        import regex

        self.notices, self.forms, self.seeds = list(notices.items()), [], {}
        for i, (words, _) in enumerate(self.notices):
            edits = len(words) // letters_per_edit
            self.forms.append((regex.compile(rf"(?e)(?:{regex.escape(words)}){{e<={edits}}}"), edits))
            for offset, seed in seeds_of(words, edits):
                self.seeds.setdefault(seed.encode(), []).append((i, offset))

    def candidates(self, words: bytes) -> dict[int, list[int]]:
        """For each notice, byte offsets where it would begin if a seed that was found is its own."""
        found: dict[int, list[int]] = {}
        for seed, owners in self.seeds.items():
            at = words.find(seed)
            while at >= 0:
                for i, offset in owners:
                    found.setdefault(i, []).append(at - offset)
                at = words.find(seed, at + 1)
        return found

    def find(self, words: bytes) -> list[tuple[str, int, int, int, int]]:
        """``(label, notice, start, stop, edits)`` in bytes of ``words``; spans of a notice don't overlap."""
        out = []
        for i, starts in self.candidates(words).items():
            form, edits = self.forms[i]
            size, done = len(self.notices[i][0].encode()), -1
            for a, b in _merged(sorted(starts), edits, size):
                low = max(a, done, 0)
                # A window is cut at bytes; characters that the cut breaks are not part of a notice.
                window = words[low : max(b, low)].decode("utf-8", "surrogateescape")
                byte_of = _byte_places(window)
                at = 0
                while m := form.search(window, at):
                    start, stop = (low + (k if byte_of is None else int(byte_of[k])) for k in m.span())
                    out.append((self.notices[i][1], i, start, stop, sum(m.fuzzy_counts)))
                    done, at = stop, max(m.end(), m.start() + 1)
        return sorted(out, key=lambda x: (x[2], x[1]))


def _byte_places(text: str) -> np.ndarray | None:
    """The byte where each character of ``text`` begins, and its end; None if each is one byte."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    sizes[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # bytes that are no character
    return np.concatenate([[0], np.cumsum(sizes)])


def _merged(starts: list[int], edits: int, size: int) -> list[list[int]]:
    """Windows that hold the notice for each start, give or take ``edits``; those that meet become one."""
    windows: list[list[int]] = []
    for s in starts:
        a, b = s - 4 * edits, s + size + 4 * edits
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(b, windows[-1][1])
        else:
            windows.append([a, b])
    return windows


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, letters_per_edit: int = LETTERS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and notices of every row of ``docs``.

    ``n_words``; ``base``: label and first word of every place of a base phrase; ``notices``: label,
    number of the notice, span in bytes of the text as read (see :func:`read_words`), edits, and
    the words it touches. A null or empty text has no words and empty lists. Rows with equal ids are scanned one by one, other
    columns are not read, and texts of any length are scanned whole, in time that grows with their length.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, letters_per_edit)
        phrases = [(p.encode(), label) for p, label in BASE_PHRASES.items()]
        base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        notice_type = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
        for batch in batches:
            n, base, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = read_words(text)
                spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
                word_at = lambda places: np.searchsorted(spaces, places).tolist()  # the spaces before a place
                n.append(len(spaces) + 1 if words else 0)
                own = []
                for p, label in phrases:
                    own += [{"label": label, "start": w} for w in word_at(list(places_of(p, words)))]
                base.append(own)
                spans = search.find(words)
                firsts, lasts = word_at([s[2] for s in spans]), word_at([max(s[2], s[3] - 1) for s in spans])
                found.append([
                    {"label": label, "notice": i, "start": a, "stop": b, "edits": e, "first_word": f, "last_word": last}
                    for (label, i, a, b, e), f, last in zip(spans, firsts, lasts)
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, base_type), pa.array(found, notice_type)], names=["doc_id", "n_words", "base", "notices"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    return texts.mapInArrow(scan, SCHEMA)


def license_digest(found: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of :func:`scan_licenses`, with labels and a score.

    The score is 1 with a base phrase; else the best notice's share of letters without an edit; else 0.
    """
    sizes = F.array(*[F.lit(len(x)) for x in notices])
    base = F.col("base.label")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.array_max(F.transform("notices", lambda x: 1 - x.edits / F.get(sizes, x.notice)))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, F.col("notices.label"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )

"""Secret scans: three known forms, and random strings found by their token efficiency.

A byte-pair vocabulary packs ordinary words, names and paths into few tokens;
random letters and digits need about one token for every two characters. A run
of key characters with few characters per token is therefore a likely secret,
be it of letters alone or not. Only digests, UUIDs, numbers and identifiers that
consist of vocabulary words for the most part are set aside. Random hexadecimal
strings as long as a digest are not told from one, and rare compound words of 20
letters or more can be as dense as a key.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

#: The base forms. Matches shorter than the number, of the named group, are dropped.
BASE_FORMS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", re.A, 0, 20),
    "hex": (r"[0-9a-f]+", re.A, 0, 24),
}
#: The order of kinds among spans that start together.
KINDS = (*BASE_FORMS, "dense")
#: Runs of key characters that are looked at, and what makes one a secret.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A)
CHARS_PER_TOKEN = 2.4
#: Lengths in hexadecimal of md5, sha-1, sha-224, sha-256, sha-384 and sha-512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)", re.A)
#: UUIDs; numbers and dates.
NUMBERS = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+=/_-]+", re.A)
#: What a run is made of between marks, and where its case changes. No part can be split in two ways.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", re.A)
#: A part of three letters or more is a word of the vocabulary if its tokens have this many characters on average.
WORD_CHARS_PER_TOKEN = 2.5
#: An identifier has this share of its letters and digits in such words.
WORD_SHARE = 0.5
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> float:
        return len(s) / max(1, len(self.encoding.encode_ordinary(s)))


def known_identifier(s: str, efficiency: TokenEfficiency) -> bool:
    """Whether ``s`` is a digest of a usual length, a UUID, a number, or an identifier made of words of the vocabulary."""
    if NUMBERS.fullmatch(s) or len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s):
        return True
    parts = PART.findall(s)
    words = sum(len(p) for p in parts if len(p) > 2 and p.isalpha() and efficiency(p) >= WORD_CHARS_PER_TOKEN)
    return words >= WORD_SHARE * sum(map(len, parts))


def find_spans(text: str, efficiency: TokenEfficiency, at_most: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, stop)`` in code points, by start and kind."""
    found = []
    for kind, (form, group, least) in _COMPILED.items():
        found += [(kind, m.start(), m.end()) for m in form.finditer(text) if m.end(group) - m.start(group) >= least]
    for m in RUN.finditer(text):
        s = m[0]
        if efficiency(s) < at_most and not known_identifier(s, efficiency):
            found.append(("dense", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_COMPILED = {k: (re.compile(form, flags), group, least) for k, (form, flags, group, least) in BASE_FORMS.items()}


def scan_secrets(docs: DataFrame, vocabulary: str, at_most: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every row of ``docs``: ``doc_id`` and ``spans`` (kind, start, stop in code points).

    Kinds are ``assign, access, hex`` (the base forms) and ``dense`` (token efficiency). Spans of
    different kinds may overlap. A null or empty text has an empty list; rows with equal ids are
    scanned one by one; other columns are not read. Texts of any length are scanned whole.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = TokenEfficiency(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "stop"), s)) for s in find_spans(t, efficiency, at_most)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def spans_digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of :func:`scan_secrets`, one row per row."""
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_FORMS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Periodic runs of words, by a suffix automaton whose suffix-link tree is accessed word by word.

A run is a stretch whose words recur at a distance, its period, that cannot be
extended. The automaton of a stretch has a state per class of substrings; the
path from the state of a prefix to the root holds all suffixes of the prefix.
Each state knows where its substrings ended last. Appending a word accesses the
path of the new prefix, as link-cut trees do: the path falls into segments that
ended last at one place, and gets the new end as its colour. A segment whose
earlier end lies no further back than its longest string is long is a square.
That string is the longest common suffix of both ends, so the run's start is
known; its end follows by comparing words.

Every run of period q that is at least 2q long is met: at its first 2q words,
the last q ended q earlier, and no later end is possible without a smaller
period. So a distance is the smallest period of its stretch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty
from .tokens import release

#: A run has at least this many words and this many periods; words of its first period stay.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Fixed value: the words of a text, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[bytes]:
    """Words between the six white-space characters of ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: every three words of a run occur three times in it, so stretches of such triples hold all.

    ``words`` are numbers; stretches are half open and hold ``LEAST_WORDS`` words or more.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    span = int(words.max()) + 1
    if span < 1 << 21:
        triples = (words[:-2].astype(np.int64) * span + words[1:-1]) * span + words[2:]
    else:  # pairs are numbered first
        pairs = np.unique(words[:-1].astype(np.int64) * span + words[1:], return_inverse=True)[1]
        triples = pairs[:-1].astype(np.int64) * span + words[2:]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[starts, len(ranked)])
    often = np.zeros(len(triples) + 2, bool)
    often[1:-1][order] = np.repeat(sizes >= 3, sizes)
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(a, b + 2) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + 2 - a >= LEAST_WORDS]


def automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of every state, and the state of every prefix."""
    length, link, then, prefixes = [0], [-1], [{}], []
    last = 0
    for w in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        then.append({})
        at = last
        while at != -1 and w not in then[at]:
            then[at][w] = new
            at = link[at]
        if at != -1:
            to = then[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                then.append(dict(then[to]))
                while at != -1 and then[at].get(w) == to:
                    then[at][w] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
        prefixes.append(new)
    return length, link, prefixes


class LastEnds:
    """The suffix-link tree as splay trees, one per path of states that ended last at the same place."""

    def __init__(self, link: list[int]):
        self.up, self.left, self.right = list(link), [-1] * len(link), [-1] * len(link)
        #: Where the strings of a splay tree ended last, kept at its root; -1 if nowhere yet.
        self.end = [-1] * len(link)

    def _splay(self, x: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while (p := up[x]) != -1 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g != -1 and (left[g] == p or right[g] == p)
            for y in ((p, x) if (left[p] == x) == (left[g] == p) else (x, x)) if inner else (x,):
                q = up[y]
                h = up[q]
                if left[q] == y:
                    c = left[q] = right[y]
                    right[y] = q
                else:
                    c = right[q] = left[y]
                    left[y] = q
                if c != -1:
                    up[c] = q
                up[q], up[y] = y, h
                if h != -1:
                    if left[h] == q:
                        left[h] = y
                    elif right[h] == q:
                        right[h] = y
                end[y] = end[q]

    def access(self, state: int, now: int) -> list[tuple[int, int]]:
        """Colour the path from ``state`` to the root; return its segments, a deepest state and the end before."""
        up, right, end = self.up, self.right, self.end
        found, below, x = [], -1, state
        while x != -1:
            self._splay(x)
            before = end[x]
            if before >= 0:
                found.append((x, before))
            if right[x] != -1:  # deeper states keep their colour in a tree of their own
                end[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = now
        return found


def runs_of_stretch(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of ``words``, by start and period."""
    length, link, prefixes = automaton(words)
    tree = LastEnds(link)
    n, known, out = len(words), {}, []
    for i, state in enumerate(prefixes):
        for segment, before in tree.access(state, i):
            period, common = i - before, length[segment]
            if period > common or known.get(period, -1) >= i:
                continue
            start, stop = before - common + 1, i + 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            known[period] = stop - 1
            if stop - start >= max(least_words, least_periods * period):
                out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_runs(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of a text, by start and period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(ids) - LEAST_WORDS + 2:  # too few repeats for any run
        return []
    out = []
    for a, b in stretches(ids):
        out += [(a + s, n, q) for s, n, q in runs_of_stretch(ids[a:b].tolist())]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for s, size, q in runs:
        edges[s + q] += 1
        edges[s + size] -= 1
    return np.cumsum(edges)[:n] > 0


RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """Per row: ``id, n_words, runs`` (``start, length, period``, by start and period) and ``collapsed``.

    ``collapsed`` is the text's words with one space between, without those in a run after its first
    period. A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows are
    independent: equal ids and repeated texts are treated one by one, no rows give no rows, and only the
    two named columns are read, whatever else there is. Texts are taken whole; memory grows with the
    longest stretch of repeated words of one text, by about 500 bytes a word.
    """
    prepare(docs.sparkSession)
    text = text_or_empty(text_col) if isinstance(text_col, str) else F.coalesce(text_col, F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, found, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                runs = word_runs(words)
                if runs:
                    words_left = [w for w, d in zip(words, dropped(len(words), runs).tolist()) if not d]
                else:
                    words_left = words
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(words_left))
            runs_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, runs_type), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    return named.mapInArrow(run, f"id long, {RESULT}")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, or, for a tenth of the ids, its words with a periodic end.

    With h the crc32 of the id in decimal and g = h // 10: if h is divisible by 10, each word i from a on is
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return F.concat_ws(" ", F.slice(words, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: words[a + i % p]))

    # As the variable of a lambda, the words are found once.
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)))[0]
    return F.coalesce(F.when(h % 10 == 0, made), F.col(text_col))


def runs_digest(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: how many runs, the longest one, and digests of all runs and of ``collapsed``."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length, r.start, r.period)))")
    top = found.withColumn("top", longest)
    text = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    start, size, period = F.col("top")["start"], -F.col("top")["col1"], F.col("top")["period"]
    return top.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"), size.alias("length"), period.alias("period"), F.floor(1000 * size / period).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

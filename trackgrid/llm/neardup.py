"""Near duplicates by MinHash bands and sequential Bayesian verification.

Documents are sets of hashed five-word shingles. Equal sets are one class from
the start, so copies cost nothing later. Classes meet in bands of MinHash
values. A bucket of a band is not expanded into pairs: each member is compared
with the bucket's pivot, the class that meets most others over all bands. Verification looks at
signatures a batch at a time and drops a pair once the posterior probability
that it reaches the threshold falls below ``MISS``; the rest are compared on
their full sets.

Links between members that the pivot does not unite are found exactly: classes
of buckets with more than one component go through a prefix-filter join. With
shingles ordered from rare to common, two sets as similar as the threshold
share one among their first few, and the places of the first shared one bound
the sizes. Sets with many shingles of their own, as edited copies have, then
meet nobody, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOOKUP_ROWS, collected, prepare, text_or_empty, written
from .components import components
from .tokens import release

WORDS = 5
#: Links need 100 * intersection >= percent * union; this is the percentage where none is given.
PERCENT = 85
#: A link right at 0.85 misses all bands with a probability of (1 - 0.85 ** 5) ** 25, below one in a million.
BANDS, ROWS = 25, 5
#: Signature values compared at a time, and the posterior probability at which a pair is dropped.
BATCH, MISS = 25, 1e-6
#: Counters of the sketch that orders shingles by frequency; any order gives the same links.
SKETCH_BITS = 20
SEED = 1

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(SEED)
_MIX = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def bands_for(percent: int) -> int:
    """Bands, in whole batches, with which a link right at the threshold misses all of them less than once in a million."""
    step = BATCH // ROWS
    bands = step
    while (1 - (percent / 100) ** ROWS) ** bands >= 1e-6:
        bands += step
    return bands


@cache
def _hashers(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, bands])
    a = rng.integers(1, 1 << 63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, bands * ROWS, dtype=np.uint64)


class _WordHashes(dict):
    """Hashes of the words that a process has met; started anew when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _finish(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the five-word shingles of UTF-8 ``text``; of all words if they are fewer."""
    words = text.translate(_UPPER).split()  # splits at the ASCII white space, and nowhere else
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _finish((h * _MIX[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    mixed = h[:n] * _MIX[0]
    for i in range(1, WORDS):
        mixed += h[i : i + n] * _MIX[i]
    return np.unique(_finish(mixed))


def signature(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """MinHash values of a set that is not empty; memory does not grow with the set."""
    least = np.full(bands * ROWS, ~np.uint64(0))
    a, b = _hashers(bands)
    for start in range(0, len(found), 4096):
        least = np.minimum(least, (found[None, start : start + 4096] * a[:, None] + b[:, None]).min(1))
    return (least >> np.uint64(32)).astype("<u4")


@cache
def least_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest matches in ``compared`` values with which a pair goes on.

    With a uniform prior the similarity has a Beta posterior; its tail above the threshold is summed numerically.
    """
    x = (np.arange(200_000) + 0.5) / 200_000
    for m in range(compared + 1):
        log = m * np.log(x) + (compared - m) * np.log1p(-x)
        density = np.exp(log - log.max())
        if density[x >= percent / 100].sum() / density.sum() >= miss:
            return m
    return compared


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the sorted sets reach the threshold."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """Per row: ``doc_id, set_id`` (a digest of the set; null if empty), ``n``, ``signature``. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, sizes, signatures = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_buffer().to_pybytes())
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found, bands).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "set_id", "n", "signature"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    return written(texts.mapInArrow(run, "doc_id long, set_id binary, n long, signature binary"), "shingled")


def _banded(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, bands, ROWS * 4)
            keys = [xxhash.xxh3_64_intdigest(raw[i, j].tobytes(), seed=j) for i in range(len(raw)) for j in range(bands)]
            keys = np.array(keys, np.uint64).view(np.int64)
            at = np.repeat(np.arange(len(raw)), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["band", "set_id", "copies"])

    return run


def _bayes(percent: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, bands * ROWS) for i in (2, 3))
            going, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for start in range(0, bands * ROWS, BATCH):
                matches[going] += (left[going, start : start + BATCH] == right[going, start : start + BATCH]).sum(1)
                going = going[matches[going] >= least_matches(start + BATCH, percent)]
            picked = pa.array(going)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for b, left, right in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if b != last:
                    last, found = b, shingles(right)
                good.append(similar(shingles(left), found, percent))
            picked = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, held: DataFrame, percent: int, bands: int) -> DataFrame:
    """The pairs ``a, b`` that are links; ``held`` has ``set_id, signature, text`` of all that occur."""

    def with_both(p: DataFrame, column: str) -> DataFrame:
        left, right = (held.select(F.col("set_id").alias(k), F.col(column).alias(f"of_{k}")) for k in "ab")
        return p.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")

    going = written(with_both(pairs, "signature").mapInArrow(_bayes(percent, bands), "a binary, b binary"), "bayes")
    texts = with_both(going, "text").sortWithinPartitions("b")
    return written(texts.mapInArrow(_exact(percent), "a binary, b binary"), "verified")


def _prefix_pairs(spark: SparkSession, held: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that a prefix filter lets through. ``parts``: ``set_id, label``."""
    sets = held.select("set_id", "text").join(parts, "set_id").select("set_id", "label", "text")
    slots = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column(2).to_pylist():
                np.add.at(seen, (shingles(text) & np.uint64(slots - 1)).astype(np.int64), 1)
        used = np.flatnonzero(seen)
        for start in range(0, len(used), 10_000):
            some = used[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["slot", "n"])

    # At most one row per counter of the sketch.
    totals = collected(sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1"))
    frequency = np.zeros(slots, np.uint32)
    frequency[totals["slot"]] = np.minimum(totals["n"], (1 << 32) - 1)
    shared = spark.sparkContext.broadcast(frequency)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "set_id", "label", "size", "longest", "larger"]
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for row, text in enumerate(batch.column(2).to_pylist()):
                found = shingles(text)
                n = len(found)
                found = found[np.lexsort((found, shared.value[(found & np.uint64(slots - 1)).astype(np.int64)]))]
                for larger, least in ((False, -(-2 * n * percent // (100 + percent))), (True, -(-n * percent // 100))):
                    at = np.arange(n - least + 1)
                    # The other set's size, if this is the first shared shingle, is at most this.
                    longest = (n - at) * (100 + percent) // percent - n
                    for c, v in zip(columns, (found[at].view(np.int64), np.full(len(at), row), np.full(len(at), n), longest, np.full(len(at), larger))):
                        c.append(v)
            if columns[0]:
                key, row, size, longest, larger = (np.concatenate(c) for c in columns)
                for start in range(0, len(key), 50_000):
                    cut = slice(start, start + 50_000)
                    at = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), batch.column(0).take(at), batch.column(1).take(at), pa.array(size[cut]), pa.array(longest[cut]), pa.array(larger[cut])], names=names)

    rare = written(sets.mapInArrow(prefixes, "shingle long, set_id binary, label binary, size long, longest long, larger boolean"), "prefixes")
    x = rare.where("larger").select("shingle", F.col("set_id").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), F.col("longest").alias("ma"))
    y = rare.where("not larger").select("shingle", F.col("set_id").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("longest").alias("mb"))
    fits = "la != lb and sb <= sa and sb <= ma and sa <= mb and 100 * sb >= %d * sa" % percent
    return x.join(y, "shingle").where(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``.

    Sets are linked if ``100 * intersection >= percent * union``, with ``percent`` from 1 to 100.

    ``component_id`` is the smallest id that links lead to, its own included; ``kept`` marks it. A
    null or empty text, or one without words, has an empty set and is linked with nothing. A row
    without an id has the component of a row with an id and the same set; it is linked with
    nothing else, and if there is none its component is null and it is kept. Rows with equal ids are
    told apart by their sets; other columns are not read. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    bands = bands_for(percent)
    rows = describe(docs, id_col, text_col, bands)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")

    banded = classes.select("set_id", "copies", "signature").mapInArrow(_banded(bands), "band long, set_id binary, copies long")
    banded = written(banded, "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = written(banded.join(sizes, "band").select("band", "set_id", "copies", "members"), "meetings")
    # The text that others were made from meets more of them than they meet each other.
    weights = met.groupBy("set_id").agg(F.sum("members").alias("meets"), F.max("copies").alias("copies"))
    hubs = met.select("band", "set_id").join(weights, "set_id").groupBy("band").agg(F.max(F.struct("meets", "copies", "set_id")).alias("top"))
    shared = written(met.select("band", "set_id").join(hubs.select("band", F.col("top.set_id").alias("pivot")), "band"), "buckets")
    wanted = shared.select("set_id").distinct()

    held = written(_texts_of(docs, classes.join(wanted, "set_id"), id_col, text_col), "held")
    stars = shared.where("set_id != pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(stars, held, percent, bands)

    labels = components(links)
    labelled = shared.join(labels, shared.set_id == labels.node, "left").select("band", "set_id", F.coalesce("label", "set_id").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
    open_ = written(labelled.join(mixed, "band").select("set_id", "label").distinct(), "open")
    if not open_.isEmpty():
        pairs = _prefix_pairs(spark, held, open_, percent)
        known = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        more = _verified(pairs.join(known, ["a", "b"], "left_anti"), held, percent, bands)
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    joined = classes.join(labels, classes.set_id == labels.node, "left").select("set_id", "first_id", F.coalesce("label", "set_id").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answer = written(joined.join(smallest, "label").select("set_id", "component_id"), "component-ids")
    out = rows.select("doc_id", "n", "set_id").join(answer, "set_id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"), "set_id")


def _texts_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``set_id, signature, text`` of the classes, the text from a row with the class's first id and set.

    The classes' ids are broadcast if there are few; otherwise texts are shuffled once.
    """
    keys = classes.select("first_id", "set_id")
    if keys.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    found = texts.join(keys, texts.id == F.col("first_id")).select("set_id", "text")

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [xxhash.xxh3_128_digest(shingles(t).tobytes()) == s for s, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch.filter(pa.array(good, pa.bool_()))

    mine = found.mapInArrow(same_set, "set_id binary, text binary").groupBy("set_id").agg(F.first("text").alias("text"))
    return mine.join(classes.select("set_id", "signature"), "set_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id :func:`near_dups` keeps, with their own columns.

    Rows with equal ids stay together if one of them is kept. The ids that go are broadcast if
    there are few, so that texts stay where they are.
    """
    marked = near_dups(docs, id_col, text_col, percent)
    gone = marked.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    gone = written(gone.select(F.col("doc_id").alias("gone_id"), F.lit(1).alias("gone")), "near-copies")
    if gone.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        gone = F.broadcast(gone)
    nested = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return nested.join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left").where("gone is null").select("row.*")

"""Removal of repeated byte strings, by suffix arrays over the places that can repeat.

Every string of ``LENGTH`` bytes has an anchor: of its ``GRAM``-byte parts, the
one with the smallest hash, the leftmost of several. Equal strings have equal
anchors in the same place. Half of the other bytes at least lie on one side; the
anchor with so many bytes on that side is the string's key, and only strings whose key occurs twice can
repeat. Those that share one key in a text are a context, the bytes they cover. Texts that
equal an earlier one are set aside, and equal contexts are reduced to the first one, before anything is sorted; what is left
meets by key, in shards of bounded size. A shard's contexts are put in a row and
sorted to a suffix array by Larsson and Sadakane's refinement: ranks of
prefixes double in length, and only suffixes that are still tied are sorted
again. Kasai's walk, taken along all contexts at once, gives the common prefixes of neighbours;
runs with ``LENGTH`` bytes in common are equal strings, and all but the first are removed.

A key with more contexts than a shard may hold is dealt over many tasks: its
strings are merged across shards by their digests, in a sort-merge join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, lookup, prepare, text_or_empty, written

LENGTH, GRAM = 100, 32
#: Bytes of a shard's suffix array, and contexts of one key beyond which it is dealt out.
SHARD_BYTES, HOT_CONTEXTS = 4 << 20, 4096
#: Repeated anchors, and spans, are broadcast up to this number; beyond it they are joined.
BROADCAST_ANCHORS, BROADCAST_SPANS = 4_000_000, 500_000
_STEP = 1 << 15
_rng = np.random.default_rng(9)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIDES = _rng.integers(1, 1 << 63, (2, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes from each place of ``raw``."""
    h, size, turn = _BYTES[raw], 1, 0
    while size < GRAM:
        h = h[:-size] * _MIX[turn] + h[size:]
        h ^= h >> np.uint64(29)
        size, turn = 2 * size, turn + 1
    h *= _MIX[5]
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one key: the key, place of the anchor, first and last start of the strings."""
    n, width, half = len(raw) - LENGTH + 1, LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    found = []
    for start in range(0, n, _STEP):  # memory does not grow with the text
        some = min(_STEP, n - start)
        h = gram_hashes(raw[start : start + some + LENGTH - 1])
        # The hash's upper bits, then the place: the least is the leftmost of the smallest.
        key = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key, size = np.minimum(key[:-size], key[size:]), size * 2
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])[:some]
        at = (key & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [some - 1]])
        p = at[first]
        for side, (a, b) in enumerate(((first, np.minimum(last, p - half)), (np.maximum(first, p - half + 1), last))):
            some_ = np.flatnonzero(a <= b)
            q = p[some_]
            # Bytes before the anchor, or after it.
            ends = (q - half, q - GRAM) if side == 0 else (q + GRAM, q + half)
            keys = h[q] * _SIDES[side][0] + h[ends[0]] * _SIDES[side][1] + h[ends[1]] * _SIDES[side][2]
            found.append((keys ^ (keys >> np.uint64(31)), q + start, a[some_] + start, b[some_] + start, np.full(len(q), side)))
    keys, places, first, last, side = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(first, kind="stable")
    keys, places, first, last, side = (x[order] for x in (keys, places, first, last, side))
    # A run may go on in the next step.
    begin = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (side[1:] != side[:-1])]))
    return keys[begin], places[begin], first[begin], last[np.concatenate([begin[1:], [len(keys)]]) - 1]


def suffix_array(row: np.ndarray, end_of: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """The sorted suffixes of ``row``, texts of bytes + 1 that each close with a 0 of its own.

    ``end_of`` is the place of each suffix's own 0; zeros sort before bytes, and by their place.
    """
    n, step = len(row), 7
    padded = np.concatenate([row, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        inside = np.arange(n) + i <= end_of
        key = (key << 9) | np.where(inside, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    new |= is_end[order]
    rank = np.empty(n, np.int64)
    # A tied suffix has the place of its group's first member.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = _tied(new)
    while len(tied):
        members = order[tied]
        group, then = rank[members], rank[np.minimum(members + step, end_of[members])]
        again = np.lexsort((then, group))
        members, group, then = members[again], group[again], then[again]
        order[tied] = members
        opens = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        rank[members] = np.maximum.accumulate(np.where(opens, tied, 0))
        tied = tied[_tied(opens)]
        step *= 2
    return order


def _tied(opens: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given where groups open."""
    closes = np.concatenate([opens[1:], [True]])
    return np.flatnonzero(~(opens & closes))


def common_prefixes(row: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of ``order``, the common prefix with the suffix before it, ``LENGTH`` at most.

    Kasai's walk: a suffix has at least the common prefix of the one that begins a byte earlier, less one.
    It goes along all texts (``starts`` to their 0 at ``ends``) in step.
    """
    n = len(row)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([row, np.zeros(1, np.int64)])
    shared = np.zeros(n, np.int64)
    at, length = starts.copy(), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    while len(live):
        here = at[live]
        other = before[here]
        length[live] = np.where(other < 0, 0, length[live])
        going = live[other >= 0]
        while len(going):
            a, b, size = at[going], before[at[going]], length[going]
            left, right = padded[a + size], padded[b + size]
            going = going[(left == right) & (left > 0) & (size < LENGTH)]
            length[going] += 1
        shared[here] = length[live]
        length[live] = np.maximum(length[live] - 1, 0)
        at[live] += 1
        live = live[at[live] < ends[live]]
    out = shared[order]
    out[0] = 0
    return out


def repeated_spans(contexts: list[bytes], places: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """For each context, the spans of its strings that occur at an earlier place in this shard.

    ``places``: document id, document digest and start of each context's first byte.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    row = np.zeros(int((sizes + 1).sum()), np.int64)
    is_end = np.zeros(len(row), bool)
    is_end[ends] = True
    row[~is_end] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    order = suffix_array(row, ends[owner], is_end)
    shared = common_prefixes(row, order, starts, ends)
    same = np.concatenate([shared[1:] >= LENGTH, [False]]) | (shared >= LENGTH)
    at = np.flatnonzero(same)
    if not len(at):
        return [[] for _ in contexts]
    group = np.cumsum(shared[at] < LENGTH)
    place = order[at]
    doc, begin = _ranks(places)
    inside = place - starts[owner[place]]
    first = np.lexsort((begin[owner[place]] + inside, doc[owner[place]], group))
    opens = np.concatenate([[True], group[first][1:] != group[first][:-1]])
    later = np.sort(place[first][~opens])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for p in later.tolist():
        k = owner[p]
        a = int(p - starts[k])
        spans = out[k]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], a + LENGTH)
        else:
            spans.append((a, a + LENGTH))
    return out


def _ranks(places: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in order of id and digest, as numbers; and the starts."""
    docs = {d: i for i, d in enumerate(sorted({p[:2] for p in places}))}
    return np.array([docs[p[:2]] for p in places], np.int64), np.array([p[2] for p in places], np.int64)


def _raw(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; the remaining bytes as ``kept`` if asked for.

    A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same. A null text is empty; empty and short texts lose
    nothing. A null id is smaller than any. Rows with equal ids are in the order of their
    texts' digests, and repeated rows are one document, with equal results. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    raw = F.encode(text_or_empty(text_col), "utf-8")
    order_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id.alias("id"), F.xxhash64(raw).alias("digest"), raw.alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(_raw(t))[0] for t in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])

    # A text that equals one with a smaller id is removed from end to end, if it is long enough.
    named = texts.where(F.octet_length("text") >= LENGTH).withColumn("whole", F.unhex(F.md5("text")))
    equal = named.groupBy("whole").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    told = lookup(named, written(equal.select("whole", "first_id"), "equal-texts"), ["whole"])
    copied = F.coalesce(F.col("id") != F.col("first_id"), F.lit(False))
    long_ = told.where(~copied).select("id", "digest", "text")
    counted = long_.select("text").mapInArrow(find, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    repeated = written(counted.where("n > 1").select("anchor"), "anchors")
    contexts = _contexts(long_, repeated)

    place = F.struct("id", "digest", "start")
    distinct = contexts.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.first("raw").alias("raw"), F.count("*").alias("n"))
    distinct = written(distinct, "contexts")
    many = distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > HOT_CONTEXTS).select("anchor", F.lit(1).alias("hot"))

    # Contexts that are not the first of their kind repeat from end to end.
    firsts = distinct.where("n > 1").select("anchor", "context", "first")
    copies = contexts.select("anchor", "context", "id", "digest", "start", "size").join(firsts, ["anchor", "context"]).where(~place.eqNullSafe(F.col("first")))
    spans = copies.select("id", "digest", "start", (F.col("start") + F.col("size")).alias("stop"))
    distinct = lookup(distinct, written(many, "hot-anchors"), ["anchor"])
    spans = spans.unionByName(_shard_spans(distinct.where("hot is null"))).unionByName(_dealt_spans(distinct.where("hot is not null")))
    gone = spans.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    gone = written(gone.select("id", "digest", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), "spans")
    size = gone.agg(F.sum(F.size("starts") + 2).alias("n")).first()["n"] or 0
    told = lookup(texts.withColumn("whole", F.unhex(F.md5("text"))), written(equal.select("whole", "first_id"), "equal-texts"), ["whole"])
    told = told.withColumn("copy", copied)
    marked = lookup(told, gone, ["id", "digest"], small=size <= BROADCAST_SPANS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, a, b, copy in zip(*batch.columns[1:4], batch.column(4).to_pylist()):
                bytes_ = _raw(text)
                if copy and len(bytes_) >= LENGTH:
                    kept, n_spans = b"", 1
                elif a.is_valid:
                    marks = np.zeros(len(bytes_) + 1, np.int64)
                    np.add.at(marks, a.values.to_numpy(), 1)
                    np.add.at(marks, b.values.to_numpy(), -1)
                    covered = np.cumsum(marks)[:-1] > 0
                    n_spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                    kept = bytes_[~covered].tobytes()
                else:
                    kept, n_spans = bytes_.tobytes(), 0
                out.append((len(bytes_), len(bytes_) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return marked.select("doc_id", "text", "starts", "stops", "copy").mapInArrow(cut, schema)


def _contexts(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Every context of a key in ``repeated``: ``anchor`` (the key), ``context`` (a digest), place, size and bytes. Written once."""
    spark = texts.sparkSession
    schema = "anchor long, context long, id long, digest long, start long, size int, raw binary"
    if repeated.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS:
        wanted = spark.sparkContext.broadcast(np.sort(collected(repeated)["anchor"]))
        source = texts.select("id", "digest", "text", F.lit(None).cast("array<long>").alias("keys"))
    else:
        wanted = None

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, t in enumerate(batch.column(2)):
                    keys = np.unique(anchors(_raw(t))[0])
                    at = pa.array(np.full(len(keys), i))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["anchor", "id", "digest"])

        placed = texts.select("id", "digest", "text").mapInArrow(place, "anchor long, id long, digest long")
        placed = placed.join(repeated, "anchor").groupBy("id", "digest").agg(F.collect_set("anchor").alias("keys"))
        source = texts.join(placed, ["id", "digest"]).select("id", "digest", "text", "keys")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = ["anchor", "context", "id", "digest", "start", "size", "raw"]
        for batch in batches:
            rows: list[tuple] = []
            for id_, digest, text, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = _raw(text)
                keys, _, first, last = anchors(raw)
                signed = keys.view(np.int64)
                if wanted is not None:
                    near = np.minimum(np.searchsorted(wanted.value, signed), max(0, len(wanted.value) - 1))
                    good = wanted.value[near] == signed if len(wanted.value) else np.zeros(len(signed), bool)
                else:
                    good = np.isin(signed, mine.values.to_numpy())
                whole = raw.tobytes()
                for key, a, b in zip(signed[good].tolist(), first[good].tolist(), last[good].tolist()):
                    some = whole[a : b + LENGTH]
                    # Compared among contexts of one key only.
                    rows.append((key, xxhash.xxh3_64_intdigest(some) - (1 << 63), id_, digest, a, len(some), some))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return written(source.mapInArrow(cut, schema), "occurrences")


def _shard_spans(distinct: DataFrame) -> DataFrame:
    """Spans found by the suffix arrays of shards; contexts of an anchor are in one shard."""
    schema = "id long, digest long, start long, stop long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        own: list[tuple] = []  # of one key; a single context repeats nothing
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_spans([h[3] for h in held], [h[:3] for h in held])
            rows = [(i, d, s + a, s + b) for (i, d, s, _), spans in zip(held, found) for a, b in spans]
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "digest", "start", "stop"])

        for batch in batches:
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last:
                    if len(own) > 1:
                        held += own
                        size += sum(len(r[3]) for r in own)
                    own, last = [], anchor
                    if size >= SHARD_BYTES:
                        yield flush()
                        held, size = [], 0
                own.append(tuple(row))
        if len(own) > 1:
            held += own
        if held:
            yield flush()

    rows = distinct.select("anchor", "first.id", "first.digest", "first.start", "raw")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def _dealt_spans(distinct: DataFrame) -> DataFrame:
    """Spans of anchors with very many contexts, whose strings are compared by digest, in any number of tasks."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (xxhash.xxh3_128_digest(raw[a : a + LENGTH]), i, d, s + a)
                for i, d, s, raw in zip(*(c.to_pylist() for c in batch.columns)) for a in range(len(raw) - LENGTH + 1)
            ]
            for low in range(0, len(rows), 20_000):
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 20_000]), types)], names=["string", "id", "digest", "start"])

    rows = distinct.select("first.id", "first.digest", "first.start", "raw")
    dealt = written(rows.mapInArrow(strings, "string binary, id long, digest long, start long"), "strings")
    first = dealt.groupBy("string").agg(F.min(F.struct("id", "digest", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("string", "first")
    later = dealt.join(first, "string").where(~F.struct("id", "digest", "start").eqNullSafe(F.col("first")))
    return later.select("id", "digest", "start", (F.col("start") + LENGTH).alias("stop"))

"""Best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens. How many sequences are
needed depends only on how many pieces there are of each length, a histogram
of at most ``capacity`` numbers, whatever the corpus. A configuration says how
many pieces of each length share a sequence; the linear program over
configurations asks for the fewest sequences that hold all pieces. It is solved
by multiplicative weights: lengths that lag behind gain weight, and a knapsack
by dynamic programming finds the heaviest configurations under the weights.
Whole copies of configurations are kept, and what rounding leaves is put
by best fit. The plan, a bounded table, is sent to the tasks, which number
the pieces of each length and read their places off it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, prepare, text_or_empty, written
from .tokens import tokenizer

CAPACITY = 2048
#: Rounds of weights; strength of a weight's answer to a lead; share of the best value that a configuration may lack.
ROUNDS, RATE, SLACK = 24, 4.0, 0.001
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
Config = tuple[tuple[int, int], ...]


def knapsack(weights: np.ndarray) -> np.ndarray:
    """The largest weight for each room from 0; ``weights[l]`` is that of a piece of length l, 0 if there is none."""
    room = len(weights) - 1
    best = np.zeros(room + 1)
    for c in range(1, room + 1):
        best[c] = max(best[c - 1], (weights[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def fractional_plan(counts: np.ndarray, rounds: int = ROUNDS) -> dict[Config, float]:
    """Copies (fractions) of configurations that hold ``counts[l]`` pieces of each length l, and few more."""
    room = len(counts) - 1
    sizes = np.arange(room + 1)
    there = counts > 0
    n = np.where(there, counts, 1).astype(float)
    held, plan = np.zeros(room + 1), defaultdict(float)
    longest_first = np.flatnonzero(there)[::-1]
    for turn in range(1, rounds + 1):
        lead = held / n
        weights = np.where(there, sizes / room * np.exp(-RATE * (lead - lead[there].min())), 0.0)
        best = knapsack(weights)
        for size in longest_first:
            due = turn / rounds * n[size] - held[size]
            if due <= 0:
                continue
            items, left = [int(size)], room - int(size)
            while left > 0 and best[left] > 0:
                # Among choices that are as good, take the length that is furthest behind.
                values = weights[1 : left + 1] + best[left - 1 :: -1]
                good = np.flatnonzero((values >= best[left] * (1 - SLACK)) & there[1 : left + 1]) + 1
                if not len(good):
                    left -= 1
                    continue
                pick = int(good[np.argmin(held[good] / n[good])])
                items.append(pick)
                left -= pick
            config = tuple(sorted(Counter(items).items(), reverse=True))
            copies = due / dict(config)[int(size)]
            plan[config] += copies
            for s, k in config:
                held[s] += k * copies
    return plan


def best_fit(counts: np.ndarray) -> Counter:
    """Configurations by best fit, longest pieces first, all pieces of a length and all equal rooms at once."""
    room = len(counts) - 1
    open_: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(left: int, config: Config, copies: int) -> None:
        if left not in open_:
            open_[left] = Counter()
            bisect.insort(rooms, left)
        open_[left][config] += copies

    for size in range(room, 0, -1):
        todo = int(counts[size])
        for left in rooms[bisect.bisect_left(rooms, size) :]:
            if not todo:
                break
            each = left // size
            for config, copies in list(open_[left].items()):
                for k, used in ((each, min(copies, todo // each)), (todo - each * min(copies, todo // each), 1)):
                    used = min(used, open_[left][config])
                    if k <= 0 or used <= 0 or k > each:
                        continue
                    open_[left][config] -= used
                    put(left - k * size, (*config, (size, k)), used)
                    todo -= k * used
                if not open_[left][config]:
                    del open_[left][config]
                if not todo:
                    break
            if not open_[left]:
                del open_[left]
                rooms.remove(left)
        each = room // size
        if todo // each:
            put(room - each * size, ((size, each),), todo // each)
        if todo % each:
            put(room - todo % each * size, ((size, todo % each),), 1)
    total: Counter = Counter()
    for configs in open_.values():
        total.update(configs)
    return total


def integral_plan(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Configurations and whole copies that hold exactly ``counts``."""
    room = len(counts) - 1
    left = counts.astype(np.int64).copy()
    chosen: Counter = Counter()
    if left[room]:
        chosen[((room, 1),)] += int(left[room])
        left[room] = 0
    if left.any():
        for config, copies in sorted(fractional_plan(left, rounds).items(), key=lambda x: (-x[1], x[0])):
            whole = min(int(copies), *(int(left[s]) // k for s, k in config))
            if whole:
                chosen[config] += whole
                for s, k in config:
                    left[s] -= k * whole
    chosen.update(best_fit(left))
    return sorted((c, k) for c, k in chosen.items() if k)


class Places:
    """Where the pieces of each length go: found by length and number."""

    def __init__(self, plan: list[tuple[Config, int]]):
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for config, copies in plan:
            offset = 0
            for size, k in config:
                rows.append((size, used[size], sequence, k, offset))
                used[size] += k * copies
                offset += size * k
            sequence += copies
        rows.sort()
        self.sequences = sequence
        self.size, self.first, self.sequence, self.k, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = (self.size << 45) | self.first

    def of(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        at = np.searchsorted(self.key, (size << 45) | number, "right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.k[at], self.offset[at] + within % self.k[at] * size


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, numbered within its task and length (``part, local``); written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = tokenizer(vocabulary), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for d, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    rows.append((d, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), part, seen[stop - start]))
                    seen[stop - start] += 1
                    start = stop
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return written(texts.mapInArrow(cut, PIECES), "pieces")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of ``docs`` with ``sequence_id`` and ``offset``; in a sequence, offsets follow without a gap.

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut, and
    only their first piece may be shorter. A null or empty text is the end id alone. Every row
    is packed, rows with equal ids too. Which of the pieces of one length goes where
    depends on how the input is split; how many sequences there are does not. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    pieces = cut_pieces(docs, vocabulary, end_id, capacity, id_col, text_col)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").agg(F.count("*")).collect():  # one row per length
        counts[size] = n
    places = spark.sparkContext.broadcast(Places(integral_plan(counts, rounds)))
    # A task's pieces of a length are numbered; add those of earlier tasks.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_task = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    numbered = lookup(pieces, by_task, ["part", "length"]).withColumn("number", F.col("earlier") + F.col("local"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = places.value.of(size, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, out)

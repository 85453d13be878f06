"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Test items are the indexed documents, and passages of the training texts are
the queries. A score is divided by the item's score against itself, so that 1
means that a passage has every word of the item. Items are indexed by length,
and passages are twice as long as the longest item of their index and overlap
by half, so an item lies within one of them, or all but a small part does.
Most passages are dropped by a first bound, worked out for many texts at once: the rarest words of
an item hold most of its score, so a passage must have enough of those of one item to reach
the threshold if it had all the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, text_or_empty, written
from .licenses import read_words

K1, B = 1.2, 0.75
#: The share of an item's own score that a passage must reach.
THRESHOLD = 0.6
#: The shares of word trigrams of the question and of the answer that must be there.
QUESTION, ANSWER = 0.6, 0.6
#: The share of an item's score that its common words may hold, and words of the texts that are bounded together.
COMMON, TOGETHER = 0.3, 200_000
#: Lengths double from class to class, from this one up.
SHORTEST = 48
#: Postings of one block of impacts, and of one index that is held in memory; more items make more indexes.
BLOCK, INDEX_POSTINGS = 64, 2_000_000
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def words_of(text: str) -> list[bytes]:
    return read_words(text.casefold().encode("utf-8", "replace")).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item; the answer is its last sentence, or its last quarter if there is but one."""
    sentences = [w for s in re.split(r"(?<=[.!?:])\s+", text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4)
    return words[: max(cut, 0)], words[max(cut, 0) :]


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of three words; of all words if they are fewer."""
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def overlap(part: list[bytes], there: list[bytes]) -> float:
    """The share of the trigrams of ``part`` that ``there`` has; 1 if it has no words."""
    wanted = trigrams(part)
    if not wanted:
        return 1.0
    n = min(3, len(part))
    return len(wanted & {tuple(there[i : i + n]) for i in range(len(there) - n + 1)}) / len(wanted)


class Index:
    """Postings of items of one length class. ``items``: id, text, and per word its count and share of the item's own score."""

    def __init__(self, longest: int, items: list[tuple[int, str, dict[bytes, float]]]):
        self.window, self.stride = 2 * longest, longest
        self.ids = [i for i, _, _ in items]
        self.parts = [question_and_answer(text) for _, text, _ in items]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for at, (_, _, shares) in enumerate(items):
            for w, share in shares.items():
                postings.setdefault(w, []).append((at, share))
        self.number = {w: k for k, w in enumerate(postings)}
        self.items = [[p[0] for p in x] for x in postings.values()]
        self.shares = [[p[1] for p in x] for x in postings.values()]
        self.tops = [[max(s[b : b + BLOCK]) for b in range(0, len(s), BLOCK)] for s in self.shares]
        self.most = np.array([*(max(s) for s in self.shares), 0.0])
        # The rarest words of each item, without which at most COMMON of its score is left, as arrays by term.
        spread = np.array([len(x) for x in self.items])
        rare: list[list[tuple[int, float]]] = [[] for _ in self.items]
        self.common = np.zeros(len(items))
        for at, (_, _, shares) in enumerate(items):
            left = 1.0
            for w in sorted(shares, key=lambda w: (spread[self.number[w]], -shares[w])):
                if left <= COMMON:
                    break
                rare[self.number[w]].append((at, shares[w]))
                left -= shares[w]
            self.common[at] = max(left, 0.0)
        self.rare_n = np.array([*(len(x) for x in rare), 0], np.int64)
        self.rare_first = np.concatenate([[0], np.cumsum(self.rare_n)])[:-1]
        self.rare_item = np.array([i for x in rare for i, _ in x], np.int64)
        self.rare_share = np.array([s for x in rare for _, s in x])

    def passages(self, texts: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, list[int]]]:
        """Text, start and distinct terms of the passages that may reach the threshold."""
        none, n_items = len(self.number), len(self.ids)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        terms = np.fromiter(map(self.number.get, chain.from_iterable(texts), repeat(none)), np.int64, int(sizes.sum()))
        # Half passages are numbered through, with a number left out between texts; a passage is two in a row.
        halves = -(-sizes // self.stride) + 1
        base = np.cumsum(halves) - halves
        first = np.cumsum(sizes) - sizes
        inside = np.flatnonzero(self.rare_n[terms])
        text = np.searchsorted(first, inside, "right") - 1
        half = base[text] + (inside - first[text]) // self.stride
        pairs = np.unique(half * (none + 1) + terms[inside])
        half, term = pairs // (none + 1), pairs % (none + 1)
        n = self.rare_n[term]
        at = np.repeat(self.rare_first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = np.repeat(half, n) * n_items + self.rare_item[at]
        order = np.argsort(keys, kind="stable")
        keys, shares = keys[order], self.rare_share[at][order]
        if not len(keys):
            return
        opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, sums = keys[opens], np.add.reduceat(shares, opens)
        need = threshold - 1e-9 - self.common[keys % n_items]
        found = []
        for step in (1, -1):  # with the half that follows, and with the one before
            other = np.minimum(np.searchsorted(keys, keys + step * n_items), len(keys) - 1)
            both = sums + np.where(keys[other] == keys + step * n_items, sums[other], 0.0)
            found.append(keys[both >= need] // n_items - (step < 0))
        for h in np.unique(np.concatenate(found)).tolist():
            t = int(np.searchsorted(base, h, "right")) - 1
            start = max(0, (h - int(base[t])) * self.stride)
            if h < 0 or start and start >= sizes[t]:
                continue
            distinct = np.unique(terms[first[t] + start : first[t] + min(start + self.window, sizes[t])])
            yield t, start, distinct[distinct != none].tolist()

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score reaches ``threshold``, by block-max WAND: ``(item, score)``."""
        out, least = [], threshold - 1e-9
        # Each list: [current item, place, term].
        lists = [[self.items[t][0], 0, t] for t in terms]
        most = self.most

        def move(entry: list[int], to: int) -> bool:
            items, at = self.items[entry[2]], entry[1]
            while at < len(items) and items[at] < to:
                # A block whose last item lies before is left in one step.
                last = min(at - at % BLOCK + BLOCK, len(items)) - 1
                at = last + 1 if items[last] < to else at + 1
            entry[1] = at
            if at < len(items):
                entry[0] = items[at]
            return at < len(items)

        while True:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                bound += most[entry[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            blocks, until = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
            for entry in lists[: pivot + 1]:
                items, at = self.items[entry[2]], entry[1]
                block = at // BLOCK
                while items[min(block * BLOCK + BLOCK, len(items)) - 1] < item and (block + 1) * BLOCK < len(items):
                    block += 1
                last = items[min(block * BLOCK + BLOCK, len(items)) - 1]
                if last >= item:
                    blocks += self.tops[entry[2]][block]
                    until = min(until, last + 1)
            if blocks >= least:
                if lists[0][0] == item:
                    here = [e for e in lists[: pivot + 1] if e[0] == item]
                    score = sum(self.shares[e[2]][e[1]] for e in here)
                    if score >= least:
                        out.append((item, score))
                    to, moving = item + 1, here
                else:
                    to, moving = item, [e for e in lists[:pivot] if e[0] < item]
            else:
                to, moving = max(until, item + 1), lists[: pivot + 1]
            done = {id(e) for e in moving if not move(e, to)}
            if done:
                lists = [e for e in lists if id(e) not in done]

    def leaks(self, texts: list[list[bytes]], threshold: float = THRESHOLD) -> dict[int, dict[int, tuple[float, float, float, int]]]:
        """Verified items of each text that has any: item id -> score, overlap of question and answer, first word of the passage."""
        found: dict[int, dict[int, tuple[float, float, float, int]]] = {}
        for text, start, terms in self.passages(texts, threshold):
            for item, score in self.retrieve(terms, threshold):
                question, answer = self.parts[item]
                size = len(question) + len(answer)
                there = texts[text][max(0, start - size) : start + self.window + size]
                q, a = overlap(question, there), overlap(answer, there)
                if q >= QUESTION and a >= ANSWER and score > found.get(text, {}).get(self.ids[item], (0.0,))[0]:
                    found.setdefault(text, {})[self.ids[item]] = (score, q, a, start)
        return found


def leaks_of(texts: list[str], indexes: list[Index], threshold: float) -> list[dict[int, tuple[float, float, float, int]]]:
    """The verified items of each text, over all ``indexes``."""
    out: list[dict] = []
    some: list[list[bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        some.append(words_of(t))
        size += len(some[-1])
        if size >= TOGETHER or k == len(texts) - 1:
            found: list[dict] = [{} for _ in some]
            for index in indexes:
                for text, hits in index.leaks(some, threshold).items():
                    found[text] |= hits
            out += found
            some, size = [], 0
    return out


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list[Index]]:
    """Indexes of all items; a list for each part that is held in memory at once.

    Words, their document frequencies and the mean length are counted by Spark over all items. Items
    without words or an id are not indexed; of rows with equal ids and texts one is.
    """
    spark = prepare(items.sparkSession)
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text")).where("item_id is not null").distinct()
    texts = written(texts.withColumn("row", F.xxhash64("item_id", "text")), "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, w, n, len(words)) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for words in [words_of(t)] for w, n in Counter(words).items()]
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["row", "word", "n", "length"])

    terms = written(texts.select("row", "text").mapInArrow(count, "row long, word binary, n long, length long"), "terms")
    total = terms.select("row", "length").distinct().agg(F.count("*").alias("items"), F.avg("length").alias("mean")).first()
    if not total["items"]:
        return []
    n, mean = total["items"], total["mean"]
    frequency = terms.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / mean))
    weighted = terms.join(frequency, "word").withColumn("weight", weight)
    parts = max(1, -(-terms.count() // INDEX_POSTINGS))
    weighted = written(weighted.select("row", "word", "weight", "length", F.pmod(F.hash("row"), F.lit(parts)).alias("part")), "postings")
    out = []
    for part in range(parts):  # each holds a bounded number of postings
        shares: dict[int, dict[bytes, float]] = {}
        lengths: dict[int, int] = {}
        mine = weighted.where(F.col("part") == part)
        for row, word, w, length, _ in mine.toLocalIterator():
            shares.setdefault(row, {})[bytes(word)] = w
            lengths[row] = length
        classes: dict[int, list] = {}
        for r in texts.where(F.pmod(F.hash("row"), F.lit(parts)) == part).toLocalIterator():
            if r["row"] in shares:
                own = sum(shares[r["row"]].values())
                longest = SHORTEST
                while longest < lengths[r["row"]]:
                    longest *= 2
                classes.setdefault(longest, []).append((r["item_id"], r["text"], {w: x / own for w, x in shares[r["row"]].items()}))
        out.append([Index(longest, x) for longest, x in sorted(classes.items())])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item whose question and answer were found in it.

    ``doc_id, item_id, score`` (the best passage's share of the item's own score), ``question_overlap,
    answer_overlap, first_word`` of that passage. Texts are searched whole. Null and empty texts have no
    passages; rows with equal ids are searched one by one; other columns are not read. No items give no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = spark.createDataFrame([], HITS)
    for indexes in build_indexes(items):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            for batch in batches:
                hits = leaks_of(batch.column(1).to_pylist(), shared.value, threshold)
                rows = [(d, i, *x) for d, found in zip(batch.column(0).to_pylist(), hits) for i, x in found.items()]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

        out = out.unionByName(texts.mapInArrow(run, HITS))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which :func:`find_leaks` finds nothing, with their own columns; rows are tested where they are read."""
    spark = prepare(docs.sparkSession)
    out = docs.select(text_or_empty(text_col).alias("text"), F.struct("*").alias("row"))
    for indexes in build_indexes(items):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not found for found in leaks_of(batch.column(0).to_pylist(), shared.value, threshold)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select("row.*")

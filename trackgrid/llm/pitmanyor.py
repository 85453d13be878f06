"""Hierarchical Pitman-Yor language model of words, seated by Gibbs sampling.

A restaurant per context, the word before, seats its words as customers; all
restaurants share a parent, whose customers are their tables, and the parent's
base is uniform over the known words and one unknown. Counts are of all training
text and grow with it.

Text becomes blocks of some million tokens. What is to be counted or looked up
travels as compressed arrays, one row per block and bucket: words by their hash,
pairs of word and context by theirs. Each block sends a word or pair once,
however frequent it is, so no bucket is hot. Buckets of pairs hold the cells
(context, word) and sample the tables of each, given the totals of its
restaurant and the parent's probability, which buckets of words send. Sampling is
synchronous: totals change between rounds. A cell's number of tables is drawn
from its exact conditional, by generalised Stirling numbers; customers beyond
``EXACT`` of a cell are seated in steps of a part of those seated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bucket_slices, pack, pack_rising, unpack, unpack_rising
from .arrays import rows as batch_of
from .common import discard, prepare, text_or_empty
from .common import written as written_once
from .tokens import release

#: Tokens of a block, tokens per bucket, and words whose hashes a process keeps.
BLOCK_TOKENS, BUCKET_TOKENS, KEPT = 1 << 21, 1 << 21, 500_000
#: Rounds of sampling; the probabilities of those after the first ones are averaged.
ROUNDS, BURN_IN = 3, 1
#: Strengths of the parent and of the restaurants of contexts.
STRENGTHS = (10.0, 2.0)
#: A cell's first customers are seated exactly, others in steps of 1 / STEP of those seated.
EXACT, STEP = 512, 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end of a text is a word that no text has.
END = xxhash.xxh3_64_intdigest(b"")


def _dicts(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def word_bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pair_bucket(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return word_bucket(mixed, parts)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; shuffles that made it, and those before, can go."""
    out = written_once(df, name)
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


# Blocks ---------------------------------------------------------------------

BLOCK = "n long, end long, sizes binary, held binary, ids binary, no_id binary, words binary, counts binary, tokens binary"


def make_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the columns ``id, held, text``: tokens as places in the block's sorted hashes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[bytes, int] = {}
        texts, ids, no_id, held, size = [], [], [], [], 0
        end = np.array([END], np.uint64)

        def block() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            learnt = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(tokens[learnt], minlength=len(words))
            row = (int(sizes.sum()), int(np.searchsorted(words, np.uint64(END))), pack(sizes), pack(np.array(held, np.uint8)), pack(np.array(ids, np.int64)), pack(np.array(no_id, np.uint8)), pack_rising(words), pack(counts.astype("<u4")), pack(tokens.astype("<u4")))
            return batch_of(BLOCK, [row])

        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                texts.append(np.concatenate([np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), end]))
                ids.append(i or 0)
                no_id.append(i is None)
                held.append(h)
                size += len(words) + 1
                if len(known) > KEPT:
                    known.clear()
                if size >= BLOCK_TOKENS:
                    yield block()
                    texts, ids, no_id, held, size = [], [], [], [], 0
        if texts:
            yield block()

    made = docs.select("id", "held", "text").mapInArrow(run, BLOCK)
    return made.withColumn("block", F.monotonically_increasing_id())


class Block:
    """A block with its words' numbers: the pairs that it asks for, by bucket, and which pair each token is."""

    def __init__(self, row: dict, numbers: np.ndarray, parts: int):
        self.sizes = unpack(row["sizes"], "<i8")
        self.held = unpack(row["held"], "u1").astype(bool)
        tokens = unpack(row["tokens"], "<u4")
        self.word = numbers[tokens]
        #: Place among the block's words of each token and of the word before it; a text begins after an end.
        self.at, starts = tokens.astype(np.int64), np.cumsum(self.sizes) - self.sizes
        self.before = np.r_[self.at[:1], self.at[:-1]]
        self.before[starts] = row["end"]
        context = numbers[self.before]
        seen = (self.word >= 0) & (context >= 0)
        keys, inverse = np.unique(context[seen].astype(np.uint64) << np.uint64(32) | self.word[seen].astype(np.uint64), return_inverse=True)
        buckets = pair_bucket(keys, parts)
        order = np.lexsort((keys, buckets))
        self.keys, self.buckets = keys[order], buckets[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: Place among ``keys`` of each token's pair; -1 if its word or context is unknown.
        self.pair = np.full(len(tokens), -1)
        self.pair[seen] = place[inverse]
        learnt = np.repeat(~self.held, self.sizes)
        self.counts = np.bincount(self.pair[seen & learnt], minlength=len(keys)).astype("<u4")


# Words ----------------------------------------------------------------------

ASKED = "bucket int, block long, words binary, counts binary"
NAMED = "bucket int, block long, ids binary, counts binary, n long, types long"


def _ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack_rising(row["words"], "<u8"), unpack(row["counts"], "<u4")
                yield batch_of(ASKED, [(k, row["block"], pack_rising(words[s]), pack(counts[s])) for k, s in bucket_slices(word_bucket(words, parts), parts)])

    return blocks.select("block", "words", "counts").mapInArrow(run, ASKED)


def _name_words(parts: int):
    """Number the trained words of a bucket by their counts: the k-th is ``k * parts + bucket``. A row without a block has them all."""

    def run(table: pa.Table) -> pa.Table:
        rows = _dicts(table)
        words = [unpack_rising(r["words"], "<u8") for r in rows]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, at, np.concatenate([unpack(r["counts"], "<u4") for r in rows]).astype(np.int64))
        bucket = rows[0]["bucket"]
        order = np.lexsort((distinct, -counts))
        types = int((counts > 0).sum())
        if types * parts >= 1 << 32:
            raise ValueError("words are numbered with 32 bits")
        numbers = np.full(len(distinct), -1, np.int64)
        numbers[order[:types]] = np.arange(types) * parts + bucket
        out = [(bucket, None, b"", pack(counts[order[:types]]), int(counts.sum()), types)]
        stops = np.cumsum([0, *map(len, words)]).tolist()
        for r, a, b in zip(rows, stops, stops[1:]):
            out.append((bucket, r["block"], pack(numbers[at[a:b]]), pack(counts[at[a:b]]), 0, 0))
        return pa.Table.from_batches([batch_of(NAMED, out)])

    return run


def _by_part(rows: list[dict], column: str, kind: str) -> np.ndarray:
    """The arrays of a block's answers in the order of their buckets."""
    parts = [unpack(r[column], kind) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


# Pairs ----------------------------------------------------------------------

PAIRS = "bucket int, block long, keys binary, counts binary"
#: What a bucket of pairs holds: cells of two and more customers with their tables, and the sums of tables over samples
#: (kind 0). What it tells a bucket of words (kind 1): tables of contexts and of words, and those of pairs trained once, which
#: always have one; ``asks`` marks words of its cells; ``few`` has the pairs trained once, 32 bits up, and twice.
BOTH = "kind int, bucket int, keys binary, counts binary, tables binary, sums binary, words int, ids binary, ones binary, of_context binary, of_word binary, asks binary, few long"


def _pairs(parts: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _dicts(answers)
        out = []
        for row in _dicts(block):
            made = Block(row, _by_part(rows, "ids", "<i8"), parts)
            out += [(k, row["block"], pack_rising(made.keys[s]), pack(made.counts[s])) for k, s in bucket_slices(made.buckets, parts)]
        return pa.Table.from_batches([batch_of(PAIRS, out)])

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a bucket, how often each was trained, and the place of each row's pairs among them."""
    keys, at = np.unique(np.concatenate([unpack_rising(r["keys"], "<u8") for r in rows]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([unpack(r["counts"], "<u4") for r in rows]).astype(np.int64))
    return keys, counts, at


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _told(bucket: int, keys: np.ndarray, tables: np.ndarray, ones: np.ndarray, parts: int, once: int = 0, twice: int = 0) -> list[tuple]:
    """What a bucket tells the buckets of words: tables of ``keys``, and pairs ``ones`` that always have one."""
    context, word = _split(keys)
    context_1, word_1 = _split(ones)
    ids, at = np.unique(np.concatenate([context, word, context_1, word_1]), return_inverse=True)
    n, n_1 = len(keys), len(ones)
    tally = lambda lo, hi, weights=None: np.bincount(at[lo:hi], weights, minlength=len(ids)).astype(np.int64)
    of_context, of_word = tally(0, n, tables), tally(n, 2 * n, tables)
    one_context, one_word = tally(2 * n, 2 * n + n_1), tally(2 * n + n_1, len(at))
    asks = np.zeros(len(ids), np.uint8)
    asks[at[: 2 * n]] = 1
    order = np.lexsort((ids, ids % parts))
    out = []
    for k, s in bucket_slices((ids % parts)[order], parts):
        some = order[s]
        ones_both = np.stack([one_context[some], one_word[some]])
        out.append((k, bucket, pack_rising(ids[some]), pack(ones_both.reshape(-1)), pack(of_context[some]), pack(of_word[some]), pack(asks[some]), once, twice))
        once = twice = 0
    return out


def _cells(parts: int):
    """The cells of a bucket, first with a table each; only those of two or more customers are kept, since one has one table."""

    def run(table: pa.Table) -> pa.Table:
        rows = _dicts(table)
        keys, counts, _ = _merged(rows)
        more = counts >= 2
        bucket, ones = rows[0]["bucket"], np.ones(int(more.sum()), np.int64)
        cells = (bucket, pack_rising(keys[more]), pack(counts[more]), pack(ones), pack(np.zeros(len(ones), np.int64)))
        told = _told(bucket, keys[more], ones, keys[counts == 1], parts, int((counts == 1).sum()), int((counts == 2).sum()))
        out = [(0, *cells, None, None, None, None, None, None, None)]
        out += [(1, t[1], None, None, None, None, t[0], *t[2:5], t[5], t[6], t[7] << 32 | t[8]) for t in told]
        return pa.Table.from_batches([batch_of(BOTH, out)])

    return run


# Seating --------------------------------------------------------------------


def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of ``n`` customers at ``t`` tables, by row and column."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, most):
            stay = np.log(np.maximum(n - t * discount, 0.0))
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + stay)
    return out


_STIRLING: dict[float, np.ndarray] = {}


def sample_tables(customers: np.ndarray, others: np.ndarray, log_p: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each cell of ``customers``, given the tables of ``others`` in its restaurant and the parent's ``log_p``."""
    if discount not in _STIRLING:
        _STIRLING.clear()
        _STIRLING[discount] = log_stirling(discount, EXACT)
    stirling, draw = _STIRLING[discount], rng.random(len(customers))
    out = np.ones(len(customers), np.int64)
    exact = np.minimum(customers, EXACT)
    order = np.argsort(exact, kind="stable")
    stops = np.searchsorted(exact[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        cells = order[stops[n] : stops[n + 1]]
        for start in range(0, len(cells), 1 + (1 << 21) // n):
            some = cells[start : start + 1 + (1 << 21) // n]
            t = np.arange(n)
            weight = stirling[n, 1 : n + 1] + (t + 1) * log_p[some, None] + np.cumsum(np.log(strength + discount * (others[some, None] + t)), 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[some] = 1 + (weight < draw[some, None] * weight[:, -1:]).sum(1)
    big = np.flatnonzero(customers > EXACT)
    seated, p = np.full(len(big), EXACT, np.int64), np.exp(log_p[big])
    while len(big):  # steps grow with those seated, so there are few
        step = np.minimum(np.maximum(seated // STEP, 1), customers[big] - seated)
        new = (strength + discount * (others[big] + out[big])) * p
        rate = new / (new + seated - discount * out[big])
        out[big] += rng.binomial(step, np.clip(rate, 0.0, 1.0))
        seated += step
        left = seated < customers[big]
        big, seated, p = big[left], seated[left], p[left]
    return out


# Words as a parent ----------------------------------------------------------

#: Per bucket of words, by number: counts, tables in the word's restaurant and customers in the parent that never change,
#: the same in all, tables in the parent, and sums over samples of tables and of the parent's probability.
STATE = "words int, counts binary, ones binary, tables binary, customers binary, parents binary, table_sums binary, p_sums binary, all_customers long, all_parents long, once long, twice long"
ANSWERS = "bucket int, words int, ids binary, tables binary, p binary"


class Parent:
    """The parent restaurant's totals, and its probabilities."""

    def __init__(self, types: int, strength: float, discount: float, customers: int, tables: int):
        self.types, self.strength, self.discount, self.customers, self.tables = types, strength, discount, customers, tables

    @property
    def base(self) -> float:
        return 1.0 / (self.types + 1)

    @property
    def unknown(self) -> float:
        """Probability of the one unknown word."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers) * self.base

    def p(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables) / (self.strength + self.customers) + self.unknown


def _sum_totals(state: dict, told: list[dict], parts: int, with_ones: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables in the restaurants of a bucket's words and customers in the parent, of both kinds."""
    n = len(unpack(state["counts"], "<i8"))
    ones = np.zeros((2, n), np.int64) if with_ones else unpack(state["ones"], "<i8").reshape(2, n).copy()
    tables, customers = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for row in told:
        at = unpack_rising(row["ids"], "<i8") // parts
        tables[at] += unpack(row["of_context"], "<i8")
        customers[at] += unpack(row["of_word"], "<i8")
        if with_ones:
            ones[:, at] += unpack(row["ones"], "<i8").reshape(2, -1)
    return ones, tables + ones[0], customers + ones[1]


def _first_state(parts: int):
    """The state from words and first totals: each word has a table in the parent."""

    def run(words: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in _dicts(words):
            ones, tables, customers = _sum_totals(row, _dicts(told), parts, True)
            parents = (customers > 0).astype(np.int64)
            none = np.zeros(len(tables))
            few = [int((customers == k).sum()) for k in (1, 2)]
            out.append((row["bucket"], row["counts"], pack(ones.reshape(-1)), pack(tables), pack(customers), pack(parents), pack(none.astype(np.int64)), pack(none), int(customers.sum()), int(parents.sum()), *few))
        return pa.Table.from_batches([batch_of(STATE, out)])

    return run


def _next_state(parts: int, parent: Parent, seed: int):
    """The state after a round: new totals, and the parent's tables sampled."""

    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in _dicts(state):
            ones, tables, customers = _sum_totals(row, _dicts(told), parts, False)
            parents = unpack(row["parents"], "<i8")
            rng = np.random.default_rng([seed, 0, row["words"]])
            log_base = np.full(len(parents), np.log(parent.base))
            parents = np.where(customers > 0, sample_tables(np.maximum(customers, 1), parent.tables - parents, log_base, parent.strength, parent.discount, rng), 0)
            out.append((row["words"], row["counts"], row["ones"], pack(tables), pack(customers), pack(parents), row["table_sums"], row["p_sums"], int(customers.sum()), int(parents.sum()), 0, 0))
        return pa.Table.from_batches([batch_of(STATE, out)])

    return run


def _add_sample(parent: Parent):
    """Add the state of a round to the sums; the parent's totals are those of the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tables, p = unpack(row["tables"], "<i8"), parent.p(unpack(row["customers"], "<i8"), unpack(row["parents"], "<i8"))
                row["table_sums"] = pack(unpack(row["table_sums"], "<i8") + tables)
                row["p_sums"] = pack(unpack(row["p_sums"], "<f8") + p)
                yield batch_of(STATE, [tuple(row.values())])

    return run


def _answer_cells(parts: int, parent: Parent):
    """To each bucket of pairs: the totals of the words of its cells, and the parent's probabilities."""

    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in _dicts(state):
            tables = unpack(row["tables"], "<i8")
            p = parent.p(unpack(row["customers"], "<i8"), unpack(row["parents"], "<i8"))
            for t in _dicts(told):
                ids = unpack_rising(t["ids"], "<i8")[unpack(t["asks"], "u1") == 1]
                out.append((t["bucket"], row["words"], pack_rising(ids), pack(tables[ids // parts]), pack(p[ids // parts])))
        return pa.Table.from_batches([batch_of(ANSWERS, out)])

    return run


def _seat_cells(parts: int, strength: float, discount: float, seed: int, counted: bool):
    """One round of a bucket of pairs: new tables of its cells, and what they make in total."""

    def run(cells: pa.Table, answers: pa.Table) -> pa.Table:
        out, rows = [], _dicts(answers)
        ids = np.concatenate([unpack_rising(r["ids"], "<i8") for r in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(ids)
        of = lambda name, kind: (np.concatenate([unpack(r[name], kind) for r in rows]) if rows else np.zeros(0, kind))[order]
        ids, totals, p = ids[order], of("tables", "<i8"), of("p", "<f8")
        for row in _dicts(cells):
            keys, customers, tables = unpack_rising(row["keys"], "<u8"), unpack(row["counts"], "<i8"), unpack(row["tables"], "<i8")
            context, word = _split(keys)
            others = totals[np.searchsorted(ids, context)] - tables
            rng = np.random.default_rng([seed, 1, row["bucket"]])
            tables = sample_tables(customers, others, np.log(p[np.searchsorted(ids, word)]), strength, discount, rng)
            sums = unpack(row["sums"], "<i8") + (tables if counted else 0)
            out.append((0, row["bucket"], row["keys"], row["counts"], pack(tables), pack(sums), None, None, None, None, None, None, None))
            none = np.zeros(0, np.uint64)
            out += [(1, t[1], None, None, None, None, t[0], *t[2:7], 0) for t in _told(row["bucket"], keys, tables, none, parts)]
        return pa.Table.from_batches([batch_of(BOTH, out)])

    return run


# Scores ---------------------------------------------------------------------

#: To a block: of its words (kind 0) numbers, counts, mean tables and mean probabilities, of its pairs (kind 1) customers less discounts.
#: Means travel with 24 bits, which is far beyond what the samples tell.
VALUES = "kind int, bucket int, block long, ids binary, counts binary, tables binary, p binary"


def _answer_words(parts: int, samples: int):
    def run(state: pa.Table, named: pa.Table) -> pa.Table:
        out, state_rows = [], _dicts(state)
        for row in _dicts(named):
            ids = unpack(row["ids"], "<i8")
            tables, p = np.zeros(len(ids)), np.zeros(len(ids))
            for s in state_rows:
                at, seen = np.maximum(ids, 0) // parts, ids >= 0
                tables[seen] = unpack(s["table_sums"], "<i8")[at[seen]] / samples
                p[seen] = unpack(s["p_sums"], "<f8")[at[seen]] / samples
            out.append((0, row["bucket"], row["block"], row["ids"], row["counts"], pack(tables.astype("<f4")), pack(p.astype("<f4"))))
        return pa.Table.from_batches([batch_of(VALUES, out)])

    return run


def _answer_pairs(discount: float, samples: int):
    def run(pairs: pa.Table, cells: pa.Table) -> pa.Table:
        rows = _dicts(pairs)
        keys, counts, at = _merged(rows)
        tables = (counts == 1).astype(float)
        for c in _dicts(cells):
            tables[np.searchsorted(keys, unpack_rising(c["keys"], "<u8"))] = unpack(c["sums"], "<i8") / samples
        values, out, start = (counts - discount * tables).astype("<f4"), [], 0
        for r in rows:
            stop = start + len(unpack(r["keys"], "<u8"))
            out.append((1, r["bucket"], r["block"], b"", b"", b"", pack(values[at[start:stop]])))
            start = stop
        return pa.Table.from_batches([batch_of(VALUES, out)])

    return run


SCORES = "id long, no_id int, held int, n_tokens long, n_known long, base_score double, score double"


def _score(parts: int, tokens: int, types: int, unknown: float, strength: float, discount: float):
    def run(block: pa.Table, values: pa.Table) -> pa.Table:
        rows = _dicts(values)
        of_words, of_pairs = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        out = []
        for row in _dicts(block):
            numbers, counts = _by_part(of_words, "ids", "<i8"), _by_part(of_words, "counts", "<i8")
            tables, p = _by_part(of_words, "tables", "<f4").astype(float), _by_part(of_words, "p", "<f4").astype(float)
            made = Block(row, numbers, parts)
            own = np.r_[_by_part(of_pairs, "p", "<f4").astype(float), 0.0]  # the last for pairs with an unknown
            p = np.where(numbers >= 0, p, unknown)
            total = strength + counts[made.before]
            chance = own[made.pair] / total + (strength + discount * tables[made.before]) / total * p[made.at]
            seen = counts[made.at]
            starts = np.cumsum(made.sizes) - made.sizes
            add = lambda x: np.add.reduceat(x, starts)
            out += zip(unpack(row["ids"], "<i8").tolist(), unpack(row["no_id"], "u1").tolist(), made.held.astype(int).tolist(), made.sizes.tolist(), add((seen > 0).astype(np.int64)).tolist(),
                       add(np.log10((seen + 1) / (tokens + types + 1))).tolist(), add(np.log10(chance)).tolist())
        return pa.Table.from_batches([batch_of(SCORES, out)])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose crc32 in decimal is 2 modulo 7; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 == 2


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, burn_in: int = BURN_IN, strengths: tuple[float, float] = STRENGTHS) -> DataFrame:
    """Per row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows for which ``held`` is not true, and scores all. Tokens are words between ASCII
    white space, A-Z in lower case, and one end of the text. ``base_score`` is the sum of log10((c + 1) / (N + V + 1))
    over tokens; ``score`` the log10 probability under the model, with levels averaged over samples one by one. A null or
    empty text is an end alone. Rows are independent: equal ids and repeated texts count one by one; only the named
    columns are read. Texts are taken whole: a longer one than a block is a block. No rows give no rows; without any
    training rows all words are the unknown one, of probability 1.
    """
    spark = prepare(docs.sparkSession)
    named_docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), text_or_empty(text_col).alias("text"))
    blocks = written(make_blocks(named_docs), "lm-blocks")
    parts = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))
    named = written(_ask_words(blocks, parts).groupBy("bucket").applyInArrow(_name_words(parts), NAMED), "lm-words")
    sums = named.agg(F.sum("n"), F.sum("types")).first()
    n_tokens, n_types = sums[0] or 0, sums[1] or 0
    answers, words = named.where("block is not null"), named.where("block is null")
    light = blocks.select("block", "end", "sizes", "held", "tokens")
    pairs = written(light.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_pairs(parts), PAIRS), "lm-pairs")
    told_of = lambda both: both.where("kind = 1").select("words", "bucket", "ids", "ones", "of_context", "of_word", "asks")
    cells_of = lambda both: both.where("kind = 0").select("bucket", "keys", "counts", "tables", "sums")
    first = both = written(pairs.groupBy("bucket").applyInArrow(_cells(parts), BOTH), "lm-cells")
    few = first.agg(F.sum(F.shiftright("few", 32)), F.sum(F.col("few").bitwiseAND(0xFFFFFFFF))).first()
    discount = _discount(*few)
    state = written(words.groupBy("bucket").cogroup(told_of(both).groupBy("words")).applyInArrow(_first_state(parts), STATE), "lm-state")

    def parent_of(state: DataFrame, own_discount: float) -> Parent:
        all_customers, all_parents = state.agg(F.sum("all_customers"), F.sum("all_parents")).first()
        return Parent(n_types, strengths[0], own_discount, all_customers or 0, all_parents or 0)

    few = state.agg(F.sum("once"), F.sum("twice")).first()
    parent = parent_of(state, _discount(*few))
    unknown = 0.0
    for k in range(rounds):
        counted = k >= burn_in
        asked = told_of(first).groupBy("words")  # the words of a bucket's cells stay the same
        answers_k = state.groupBy("words").cogroup(asked).applyInArrow(_answer_cells(parts, parent), ANSWERS)
        seated = cells_of(both).groupBy("bucket").cogroup(answers_k.groupBy("bucket")).applyInArrow(_seat_cells(parts, strengths[1], discount, k, counted), BOTH)
        before, both = both, written(seated, "lm-cells")
        after = written(state.groupBy("words").cogroup(told_of(both).groupBy("words")).applyInArrow(_next_state(parts, parent, k), STATE), "lm-state")
        old, parent = state, parent_of(after, parent.discount)
        state = after
        if counted:
            unknown += parent.unknown / (rounds - burn_in)
            state = written(after.mapInArrow(_add_sample(parent), STATE), "lm-state")
            discard(after)
        discard(old)
        if before is not first:
            discard(before)
    samples = rounds - burn_in
    of_words = state.groupBy("words").cogroup(answers.groupBy("bucket")).applyInArrow(_answer_words(parts, samples), VALUES)
    of_pairs = pairs.groupBy("bucket").cogroup(cells_of(both).groupBy("bucket")).applyInArrow(_answer_pairs(discount, samples), VALUES)
    values = written(of_words.unionByName(of_pairs), "lm-values")
    for done in (named, pairs, first, both, state):
        discard(done)
    scored = blocks.select("block", "end", "sizes", "held", "ids", "no_id", "tokens").groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score(parts, n_tokens, n_types, unknown, strengths[1], discount), SCORES)
    return scored.select(
        F.when(F.col("no_id") == 0, F.col("id")).alias("id"), (F.col("held") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _discount(once: int | None, twice: int | None) -> float:
    """The share that absolute discounting takes, from how many are seen once and twice."""
    once, twice = once or 0, twice or 0
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5

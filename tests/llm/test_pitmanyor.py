import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import ROWS, documents, ordered, prose, tuples

from trackgrid.llm import pitmanyor as py

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MORE = [(1000 + i, prose(5 + i % 90, i)) for i in range(200)] + [(2000, "of the " * 900), (2001, "of the " * 30 + "unknownword here")]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(low), None]


def is_held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(rows, rounds=py.ROUNDS, burn_in=py.BURN_IN):
    """The model in dictionaries, with the draws of one bucket."""
    train = [tokens(t) for d, t in rows if not is_held(d)]
    counts = Counter(w for t in train for w in t)
    n, types = sum(counts.values()), len(counts)
    hashed = lambda w: xxhash.xxh3_64_intdigest(b"" if w is None else w.encode())
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], hashed(w))))}
    pairs = Counter((u, w) for t in train for u, w in zip([None, *t], t))
    cells = sorted((p for p, c in pairs.items() if c > 1), key=lambda p: (rank[p[0]], rank[p[1]]))
    share = lambda values: py._discount(values.count(1), values.count(2))
    d1 = share(list(pairs.values()))
    seats = dict.fromkeys(pairs, 1)

    def totals():
        context, word = Counter(), Counter()
        for (u, w), t in seats.items():
            context[u] += t
            word[w] += t
        return context, word

    context, word = totals()
    d0 = share(list(word.values()))
    parents = {w: int(word[w] > 0) for w in rank}
    base, (s0, s1) = 1 / (types + 1), py.STRENGTHS
    sums, table_sums, p_sums, unknown_sum = Counter(), Counter(), Counter(), 0.0

    def chances():
        customers, tables = sum(word.values()), sum(parents.values())
        unknown = (s0 + d0 * tables) / (s0 + customers) * base
        return {w: (word[w] - d0 * parents[w]) / (s0 + customers) + unknown for w in rank}, unknown, tables

    for k in range(rounds):
        p, _, parent_tables = chances()
        rng = np.random.default_rng([k, 1, 0])
        others = np.array([context[u] - seats[u, w] for u, w in cells])
        new = py.sample_tables(np.array([pairs[c] for c in cells]), others, np.log([p[w] for _, w in cells]), s1, d1, rng)
        seats.update(zip(cells, new.tolist()))
        context, word = totals()
        words = list(rank)
        customers = np.array([word[w] for w in words])
        rng = np.random.default_rng([k, 0, 0])
        new = py.sample_tables(np.maximum(customers, 1), parent_tables - np.array([parents[w] for w in words]), np.full(len(words), math.log(base)), s0, d0, rng)
        parents = dict(zip(words, np.where(customers > 0, new, 0).tolist()))
        if k >= burn_in:
            p, unknown, _ = chances()
            unknown_sum += unknown
            for x, add in ((sums, seats), (table_sums, context), (p_sums, p)):
                for key, value in add.items():
                    x[key] += value
    m = rounds - burn_in
    mean_p = lambda w: p_sums[w] / m if w in rank else unknown_sum / m

    def chance(u, w):
        own = pairs[u, w] - d1 * sums[u, w] / m if (u, w) in pairs else 0.0
        return (own + (s1 + d1 * table_sums[u] / m) * mean_p(w)) / (s1 + counts[u])

    assert sum(chance("the", w) for w in rank) + chance("the", "never seen") == pytest.approx(1)
    out = []
    for d, text in rows:
        t = tokens(text)
        out.append((d, is_held(d), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + types + 1)) for w in t), sum(math.log10(chance(u, w)) for u, w in zip([None, *t], t))))
    return out


COLUMNS = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_scores_match_a_plain_model(spark):
    rows = ROWS + MORE
    assert sum(is_held(d) for d, _ in rows) > 20
    got = ordered(tuples(py.score_documents(documents(spark, rows), py.held_out()), *COLUMNS))
    want = ordered(brute(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)
    held = [g for g in got if g[1] and g[2] > 20]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_many_buckets_and_blocks(spark, monkeypatch):
    rows = ROWS + MORE
    one = {g[0]: g for g in tuples(py.score_documents(documents(spark, MORE), py.held_out()), *COLUMNS)}
    monkeypatch.setattr(py, "BUCKET_TOKENS", 700)
    many = {g[0]: g for g in tuples(py.score_documents(documents(spark, MORE).repartition(7), py.held_out()), *COLUMNS)}
    assert one.keys() == many.keys() and len(rows) > len(one)
    for d, g in one.items():
        assert many[d][:5] == g[:5] and many[d][5] == pytest.approx(g[5]) and many[d][6] == pytest.approx(g[6], rel=0.03)


def ways(n, t, d):
    """The weight of all seatings of ``n`` customers at ``t`` tables, one by one."""
    total = 0.0
    for choice in itertools.product(range(t), repeat=n - 1):
        seats, weight, tables = [1], 1.0, 1
        for c in choice:
            if c == tables:
                tables += 1
                seats.append(1)
            elif c < tables:
                weight *= seats[c] - d
                seats[c] += 1
            else:
                weight = 0.0
                break
        total += weight * (tables == t)
    return total


def test_seating_follows_its_distribution():
    table = py.log_stirling(0.3, 6)
    for n in range(1, 7):
        for t in range(1, n + 1):
            assert math.exp(table[n, t]) == pytest.approx(ways(n, t, 0.3))
    rng = np.random.default_rng(1)
    n, size, others, p, strength = 5, 60_000, 7, 0.05, 2.0
    drawn = np.bincount(py.sample_tables(np.full(size, n), np.full(size, others), np.full(size, math.log(p)), strength, 0.3, rng), minlength=n + 1) / size
    weight = [0.0] + [ways(n, t, 0.3) * p**t * math.prod(strength + 0.3 * (others + j) for j in range(t)) for t in range(1, n + 1)]
    assert drawn == pytest.approx(np.array(weight) / sum(weight), abs=0.01)
    big = py.sample_tables(np.array([2, 600, 100_000]), np.array([5, 50, 50]), np.log([0.1, 0.01, 0.5]), strength, 0.3, rng)
    assert (1 <= big).all() and (big <= [2, 600, 100_000]).all() and 25 < big[2] < 400


def test_arrays_survive_packing():
    for a in (np.zeros(0, np.int64), np.arange(5, dtype=np.uint64) << np.uint64(60), np.array([3, 9, 9, 2**63], np.uint64)):
        assert (py.unpack(py.pack(a), a.dtype.str) == a).all() and (py.unpack_rising(py.pack_rising(a), a.dtype.str) == a).all()


def test_nothing_to_learn(spark):
    assert py.score_documents(documents(spark, []), py.held_out()).count() == 0
    held = next(i for i in range(100) if is_held(i))
    got = tuples(py.score_documents(documents(spark, [(held, "a b"), (held, None)]), py.held_out()), *COLUMNS)
    assert ordered(got) == [(held, True, 1, 0, 0, 0.0, 0.0), (held, True, 3, 0, 0, 0.0, 0.0)]

import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import ROWS, WORDS, documents, ordered, prose, tuples

import corpus_pipeline
from trackgrid.llm import neardup
from trackgrid.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Components over distinct sets by comparing all pairs; the expected rows."""
    sets = [word_sets(t) for _, t in rows]
    named = sorted({s for s, (d, _) in zip(sets, rows) if s and d is not None}, key=lambda s: (len(s), sorted(s)))
    root = {s: s for s in named}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(named):
        for b in named[i + 1 :]:
            if 100 * len(a & b) >= 85 * len(a | b):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for s, (d, _) in zip(sets, rows):
        if s and d is not None:
            least[find(s)].append(d)
    out = []
    for s, (d, _) in zip(sets, rows):
        c = (min(least[find(s)]) if s in root else None) if s else d
        out.append((d, len(s), c, c == d))
    return out


def edited(base, n, seed):
    r = random.Random(seed)
    words = base.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_awkward_rows(spark):
    got = tuples(neardup.near_dups(documents(spark)), "doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got) == ordered(brute(ROWS))
    assert neardup.near_dups(documents(spark, [])).count() == 0


def test_large_groups_of_near_copies_match_all_pairs(spark):
    rows, n = [], 0
    for g in range(6):
        base = prose(140, g)
        for i in range(60):
            rows.append((n := n + 1, edited(base, i % 8, 1000 * g + i)))
            if i % 10 == 0:  # a chain of small steps away from the base
                rows.append((n := n + 1, edited(rows[-1][1], 1, n)))
            if i % 15 == 0:
                rows.append((n := n + 1, base[: len(base) - 9 * i]))
    rows += [(n + k, prose(30, 10_000 + k)) for k in range(100)]
    rows += [(n + 200 + k, " ".join(random.Random(k).sample(WORDS, 4))) for k in range(30)]
    random.Random(3).shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) < len(rows) - 100
    got = tuples(neardup.near_dups(documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got) == ordered(want)


def test_keep_first_keeps_columns(spark):
    docs = documents(spark)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    stays = {d for d, _, _, k in brute(ROWS) if k}
    assert ordered(tuples(kept, "doc_id", "text")) == ordered((d, t) for d, t in ROWS if d in stays)


def test_bayes_drops_few_pairs_at_the_threshold():
    r = np.random.default_rng(0)
    matches = r.binomial(neardup.BATCH, 0.85, (20_000, neardup.BANDS * neardup.ROWS // neardup.BATCH)).cumsum(1)
    least = [neardup.least_matches(neardup.BATCH * (i + 1)) for i in range(matches.shape[1])]
    assert (matches >= least).all(1).all()
    far = r.binomial(neardup.BATCH, 0.4, (5_000, matches.shape[1])).cumsum(1)
    assert (far >= least).all(1).mean() < 1e-3


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_of_a_chain(spark, n):
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + ([("900", "901")] if n else []), "a string, b string")
    got = dict(tuples(components(links), "node", "label"))
    assert got == ({**{f"{i:03d}": "000" for i in range(n + 1)}, "900": "900", "901": "900"} if n else {})


@pytest.mark.parametrize("percent", [80, 85])
def test_links_at_other_thresholds_match_all_pairs(spark, percent):
    rows = []
    for g in range(12):
        base = prose(100, 500 + g)
        rows += [(g * 20 + i, edited(base, i % 5, 7000 + g * 20 + i)) for i in range(20)]
    sets = {d: word_sets(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    between = 0
    for a in sets:
        for b in range(a + 1, len(rows)):
            shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            between += 80 * union <= 100 * shared < 85 * union
            if 100 * shared >= percent * union:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert between > 50
    got = dict(tuples(neardup.near_dups(documents(spark, rows), percent=percent), "doc_id", "component_id"))
    assert got == {d: find(d) for d in sets}


def test_pipeline_stage_links_from_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = words[:50] + ["other"] + words[51:]  # 95 shared of 105
    far = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:]  # 90 shared of 110, 0.818
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = documents(spark, rows)
    assert {d for d, in tuples(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id")} == {1}
    assert {d for d, in tuples(neardup.keep_first(docs), "doc_id")} == {1, 3}

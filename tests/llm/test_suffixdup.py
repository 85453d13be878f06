import hashlib
import random

import numpy as np
import pytest
from fixtures import ROWS, documents, ordered, prose, tuples

from trackgrid.llm import suffixdup

LENGTH = suffixdup.LENGTH


def brute(rows):
    """Rows with distinct ids only."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            s = raw[i : i + LENGTH]
            if s in seen:
                covered[i : i + LENGTH] = True
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out.append((d, len(raw), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages():
    r = random.Random(2)
    shared = [prose(n, 50 + n) for n in (12, 18, 25, 60)]
    rows = [(i, " ".join(r.choice([prose(20, r.randrange(10**6)), r.choice(shared), r.choice(shared)[:130]]) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "ab" * 100 + "c" * 250), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, None), (106, ""), (107, rows[3][1]), (None, rows[4][1]), (108, "é" * 120)]
    return rows


@pytest.mark.parametrize("hot, joined", [(4096, False), (2, False), (4096, True)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, joined):
    monkeypatch.setattr(suffixdup, "HOT_CONTEXTS", hot)
    if joined:
        monkeypatch.setattr(suffixdup, "BROADCAST_ANCHORS", 0)
        monkeypatch.setattr(suffixdup, "BROADCAST_SPANS", 0)
    rows = passages()
    got = suffixdup.remove_repeats(documents(spark, rows), with_text=True)
    assert ordered(tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == ordered(r[:5] for r in brute(rows))
    assert {r[0]: bytes(r[1]) for r in tuples(got, "doc_id", "kept")} == {r[0]: r[5] for r in brute(rows)}


def test_repeated_rows_are_one_document(spark):
    got = tuples(suffixdup.remove_repeats(documents(spark)), "doc_id", "n_bytes", "n_removed")
    assert len(got) == len(ROWS)
    assert len({r for r in got if r[0] == 12}) == 1
    assert suffixdup.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(1)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 8))]
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ends = starts + sizes
        row, is_end = np.zeros(int((sizes + 1).sum()), np.int64), np.zeros(int((sizes + 1).sum()), bool)
        is_end[ends] = True
        row[~is_end] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        order = suffixdup.suffix_array(row, ends[owner], is_end)

        def suffix(i):
            return [*((int(x), 0) for x in row[i : ends[owner[i]]]), (0, int(ends[owner[i]]))]

        assert order.tolist() == sorted(range(len(row)), key=suffix)
        shared = suffixdup.common_prefixes(row, order, starts, ends)
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            n = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
            assert shared[k] == min(n, LENGTH)


def test_equal_strings_have_equal_anchors_across_steps():
    r = random.Random(7)
    shared = bytes(r.randrange(256) for _ in range(400))
    for before in (0, 50, suffixdup._STEP - 150, 2 * suffixdup._STEP - 10):
        raw = np.frombuffer(bytes(r.randrange(256) for _ in range(before)) + shared + b"tail" * 30, np.uint8)
        _, places, first, last = suffixdup.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - LENGTH and (first[1:] == last[:-1] + 1).all()
        owner = np.repeat(places, last - first + 1)[before : before + 301] - before
        if before == 0:
            want = owner
        assert (owner == want).all()

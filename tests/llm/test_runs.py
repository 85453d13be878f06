import hashlib
import random
import re
import zlib

from fixtures import ROWS, documents, ordered, prose, tuples

from trackgrid.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All maximal stretches of each smallest period, by trying every period."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, size = i - q, j - i + q
            smaller = any(all(words[k] == words[k - d] for k in range(start + d, j)) for d in range(1, q))
            if size >= max(6, 4 * q) and not smaller:
                out.append((start, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute_runs(words)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)), n)


def test_runs_of_random_texts_match_brute_force():
    r = random.Random(5)
    for trial in range(400):
        letters = r.choice([1, 2, 2, 3, 5])
        words = [str(r.randrange(letters)) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):  # planted periods, one after the other or overlapping
            block = [str(r.randrange(letters + 2)) for _ in range(r.randrange(1, 7))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (block * 7)[: r.randrange(1, 7 * len(block) + 1)]
        assert runs.word_runs([w.encode() for w in words]) == brute_runs(words), words


def test_query_matches_brute_force(spark):
    more = [(i, prose(3 + i % 150, i)) for i in range(100, 400)] + [(i, "a b " * (i % 13) + prose(i % 9, i) + " c" * (i % 20)) for i in range(500, 620)]
    docs = documents(spark, ROWS + more)
    got = runs.runs_digest(runs.find_runs(docs, text_col=runs.planted(docs)))
    want = [brute(d, t) for d, t in ROWS + more]
    assert sum(w[1] > 0 for w in want) > 60
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    assert got.columns == columns
    assert ordered(tuples(got, *columns)) == ordered(want)


def test_long_texts_of_few_words_stay_cheap(spark):
    text = "x " * 60_000 + "a b c " * 30_000
    docs = documents(spark, [(1, text), (2, prose(40_000, 1))])
    got = dict((d, r) for d, r in tuples(runs.find_runs(docs), "id", "runs"))
    assert [tuple(r) for r in got[1]] == [(0, 60_000, 1), (60_000, 90_000, 3)]
    assert [tuple(r) for r in got[2]] == brute_runs([]) or all(r["length"] >= 6 for r in got[2])


def test_empty_table(spark):
    docs = documents(spark, [])
    assert runs.runs_digest(runs.find_runs(docs, text_col=runs.planted(docs))).count() == 0

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import ROWS, documents, ordered, tuples
from tokenizers import Tokenizer

from trackgrid.llm import packing, tokenbin, tokens
from trackgrid.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "a\n\n b", "a\t b \n", "x\x1c y!\x1c!", "　  a b", "<|endoftext|> a <|endoftext|>", "a \0b c", "don't  we'll ",
    "\r\n a\r\n", "﻿q 12 345", "tail  ", "!\x85 \x85!", "don't, we'll! x's. (a) b)) c?!", "1,5. é, ñ; ². ...", "a ,b . . c,,, d", "\xa0a \xa0",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_cached_ids_are_the_librarys(plain):
    texts = ODD + [t or "" for _, t in ROWS]
    small = tokens.CachedTokenizer(VOCABULARY, kept=5)
    for cached in (tokens.CachedTokenizer(VOCABULARY), small):
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(texts)] == [plain(t) for t in texts]


def test_codes_give_any_token():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 1 << 32, 3000), r.integers(0, 300, 5000), np.zeros(0, np.int64), np.array([255, 256, 65535, 65536]), r.integers(0, 50000, 512)):
        ids = ids.astype(np.uint32)
        file = tokenbin.TokenFile(tokenbin.pack_file([7], [len(ids)], ids))
        assert file.tokens(0, len(ids)).tolist() == ids.tolist()
        assert [file.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
        assert file.tokens(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 : len(ids) // 2].tolist()


@pytest.mark.parametrize("file_ids", [50, 1 << 22])
def test_token_files_round_trip(spark, plain, file_ids):
    files = tokenbin.write_token_files(documents(spark), scratch_path(spark, "tokens"), VOCABULARY, 2, file_ids)
    got = tuples(tokenbin.read_token_files(spark, files, with_ids=True), "doc_id", "start", "n_tokens", "ids_crc32", "ids")
    start, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*plain(t), 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_no_documents_give_no_files(spark):
    files = tokenbin.write_token_files(documents(spark, []), scratch_path(spark, "tokens"), VOCABULARY, 2)
    assert tokenbin.read_token_files(spark, files).count() == 0
    assert packing.pack(documents(spark, []), VOCABULARY, 0).count() == 0


def test_pack_whole_documents(spark, plain):
    room = 256
    got = tuples(packing.pack(documents(spark), VOCABULARY, 0, room), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = []
    for d, t in ROWS:
        ids, start = np.array([*plain(t), 0], "<u4"), 0
        for k, stop in enumerate(range((len(ids) - 1) % room + 1, len(ids) + 1, room)):
            want.append((d, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            start = stop
    assert ordered(r[:5] for r in got) == ordered(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= room


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_pieces_and_is_near_the_bound(seed):
    r = np.random.default_rng(seed)
    room = int(r.integers(20, 300))
    counts = np.zeros(room + 1, np.int64)
    for size in r.integers(1, room + 1, r.integers(1, 80)):
        counts[size] += int(r.integers(1, 500))
    plan = packing.integral_plan(counts)
    held = Counter()
    for config, copies in plan:
        assert sum(s * k for s, k in config) <= room and copies > 0
        for s, k in config:
            held[s] += k * copies
    assert dict(held) == {s: int(n) for s, n in enumerate(counts) if n}
    fewest = sum(k for _, k in plan)
    plain_fit = sum(packing.best_fit(counts).values())
    assert fewest <= plain_fit * 1.02 + 2
    assert fewest >= -(-int((counts * np.arange(room + 1)).sum()) // room)


def test_best_fit_is_the_usual_one():
    r = np.random.default_rng(5)
    for _ in range(20):
        room = 50
        counts = np.zeros(room + 1, np.int64)
        counts[r.integers(1, room + 1, 10)] += r.integers(1, 9, 10)
        bins = []
        for size in range(room, 0, -1):
            for _ in range(counts[size]):
                fits = [b for b in bins if b[0] >= size]
                if fits:
                    min(fits)[0] -= size
                else:
                    bins.append([room - size])
        assert sum(packing.best_fit(counts).values()) == len(bins)


def test_line_breaks_and_marks_begin_no_new_words(plain):
    texts = ["one two.\nTwo", "two,\none two", "\none\n\nTwo\r\n!\n", "a \n two\t\none\n\n\nTwo \n", "\n", " \n\n", "one\n one!?\n\tTwo).", "two one"]
    cached, asked = tokens.CachedTokenizer(VOCABULARY), []
    encoded = cached._encoded
    cached._encoded = lambda new: asked.extend(new) or encoded(new)
    assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(texts)] == [plain(t) for t in texts]
    asked.clear()
    cached.encode([" one two one.\nTwo two,\none one! two"])
    assert not [w for w in asked if any(map(str.isalnum, w))]


def test_words_that_return_are_encoded_once():
    cached, asked = tokens.CachedTokenizer(VOCABULARY, kept=80), Counter()
    encoded = cached._encoded
    cached._encoded = lambda new: asked.update(new) or encoded(new)
    for i in range(50):  # ten new words in each text, and in every second one five that return
        cached.encode([" ".join(["", *["the", "of", "and", "to", "in"] * (i % 2), *(f"w{i}x{k}" for k in range(10))])])
    asked.pop("\0")
    assert max(asked.values()) == 1
    assert len(cached.known) + len(cached.before) <= 80 + 2 * 16

import hashlib
import random
from collections import Counter
from itertools import cycle

import public_tokenizers
from fixtures import ROWS, documents, ordered, prose, tuples

from trackgrid.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(60, "a "), (61, " "), (62, "  b  c \n d"), (63, "▁x"), (64, "aaaaaaaaaaaaa" * 9), (65, "<|endoftext|> <s> <0x41> x"), (66, "日本語 テキスト 🙂🙂 naïve x"), (67, "tab\tx \t y\r\n\r\n z  "), (68, "don't we'll 12345 $$$!!")]


def brute(rows):
    """Every text encoded whole, every pair of tokens compared by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    letters = align.byte_letters()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for d, text in rows:
        if not text:
            docs.append((d, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a, raw_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((d, None))
            continue
        ends = lambda raw: [sum(map(len, raw[: i + 1])) for i in range(len(raw))]
        span_a = [(e - len(r), e, i) for r, e, i in zip(raw_a, ends(raw_a), ids_a)]
        span_b = [(e - len(r), e, i) for r, e, i in zip(raw_b, ends(raw_b), ids_b)]
        links = [(x[2], y[2]) for x in span_a for y in span_b if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in span_a} & {y[1] for y in span_b})
        groups, lo = [], 0
        for c in common:
            side = lambda spans: ",".join(str(s[2]) for s in spans if lo < s[1] <= c)
            groups.append(f"{side(span_a)}|{side(span_b)}")
            lo = c
        counts.update(links)
        docs.append((d, (len(ids_a), len(ids_b), groups, links)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d, found in docs:
        if found is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        out.append((d, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, most


def small():
    return [(d, t if t is None else t[:1500]) for d, t in ROWS] + ODD + [(100 + i, prose(20, i)) for i in range(30)]


def test_documents_and_pairs_match_brute_force(spark, monkeypatch):
    rows = small()
    want, counts, most = brute(rows)
    found = align.Alignment(documents(spark, rows), A, B)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert ordered(tuples(found.documents(), *columns)) == ordered(want)
    assert set(tuples(found.pairs(), "a", "b", "count", "best")) == {(x, y, n, n == most[y]) for (x, y), n in counts.items()}


def test_forgetting_words_changes_nothing():
    rows = [t for _, t in small()]
    plain, forgetful = align.Aligner(A, B), align.Aligner(A, B, kept=50)
    for start in range(0, len(rows), 3):
        texts = rows[start : start + 3]
        for x, y in zip(plain.entries(texts), forgetful.entries(texts)):
            assert (x is None) == (y is None) and (x is None or [e[:5] for e in x] == [e[:5] for e in y])
            odd = lambda own, of: [of.names[k] for e in own or [] for k in memoryview(e[5]).cast("i")]
            assert odd(x, plain) == odd(y, forgetful)


def test_empty_table(spark):
    found = align.Alignment(documents(spark, []), A, B)
    assert found.documents().count() == 0 and found.pairs().count() == 0


def test_words_are_encoded_once_whatever_marks_follow():
    found, seen = align.Aligner(A, B), []

    class Watched:
        """B's tokenizer, which notes what it encodes."""

        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode(self, text, **how):
            seen.append(text)
            return self.real.encode(text, **how)

    found.b = Watched(found.b)
    words = [f"wörd{a}{b}" for a in "abcdefgh" for b in "xyzé"]
    assert None not in list(found.entries([" ".join(words)])) and seen
    seen.clear()
    again = [" ".join(w + m for w, m in zip(words, cycle([".", ",", "!!", "?)", ""]))), " ".join(reversed(words))]
    assert None not in list(found.entries(again)) and not seen


def test_a_full_cache_keeps_words_that_return():
    found, often, learnt = align.Aligner(A, B, kept=200), [f"often{c}" for c in "abcdefgh"], []
    learn = found._learn
    found._learn = lambda new: learnt.extend(new) or learn(new)
    for k in range(30):
        list(found.entries([" ".join(often + [f"rare{k}x{j}" for j in range(30)])]))
    assert all(learnt.count(w) == 1 for w in often) and len(found.known) + len(found.before) <= 200 + 2 * 38


def test_long_words_are_not_kept():
    found = align.Aligner(A, B)
    assert None not in list(found.entries(["x" * 1000 + ". y " + "ab" * 500])) and set(found.known) == {"y"}


def test_cuts_of_awkward_texts_match_whole_texts():
    bits = [" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\xa0", "\u3000", "\x1c", ".", ",", "!!", "...", "?!)", ";:.,", "'s", "don't", "word", "é", "ß", "日本", "🙂", "²", "½", "٣", "12", "3.5", "_", "__", ")", "<s>", "<0x41>", "&&&", "\u0300", "\u200b"]
    draw = random.Random(12)
    rows = [(i, "".join(draw.choices(bits, [30] + [2] * (len(bits) - 1), k=draw.randint(1, 14)))) for i in range(3000)]
    rows += [(4000, "nul\0 in it\nx."), (4001, "x ▁y."), (4002, "\n"), (4003, "\nx "), (4004, " "), (4005, None), (4006, "")]
    want, _, _ = brute(rows)
    found = align.Aligner(A, B, kept=300)
    for (i, n_a, n_b, n, *_, digest), own in zip(want, found.entries([t for _, t in rows])):
        if own is None:
            assert digest == "", i
        else:
            sums = [sum(c) for c in list(zip(*own))[:3]]
            assert sums == [n_a, n_b, n] and hashlib.sha256(";".join(e[3] for e in own).encode()).hexdigest() == digest, i

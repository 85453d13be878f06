"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

A byte-level BPE vocabulary splits a text into pieces before it merges bytes,
and no piece reaches across the start of a run of white space. So a text may
be cut there, and the ids of a text are those of its cuts in a row. Arrow cuts
many texts and finds their distinct cuts. Corpora repeat their words; a process
keeps the ids of those that it has met, and lets go of those not met for longest.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the code points that the vocabulary's pattern takes as white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_SET = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
_CUTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space before a space, or a space before a line break: such texts are cut by the pattern, others at their spaces and line breaks.
_RUNS = [*(c + " " for c in "\t\n\x0b\x0c\r "), " \n"]
_OTHER_SPACE = [c for c in sorted(_SPACE_SET) if not c.isascii()]
#: White space before a line break, which then begins no cut.
_BEFORE_BREAK = [c + "\n" for c in "\t\n\x0b\x0c\r"]
_BREAK = re.compile(r"(?<![\t-\r])\n")
#: Marks that no letter or digit before them is merged with.
_MARKS = ".,;:!?)"
_MARK_SET = frozenset(_MARKS)
#: Words that the pattern takes as one piece in any version of Unicode, and the letters that stand for their bytes and the space before.
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+").fullmatch
_BYTES = {b: chr(b + 162) if b < 161 else chr(323) if b == 173 else chr(b) for b in range(128, 256)} | {32: " \u0120"}
#: Distinct words that are kept at most, new ones that are encoded in a row, and letters of texts that are cut at once.
KEPT, TOGETHER, LETTERS = 600_000, 8192, 1 << 19


def spaced(text: str) -> str | None:
    """``text`` after a zero byte, whose cuts are what lies between its spaces; None if it must be cut by the pattern."""
    if "\0" in text or any(r[0] in text and r in text for r in _RUNS) or not text.isascii() and any(c in text for c in _OTHER_SPACE):
        return None
    if "\n" in text:
        text = _BREAK.sub(" \n", text) if any(r[0] in text and r in text for r in _BEFORE_BREAK) else text.replace("\n", " \n")
    return "\0" + text


def pattern_cuts(text: str) -> list[str]:
    """The cuts of a text by the pattern. None begins in a run of white space."""
    if "\0" in text:
        return ["\0" + text]
    return [c if c[0] == "\n" else c[1:] if c[0] == " " and c[1:2] != "\n" else "\0" + c for c in _CUTS.findall(text)]


def cuts_of(texts: list[str]) -> tuple[pa.ListArray, list[int]]:
    """The cuts of each text, and the places of the texts, in the order of the lists.

    A cut that begins with a space is without it, one that begins with a line break is as it is, another after a zero byte.
    """
    plain = list(map(spaced, texts))
    odd = [i for i, p in enumerate(plain) if p is None]
    lists = pc.split_pattern(pa.array([p for p in plain if p is not None], pa.large_string()), " ")
    if odd:
        lists = pa.concat_arrays([lists, pa.array([pattern_cuts(texts[i]) for i in odd], lists.type)])
    return lists, [i for i, p in enumerate(plain) if p is not None] + odd


class CachedTokenizer:
    """Encodes texts with the vocabulary in ``path``; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known, self.before = {}, {}  # words since half of ``kept`` were full, and those of the half before
        self.pieces = None  # the same model for pieces that are already told apart
        if self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a letter of a token stands for a byte
            self.bytes_of[i] = len(added[i].encode()) if i in added else len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens of the model. A few texts at a time, so that few cuts are in memory."""
        out, start, letters = [], 0, 0
        for stop, text in enumerate(texts, 1):
            letters += len(text)
            if letters >= LETTERS or stop == len(texts):
                out += self._some(texts[start:stop])
                start, letters = stop, 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        lists, places = cuts_of(texts)
        cuts = lists.flatten().dictionary_encode()
        ids = np.empty(len(cuts.dictionary), object)
        ids[:] = self._ids(cuts.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        which, stops, out, start = cuts.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy()).tolist(), [b""] * len(texts), 0
        for place, stop in zip(places, stops):
            out[place] = b"".join(ids[which[start:stop]].tolist())
            start = stop
        return out

    def _ids(self, cuts: list[str]) -> list[bytes]:
        """The ids of different cuts; one that ends with marks is the word before them, which is kept, and the marks."""
        words, marks = list(cuts), {}
        for i, c in enumerate(cuts):
            if c[-1:] in _MARK_SET and (b := c.rstrip(_MARKS)) and b[-1].isalnum():
                words[i], marks[i] = b, "\0" + c[len(b) :]
        if len(self.known) > self.kept // 2:  # words that were met since stay, those met only before go with the next half
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        again = {w: v for w in {words[i] for i in gaps} if (v := self.before.get(w)) is not None}
        self.known |= again | self._encoded({words[i] for i in gaps}.difference(again))
        for i in gaps:
            found[i] = self.known[words[i]]
        ends = self._encoded(set(marks.values()))
        for i, m in marks.items():
            found[i] += ends[m]
        return found

    def _encoded(self, new: set[str]) -> dict[str, bytes]:
        latin, joined, alone, out = [], [], [], {}
        for c in new:
            if self.pieces and _LATIN(c):
                latin.append(c)
            else:
                (joined if c and c[0] not in "\0\n" and c[-1] not in _SPACE_SET else alone).append(c)
        for words in (latin, joined):
            for start in range(0, len(words), TOGETHER):
                block = words[start : start + TOGETHER]
                text, encoder = " " + " ".join(block), self.tokenizer
                if words is latin:
                    text, encoder = text.encode().decode("latin-1").translate(_BYTES), self.pieces
                ids = np.array(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.cumsum(self.bytes_of[ids])
                wanted = np.cumsum([len(c.encode()) + 1 for c in block])
                at = np.searchsorted(ends, wanted)
                if at[-1] >= len(ends) or not np.array_equal(ends[at], wanted):  # a vocabulary that merges across words
                    alone += block
                    continue
                raw, stops = ids.tobytes(), ((at + 1) * 4).tolist()
                out.update(zip(block, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        for start in range(0, len(alone), TOGETHER):
            block = alone[start : start + TOGETHER]
            texts = [c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c for c in block]
            for c, e in zip(block, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                out[c] = np.array(e.ids, "<u4").tobytes()
        return out


_OPEN: dict[str, CachedTokenizer] = {}


def release() -> None:
    """Let go of words that the process has kept, before it works for another operator."""
    _OPEN.clear()


def tokenizer(path: str) -> CachedTokenizer:
    """The process's tokenizer for ``path``: workers serve many tasks, and keep what they have learnt."""
    if path not in _OPEN:
        _OPEN[path] = CachedTokenizer(path)
    return _OPEN[path]

"""Alignment of two tokenizers over a corpus: which ids of one cover the same bytes as which of the other.

Both tokenizers encode a space and the text. Byte offsets where tokens of both
end cut them into groups, and tokens of a group whose bytes overlap are linked.
An identity map tells for each id of A the id of B with the same bytes. Groups
of such a pair alone are counted in vectors as long as A's vocabulary and never
shuffled. The other, irregular groups are counted by name in a shuffle, and
only what those names link adds to the pair counts there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, lookup, prepare, written
from .tokens import _BYTES, _LATIN, _MARK_SET, _MARKS, _SPACE, _SPACE_SET, release, spaced

#: Both tokenizers may be cut before a space or line break that follows something else, if no token of B has such a place.
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[ \n])")
_ACROSS_CUT = re.compile(f"[^{_SPACE}][ \n]").search
#: Letters and digits in any version of Unicode; A is cut between them and marks, and B if it has no token of both.
_PLAIN = "0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN_SET = frozenset(c for c in map(chr, range(0x250)) if re.match(f"[{_PLAIN}]", c))
_ACROSS_MARKS = re.compile(f"[{_PLAIN}][{re.escape(_MARKS)}]").search
#: Cuts that a process keeps at most, letters of the longest that it keeps, new ones that are encoded in a row, and letters of texts that are cut at once.
KEPT, LONGEST, TOGETHER, LETTERS = 300_000, 64, 8192, 1 << 20
#: Marks at the end of a word that are told apart from it, at most.
ENDS = 3
#: A name with at least this share of all rows is hot: there are at most as many as its inverse.
HOT_SHARE = 1 / 4096


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes texts with both vocabularies and groups their tokens; keeps what it has learnt of words."""

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.kept = Tokenizer.from_file(path_a), kept
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a: list[bytes] = [b""] * (1 + max(self.a.get_vocab(with_added_tokens=True).values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b, self.cuttable, marked = [], True, False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.bytes_b.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.bytes_b.append(piece.encode())
                self.cuttable &= not _ACROSS_CUT(piece)
                marked |= bool(_ACROSS_MARKS(piece))
        self.pieces = None  # A's model for words that are one piece of its pattern
        if self.a.normalizer is None and isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.pre_tokenizer.use_regex:
            self.pieces = Tokenizer(self.a.model)
            self.pieces.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.marks = [] if marked or not self.pieces else ["".join(m) for n in range(1, ENDS + 1) for m in product(_MARKS, repeat=n)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # Pieces come after byte tokens, so that they are preferred.
        of = {w: i for byte in (True, False) for i, w in enumerate(self.bytes_b) if w and self.b.is_byte(i) == byte}
        self.identity = np.array([of.get(w, -1) if w else -1 for w in self.bytes_a], np.int64)
        self.identity_names = np.array([f"{i}|{b}" for i, b in enumerate(self.identity.tolist())], object)
        self.decimal = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.forget()

    def forget(self) -> None:
        self.known, self.before = {}, {}  # cuts since half of ``kept`` were full, and those of the half before
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        #: Marks at the end of a word; they are learnt after one, since B puts a space before a text.
        self.ends = dict(zip(self.marks, (self._block([x for m in self.marks for x in (" a", m)]) or [])[1::2]))

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple] | None]:
        """What is known of each cut of each text; None for a text without tokens. A few texts at a time, so that few cuts are in memory."""
        if len(self.names) > self.kept:  # not while a batch is worked on, whose numbers of names are in use
            self.forget()
        start, letters = 0, 0
        for stop, text in enumerate(texts, 1):
            letters += len(text or "")
            if letters >= LETTERS or stop == len(texts):
                yield from self._some(texts[start:stop])
                start, letters = stop, 0

    def _some(self, texts: list[str | None]) -> list[list[tuple] | None]:
        out: list[list[tuple] | None] = [None] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        plain = {i: s for i in full if self.cuttable and (s := spaced(" " + texts[i])) is not None}
        odd = {i: self._pattern_cuts(texts[i]) for i in full if i not in plain}
        # A cut that begins with a space is without it, one that begins with a line break is as it is, another after a zero byte.
        # Each text begins with a space.
        lists = pc.split_pattern(pa.array([s[2:] for s in plain.values()], pa.large_string()), " ")
        lists = pa.concat_arrays([lists, pa.array(odd.values(), lists.type)])
        cuts = lists.flatten().dictionary_encode()
        found = np.empty(len(cuts.dictionary), object)
        found[:] = self._entries(cuts.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        which, stops, start = cuts.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy()).tolist(), 0
        for i, stop in zip(chain(plain, odd), stops):
            own = found[which[start:stop]].tolist()
            out[i] = None if () in own else own
            start = stop
        return out

    def _pattern_cuts(self, text: str) -> list[str]:
        """The cuts of a text that its spaces and line breaks alone do not tell."""
        if "\0" in text or not self.cuttable:
            return ["\0 " + text]
        return [c if c[0] == "\n" else c[1:] if c[1:2] != "\n" else "\0" + c for c in _CUT.split(" " + text)]

    def _entries(self, cuts: list[str]) -> list[tuple]:
        """What is known of different cuts, () if nothing; one that ends with marks is the word before them, which is kept, and the marks."""
        words, ends = list(cuts), {}
        for i, c in enumerate(cuts):
            if c[-1:] in _MARK_SET and (b := c.rstrip(_MARKS)) and b[-1] in _PLAIN_SET and (e := self.ends.get(c[len(b) :])):
                words[i], ends[i] = b, e
        if len(self.known) > self.kept // 2:  # words that were met since stay, those met only before go with the next half
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        again = {w: v for w in {words[i] for i in gaps} if (v := self.before.get(w)) is not None}
        learnt = again | self._learn({words[i] for i in gaps}.difference(again))
        self.known.update((w, v) for w, v in learnt.items() if len(w) <= LONGEST)
        for i in gaps:
            found[i] = learnt[words[i]]
        for i, (n_a, n_b, n, text, regular, irregular) in ends.items():
            if v := found[i]:
                found[i] = v[0] + n_a, v[1] + n_b, v[2] + n, f"{v[3]};{text}", v[4] + regular, v[5] + irregular
        return found

    def _learn(self, new: set[str]) -> dict[str, tuple]:
        latin, joined, breaks, others, out = [], [], [], [], {}
        for c in new:
            if self.pieces and _LATIN(c):
                latin.append(c)
            elif c and c[0] != "\0" and c[-1] not in _SPACE_SET:
                (breaks if c[0] == "\n" else joined).append(c)
            else:
                others.append(c)
        for words in (latin, joined, breaks):
            for start in range(0, len(words), TOGETHER):
                block = words[start : start + TOGETHER]
                out.update(zip(block, self._each(block if words is breaks else [" " + c for c in block], words is latin)))
        for c in others:  # not followed by others, since white space at the end may go on
            out[c] = self._each([c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c])[0]
        return out

    def _each(self, block: list[str], latin: bool = False) -> list[tuple]:
        """What there is to know of parts; () for those whose bytes or ends differ from the text's, found by halving."""
        if block[0][:1] == " ":
            found = self._block(block, latin)
        else:  # in the midst of a text, after a word
            found = self._block([" a", *block])
            found = found and found[1:]
        if found is None:
            half = len(block) // 2
            found = self._each(block[:half], latin) + self._each(block[half:], latin) if half else [()]
        return found

    def _block(self, block: list[str], latin: bool = False) -> list[tuple] | None:
        """What there is to know of parts that follow each other; None if their bytes or their ends differ from the text's."""
        text = "".join(block)
        raw, encoder, coded = text.encode(), self.a, text
        if latin:
            encoder, coded = self.pieces, raw.decode("latin-1").translate(_BYTES)
        list_a = encoder.encode_batch_fast([coded], add_special_tokens=False)[0].ids
        # The library drops the space it adds if there is nothing else.
        list_b = self.b.encode(text[1:], num_threads=1) if text != " " else [self.b.piece_to_id("▁")]
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != raw or b"".join(map(self.bytes_b.__getitem__, list_b)) != raw:
            return None
        ids_a, ids_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        marks = np.zeros(len(raw) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        both = np.flatnonzero(marks == 3)
        stops = np.cumsum(pc.binary_length(pa.array(block, pa.large_string())).to_numpy())
        last = np.searchsorted(both, stops)
        if not np.array_equal(both[last], stops):
            return None
        upto_a, upto_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        from_a, from_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        same = (upto_a - from_a == 1) & (upto_b - from_b == 1)
        same &= self.identity[ids_a[upto_a - 1]] == ids_b[upto_b - 1]
        # Plain lists and slices of bytes from here on: parts have few tokens each.
        names, odd, numbers = self.identity_names[ids_a[upto_a - 1]].tolist(), np.flatnonzero(~same), []
        decimal_a, decimal_b = self.decimal[ids_a].tolist(), self.decimal[ids_b].tolist()
        for k, i, x, j, y in zip(*(c.tolist() for c in (odd, from_a[odd], upto_a[odd], from_b[odd], upto_b[odd]))):
            names[k] = name = f"{','.join(decimal_a[i:x])}|{','.join(decimal_b[j:y])}"
            if (number := self.number.get(name)) is None:
                number = self.number[name] = len(self.names)
                self.names.append(name)
            numbers.append(number)
        regular, irregular = ids_a[upto_a[same] - 1].astype("<i4").tobytes(), np.array(numbers, "<i4").tobytes()
        so_far = 4 * np.cumsum(same)[last]
        columns = upto_a[last], upto_b[last], last + 1, so_far, 4 * (last + 1) - so_far
        out, i, j, at, r, o = [], 0, 0, 0, 0, 0
        for x, y, stop, done, others in zip(*(c.tolist() for c in columns)):
            out.append((x - i, y - j, stop - at, ";".join(names[at:stop]), regular[r:done], irregular[o:others]))
            i, j, at, r, o = x, y, stop, done, others
        return out

    def links(self, name: str) -> list[int]:
        """Linked pairs of a group, each as the id of A, 32 bits up, and the id of B."""
        a, b = ([*map(int, side.split(","))] for side in name.split("|"))
        out, i, j = [], 0, 0
        end_a, end_b = self.length_a[a[0]], self.length_b[b[0]]
        while True:
            out.append(a[i] << 32 | b[j])
            if end_a == end_b:  # the groups' common ends are their last
                return out
            if end_a < end_b:
                i += 1
                end_a += self.length_a[a[i]]
            else:
                j += 1
                end_b += self.length_b[b[j]]


_OPEN: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The process's aligner: workers serve many tasks, and keep what they have learnt."""
    if (path_a, path_b) not in _OPEN:
        release()
        _OPEN[path_a, path_b] = Aligner(path_a, path_b)
    return _OPEN[path_a, path_b]


def encode(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``row, id, n_a, n_b, n_groups, groups`` (digest), ids of A in identity groups, names and times of irregular ones."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        both = aligner(path_a, path_b)
        for batch in batches:
            sizes, digests, regular, odd = [], [], [], []
            for own in both.entries(batch.column(2).to_pylist()):
                if own is None:
                    sizes.append((0, 0, 0))
                    digests.append("")
                    regular.append(b"")
                    odd.append(b"")
                    continue
                n_a, n_b, n, text, ids, irregular = zip(*own)
                sizes.append((sum(n_a), sum(n_b), sum(n)))
                digests.append(hashlib.sha256(";".join(text).encode()).hexdigest())
                regular.append(b"".join(ids))
                odd.append(b"".join(irregular))
            numbers = np.frombuffer(b"".join(odd), "<i4").astype(np.int64)
            owner = np.repeat(np.arange(len(odd)), np.fromiter((len(o) >> 2 for o in odd), np.int64, len(odd)))
            code, times = np.unique(owner << 32 | numbers, return_counts=True)
            used, at = np.unique(code & 0xFFFFFFFF, return_inverse=True)
            names = pa.array([both.names[k] for k in used.tolist()], pa.string()).take(pa.array(at))
            offsets = pa.array(np.searchsorted(code >> 32, np.arange(len(odd) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*sizes)), pa.array(digests, pa.string()), pa.array(regular, pa.binary()),
                 pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                names=["row", "id", "n_a", "n_b", "n_groups", "groups", "regular", "names", "times"],
            )

    return named.mapInArrow(run, "row long, id long, n_a long, n_b long, n_groups long, groups string, regular binary, names array<string>, times array<long>")


class Alignment:
    """Links of the ids of two vocabularies over all texts of ``docs``.

    ``path_a`` is a byte-level vocabulary of ``tokenizers``, ``path_b`` a model of ``sentencepiece``. A null or empty text,
    and one whose bytes either tokenizer changes, has no tokens. Rows are independent: equal ids and repeated texts count one by
    one. Only the two named columns are read. Texts are taken whole, whatever their length. No rows give no rows.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = prepare(docs.sparkSession)
        self.paths = path_a, path_b
        self.encoded = written(encode(docs, path_a, path_b, id_col, text_col), "aligned")
        odd = self.encoded.select("row", F.arrays_zip("names", "times").alias("g")).select("row", F.explode("g").alias("g"))
        #: Irregular groups of each row.
        self.odd = odd.select("row", F.col("g.names").alias("name"), F.col("g.times").alias("n"))
        self.groups = written(self.odd.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "groups")
        self.regular = self._regular()
        self.linked = self._linked()
        #: One row per linked pair: ``code`` (the id of A, 32 bits up, and the id of B) and ``count``.
        self.counts = written(self._counts(), "pairs")

    def _regular(self) -> DataFrame:
        """How often each identity pair is a group of its own, from one vector per task."""
        paths = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            identity = aligner(*paths).identity
            counts = np.zeros(len(identity), np.int64)
            for batch in batches:
                ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
                counts += np.bincount(ids, minlength=len(identity))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used << 32 | identity[used]), pa.array(counts[used])], names=["code", "n"])

        return self.encoded.select("regular").mapInArrow(run, "code long, n long")

    def _linked(self) -> DataFrame:
        """``name, n, code``: the pairs that each irregular group links, one row per link."""
        paths = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = aligner(*paths)
            for batch in batches:
                pairs = [both.links(name) for name in batch.column(0).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(pairs)), np.fromiter(map(len, pairs), np.int64, len(pairs))))
                for start in range(0, len(at), 100_000):
                    some = at.slice(start, 100_000)
                    if start == 0:
                        codes = pa.array(np.fromiter(chain.from_iterable(pairs), np.int64, len(at)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), codes.slice(start, 100_000)], names=["name", "n", "code"])

        return self.groups.select("name", "n").mapInArrow(run, "name string, n long, code long")

    def _counts(self) -> DataFrame:
        pairs = self.linked.groupBy("code").agg(F.sum("n").alias("n")).unionByName(self.regular)
        return pairs.groupBy("code").agg(F.sum("n").alias("count"))

    def pairs(self) -> DataFrame:
        """``a, b, count, best`` of every linked pair; best has the highest count of its id of B, ties included."""
        b = F.col("code").bitwiseAND(0xFFFFFFFF)
        top = self.counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
        # One row per id of B: the vocabulary bounds it.
        with_top = self.counts.withColumn("b", b).join(F.broadcast(top), "b")
        return with_top.select("code", F.shiftright("code", 32).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """Per row: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``."""
        pairs = written(self.pairs().select("code", "count", "best"), "pairs")
        of_names = lookup(self.linked.select("name", "code"), pairs, ["code"])
        values = of_names.groupBy("name").agg(F.sum("count").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"))
        values = written(values, "names")
        # Names of many rows are broadcast, since there are few; the other names have few rows each.
        total = self.groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        hot = self.groups.where(F.col("rows") >= max(2.0, HOT_SHARE * total)).select("name")
        hot = written(values.join(F.broadcast(hot), "name", "left_semi"), "hot-names")
        sums = lambda df: df.groupBy("row").agg(F.sum(F.col("n") * F.col("count_sum")).alias("count_sum"), F.sum(F.col("n") * F.col("n_best")).alias("n_best"))
        often = sums(self.odd.join(F.broadcast(hot), "name"))
        cold = self.odd.join(F.broadcast(hot.select("name")), "name", "left_anti")
        seldom = sums(cold.join(values.hint("merge"), "name"))
        regular = self._regular_sums(pairs)
        each = often.unionByName(seldom).unionByName(regular.select("row", "count_sum", "n_best")).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        docs = self.encoded.select("row", "id", "n_a", "n_b", "n_groups", "groups").join(each, "row", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")  # a group is a staircase of links
        return docs.select("id", "n_a", "n_b", "n_groups", links, zero("n_best"), zero("count_sum"), "groups")

    def _regular_sums(self, pairs: DataFrame) -> DataFrame:
        """Per row, what its identity groups add, by vectors as long as A's vocabulary."""
        paths = self.paths
        own = self.regular.select("code").distinct()
        found = collected(pairs.join(F.broadcast(own), "code").select(F.shiftright("code", 32).alias("a"), "count", F.col("best").cast("int").alias("best")))
        size = int(found["a"].max()) + 1 if len(found["a"]) else 1
        counts, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        counts[found["a"]], best[found["a"]] = found["count"], found["best"]
        shared = self.spark.sparkContext.broadcast((counts, best))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(1).to_pylist()
                ids = np.frombuffer(b"".join(raw), "<i4")
                stops = np.cumsum([0, *(len(r) >> 2 for r in raw)])
                out = []
                for vector in shared.value:
                    sums = np.concatenate([[0], np.cumsum(vector[ids])])
                    out.append(pa.array(sums[stops[1:]] - sums[stops[:-1]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["row", "count_sum", "n_best"])

        return self.encoded.select("row", "regular").mapInArrow(run, "row long, count_sum long, n_best long")

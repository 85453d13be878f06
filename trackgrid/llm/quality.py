"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is over characters as they are, any script and both cases, in grams of
five. Its count tables grow with the text. Documents go to blocks by their id;
each block sends its distinct grams once, with their trusted counts, to buckets
by the two characters before the last. All orders from five to three of a gram,
and their contexts, are in one bucket, which derives the lower orders' counts
from the grams, joins the counts, and sends each block the probabilities of its
grams. So no table passes the driver, and a gram in every document is one row
per block.

Texts are in one of two folds by their hash, so that equal texts share one, and
are scored by the model of the other: no document is judged by a model that has
seen it, and thresholds come from held-out scores. A document is accepted if its
perplexity is not above, and the variety of its grams not below, quantiles of
the trusted documents of its language and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import bucket_slices, pack, pack_rising, unpack, unpack_rising
from .arrays import rows as batch_of
from .common import discard, lookup, prepare, text_or_empty, written
from .tokens import release

ORDER = 5
#: Code points take 21 bits; a text begins after line feeds.
POINT, START = 21, 10
#: Characters of a block, of a bucket's text, and of what is worked on at once.
BLOCK_CHARS, BUCKET_CHARS, AT_ONCE = 1 << 24, 1 << 25, 1 << 21
#: Quantiles of trusted documents, and how far thresholds lie beyond them as a factor of their distance from the median.
PERPLEXITY, VARIETY = (0.97, 1.3), (0.01, 1.5)
#: Scores are put in bins of this width to find quantiles.
BIN = 0.002
#: Trusted documents of a language and length, or of a language, that thresholds of its own take; fewer take those of the language, or of all.
FEWEST_OF_LENGTH, FEWEST = 40, 50
#: Where lengths share a threshold, a text of n characters may exceed it by SHORT / sqrt(n): means of few characters vary more.
SHORT = 3.0


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``AT_ONCE`` characters; a longer one is alone."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > AT_ONCE:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of ``code``, the place of each element's among them, and where each occurs first."""
    at, values = pd.factorize(code)  # by a hash table: values are few
    first = np.empty(len(values), np.int64)
    first[at[::-1]] = np.arange(len(code) - 1, -1, -1)
    return values, at, first


def characters_of(texts: list[str]) -> np.ndarray:
    seen = np.zeros(0x110000, bool)
    for s in _slices(texts):
        seen[points_of(texts[s])] = True
    return np.flatnonzero(seen)


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


class Coder:
    """Numbers for the grams of a block: exact for up to 4,096 characters, else 64-bit hashes."""

    def __init__(self, alphabet: np.ndarray):
        self.alphabet = np.union1d(alphabet, [START]).astype(np.int64)
        self.rank = np.zeros(int(self.alphabet[-1]) + 1, np.uint64)
        self.rank[self.alphabet] = np.arange(len(self.alphabet))
        bits = max(1, (len(self.alphabet) - 1).bit_length())
        self.factor = np.uint64(1 << bits if ORDER * bits <= 64 else 0x9E3779B97F4A7C15)

    def of_characters(self, columns: list[np.ndarray]) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            code = code * self.factor + self.rank[c]
        return code

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[np.ndarray]]]:
        """The number of each gram, how many grams each text has, and the characters of chosen grams."""
        points = points_of(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pad = ORDER - 1
        s = np.full(len(points) + pad * len(texts), START, np.int64)
        at = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1) * pad, sizes)
        s[at] = points
        rank, n = self.rank[s], len(s)
        code = np.zeros(max(0, n - pad), np.uint64)
        for k in range(ORDER):
            code = code * self.factor + rank[k : n - pad + k]
        return code[at - pad], sizes, lambda some: [s[at[some] - back] for back in range(pad, -1, -1)]


def joined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first two characters of grams, and the last three, as numbers."""
    c = [x.astype(np.uint64) for x in columns]
    p = np.uint64(POINT)
    return c[0] << p | c[1], (c[2] << p | c[3]) << p | c[4]


def split(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    p, mask = np.uint64(POINT), np.uint64((1 << POINT) - 1)
    return [x.astype(np.int64) for x in (hi >> p, hi & mask, lo >> (p + p), lo >> p & mask, lo & mask)]


def bucket_of(lo: np.ndarray, parts: int) -> np.ndarray:
    """Buckets by the two characters before the last."""
    context = lo >> np.uint64(POINT)
    mixed = (context ^ context >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# Documents in blocks --------------------------------------------------------

PACKED = "block long, id long, g1 long, g2 long, lang string, fold long, text binary"


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents with their block, fold and content hash, texts compressed for the shuffle."""
    g1 = F.xxhash64("lang", "text")
    place = F.pmod(F.coalesce(F.when(F.col("id").isNotNull(), F.xxhash64("id")), g1), F.lit(blocks))
    named = docs.select(place.alias("block"), "id", g1.alias("g1"), F.xxhash64(F.lit(1), "lang", "text").alias("g2"), "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            texts = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(texts, pa.binary())], names=batch.schema.names)

    return named.mapInArrow(run, PACKED)


def _texts(column: pa.ChunkedArray) -> list[str]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(t).decode("utf-8", "surrogatepass") for t in column.to_pylist()]


# Counts ---------------------------------------------------------------------

#: A block's distinct grams in a bucket, and their trusted counts in both folds; bucket -1 has its trusted characters.
GRAMS = "bucket int, block long, lo binary, hi binary, a binary, b binary"


def _count(parts: int):
    def run(docs: pa.Table, labels: pa.Table) -> pa.Table:
        good = set(labels.column("good_id").to_pylist())
        texts, folds = _texts(docs.column("text")), docs.column("fold").to_pylist()
        groups: list[list[str]] = [[], [], []]  # trusted in either fold, others
        for i, fold, t in zip(docs.column("id").to_pylist(), folds, texts):
            groups[fold if i in good else 2].append(t)
        block = docs.column("block")[0].as_py()
        alphabets = [characters_of(g) for g in groups]
        coder = Coder(np.concatenate(alphabets))
        codes, columns, counts, group = [], [], [], []
        for k, g in enumerate(groups):
            for s in _slices(g):
                code, _, characters = coder.of_texts(g[s])
                found, at, first = distinct(code)
                codes.append(found)
                columns.append(np.stack(characters(first)))
                counts.append(np.bincount(at, minlength=len(found)))
                group.append(np.full(len(found), k))
        out = [(-1, block, pack(np.union1d(*alphabets[:2]).astype("<u4")), b"", b"", b"")]
        if codes:
            code, at, first = distinct(np.concatenate(codes))
            hi, lo = joined(list(np.concatenate(columns, 1)[:, first]))
            counts, group = np.concatenate(counts), np.concatenate(group)
            a, b = (np.bincount(at[group == k], counts[group == k], len(code)).astype("<u4") for k in (0, 1))
            bucket = bucket_of(lo, parts)
            order = np.lexsort((hi, lo, bucket))
            for k, s in bucket_slices(bucket[order], parts):
                some = order[s]
                out.append((k, block, pack_rising(lo[some]), pack(hi[some]), pack(a[some]), pack(b[some])))
        return pa.Table.from_batches([batch_of(GRAMS, out)])

    return run


# Probabilities --------------------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from grams seen not at all, once, twice and more often, by how many are seen one to four times."""
    n = [0.0, *(float((counts == k).sum()) for k in range(1, 5))]
    if not n[1] or not n[2]:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.75 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))])


def _level(counts: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of one order from counts, the group of each gram's context, and the order below."""
    off = discounts(counts)[np.minimum(counts, 3)]
    total, lost = np.bincount(context, counts), np.bincount(context, off)
    total, lost = total[context], lost[context]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (counts - off) / total + lost / total * lower, lower)


def kneser_ney(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, base: float) -> np.ndarray:
    """The probability of each distinct gram of a bucket, from the counts of all; ``base`` is that of any character."""
    groups = lambda x: np.unique(x, return_inverse=True)[1]
    p, mask = np.uint64(POINT), np.uint64((1 << POINT) - 1)
    before = groups(lo >> p).astype(np.uint64)  # contexts of order three; their numbers and the first characters fit 64 bits
    last = groups(lo).astype(np.uint64)
    _, first_4, four = np.unique(last << p | hi & mask, return_index=True, return_inverse=True)
    _, first_3, three = np.unique(last[first_4], return_index=True, return_inverse=True)
    counts_4 = np.bincount(four, counts > 0).astype(np.int64)  # different characters before
    counts_3 = np.bincount(three, counts_4 > 0).astype(np.int64)
    p_3 = _level(counts_3, groups(before[first_4][first_3]), np.full(len(first_3), base))
    p_4 = _level(counts_4, groups(before[first_4] << p | hi[first_4] & mask), p_3[three])
    return _level(counts, groups(before << (p + p) | hi), p_4[four])


#: To a block: its grams and their log probabilities in the models of both folds (kind 0), or its trusted ids (kind 1).
ANSWERS = "kind int, bucket int, block long, lo binary, hi binary, a binary, b binary, good_id long"


def _probabilities(base: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lo = [unpack_rising(r["lo"], "<u8") for r in rows]
        hi = [unpack(r["hi"], "<u8") for r in rows]
        every_lo, every_hi = np.concatenate(lo), np.concatenate(hi)
        order = np.lexsort((every_hi, every_lo))
        new = np.r_[True, (np.diff(every_lo[order]) != 0) | (np.diff(every_hi[order]) != 0)]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        own_lo, own_hi = every_lo[order][new], every_hi[order][new]
        logs = []
        for fold in ("a", "b"):
            counts = np.bincount(at, np.concatenate([unpack(r[fold], "<u4") for r in rows])).astype(np.int64)
            logs.append(np.log(kneser_ney(own_hi, own_lo, counts, base)).astype("<f4"))
        out, start = [], 0
        for r, x in zip(rows, lo):
            some = at[start : start + len(x)]
            out.append((0, r["bucket"], r["block"], r["lo"], r["hi"], pack(logs[0][some]), pack(logs[1][some]), None))
            start += len(x)
        return pa.Table.from_batches([batch_of(ANSWERS, out)])

    return run


# Scores ---------------------------------------------------------------------

SCORES = "id long, g1 long, g2 long, lang string, n_chars long, trusted boolean, log_perplexity double, n_distinct long"


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    rows = [r for r in answers.to_pylist() if r["kind"] == 0]
    good = set(answers.column("good_id").to_pylist()) - {None}
    texts = _texts(docs.column("text"))
    n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
    sums, n_distinct = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if rows:
        columns = split(np.concatenate([unpack(r["hi"], "<u8") for r in rows]), np.concatenate([unpack_rising(r["lo"], "<u8") for r in rows]))
        coder = Coder(np.unique(columns[-1]))
        codes = coder.of_characters(columns)
        order = np.argsort(codes)
        codes = codes[order]
        folds = np.array(docs.column("fold").to_pylist())
        for fold, name in ((0, "b"), (1, "a")):  # the model of the other fold
            logs = np.concatenate([unpack(r[name], "<f4") for r in rows])[order].astype(float)
            own = np.flatnonzero(folds == fold)
            mine = [texts[k] for k in own.tolist()]
            for s in _slices(mine):
                code, sizes, _ = coder.of_texts(mine[s])
                found, at, _ = distinct(code)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums[own[s]] = np.bincount(owner, logs[np.searchsorted(codes, found)][at], len(sizes))
                each = np.sort(owner << 32 | at)
                new = np.r_[True, each[1:] != each[:-1]] if len(each) else np.zeros(0, bool)
                n_distinct[own[s]] = np.bincount(each[new] >> 32, minlength=len(sizes))
    with np.errstate(invalid="ignore"):
        mean = -sums / np.where(n_chars, n_chars, np.nan)
    trusted = [i in good for i in docs.column("id").to_pylist()]
    return pa.Table.from_arrays(
        [docs.column(c).combine_chunks() for c in ("id", "g1", "g2", "lang")] + [pa.array(n_chars), pa.array(trusted, pa.bool_()), pa.array(mean, from_pandas=True), pa.array(n_distinct)],
        names=[f.split()[0] for f in SCORES.split(", ")],
    )


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of the rows of ``docs`` (``id, lang, text``), each by the model of the trusted texts of the other fold; written.

    ``labels`` has the trusted ids, once each, as ``good_id``. ``log_perplexity`` is the mean negative log probability of
    a character, null for an empty text; ``n_distinct`` counts different grams.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // BUCKET_CHARS))
    packed = _packed(docs, blocks)
    good = labels.where("good_id is not null").select(F.pmod(F.xxhash64(F.col("good_id").cast("long")), F.lit(blocks)).alias("block"), F.col("good_id").cast("long").alias("good_id"))
    grams = written(packed.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_skip_labels(_count(parts), GRAMS), GRAMS), "quality-grams")
    docs.sparkSession.sparkContext._jvm.System.gc()  # shuffled texts can go
    base = 1.0 / (1 + _distinct_characters(grams))
    answers = written(grams.where("bucket >= 0").groupBy("bucket").applyInArrow(_probabilities(base), ANSWERS), "quality-answers")
    discard(grams)
    empty = [F.lit(None).cast("binary").alias(c) for c in ("lo", "hi", "a", "b")]
    both = answers.unionByName(good.select(F.lit(1).alias("kind"), F.lit(-1).alias("bucket"), "block", *empty, "good_id"))
    scores = written(packed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_skip_labels(_score, SCORES), SCORES), "quality-scores")
    discard(answers)
    return scores


def _skip_labels(run, schema: str):
    """``run`` for blocks with documents; labels alone have no result."""

    def some(docs: pa.Table, other: pa.Table) -> pa.Table:
        if docs.num_rows:
            return run(docs, other)
        return pa.Table.from_batches([batch_of(schema, [])])

    return some


def _distinct_characters(grams: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(raw, "<u4").astype(np.int64))], names=["c"])

    return grams.where("bucket = -1").select("lo").mapInArrow(run, "c long").distinct().count()


# Thresholds -----------------------------------------------------------------


def measures(scores: DataFrame) -> DataFrame:
    """``scores`` with ``length`` (the binary logarithm, rounded down) and ``variety``: the exponent of different grams to grams."""
    variety = F.log(F.col("n_distinct") + 1) / F.log(F.col("n_chars") + 1)
    return scores.withColumn("length", F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")).withColumn("variety", F.when(F.col("n_chars") > 0, variety))


def thresholds(trusted: DataFrame) -> DataFrame:
    """``level, lang, length, most, least`` from ``lang, length, log_perplexity, variety`` of trusted documents.

    Level 2 is per language and length, 1 per language, 0 over all, each where there are enough documents. Quantiles
    are exact up to the width of a bin.
    """
    known = trusted.where("log_perplexity is not null")
    none_s, none_i = F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("length")
    levels = [known.select(F.lit(k).alias("level"), *cols, "log_perplexity", "variety") for k, cols in ((2, ["lang", "length"]), (1, ["lang", none_i]), (0, [none_s, none_i]))]
    keys = ["level", "lang", "length"]
    limits = None
    for name, limited, (tail, wider), bin_up in (("log_perplexity", "most", PERPLEXITY, BIN), ("variety", "least", VARIETY, -BIN)):
        binned = [df.select(*keys, F.round(F.col(name) / BIN).cast("long").alias("bin")) for df in levels]
        # One row per group and bin: both measures have few bins.
        counted = binned[0].unionByName(binned[1]).unionByName(binned[2]).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
        w = Window.partitionBy(*keys)
        running = counted.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
        quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) * BIN
        middle = running.groupBy(*keys).agg(quantile(0.5).alias("middle"), quantile(tail).alias("tail"), F.max("total").alias(f"n_{name}"))
        limit = F.col("middle") + wider * (F.col("tail") - F.col("middle")) + bin_up
        one = middle.select(*keys, limit.alias(limited), f"n_{name}")
        limits = one if limits is None else lookup(limits, one, keys)
    enough = F.element_at(F.array(F.lit(1), F.lit(FEWEST), F.lit(FEWEST_OF_LENGTH)), F.col("level") + 1)
    return limits.where(F.col("n_log_perplexity") >= enough).select(*keys, "most", "least")


class Classifier:
    """Scores and thresholds of ``docs`` under ``labels``.

    Trusted are documents with a label of quality 1 that is not toxic; all of them are counted, and all
    give thresholds. Labels without an id match nothing, and repeated labels count once. Without
    trusted text there are no thresholds, and every document with any text is kept. Texts are taken whole, whatever
    their length; memory of a task grows with the longest text. Repeated texts have equal verdicts. Other columns of
    ``docs`` are not looked at.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
        self.spark = prepare(spark)
        self.id_col, self.text_col, self.lang_col = id_col, text_col, lang_col
        good = labels.groupBy(F.col("doc_id").alias("good_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        good = good.where("quality = 1 and coalesce(toxic, 0) = 0").select("good_id")
        self.scores = measures(score(self._named(docs), good))
        self.limits = written(thresholds(self.scores.where("trusted")), "thresholds")

    def _named(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.lang_col).cast("string").alias("lang"), text_or_empty(self.text_col).alias("text"))

    def judged(self) -> DataFrame:
        """``scores`` with ``most, least, kept``, by the thresholds of the finest level there are."""
        out = self.scores
        for level, keys in ((2, ["lang", "length"]), (1, ["lang"]), (0, [])):
            own = self.limits.where(F.col("level") == level).select(*keys, F.col("most").alias(f"most_{level}"), F.col("least").alias(f"least_{level}"))
            if not keys:
                out, own = out.withColumn("__all", F.lit(1)), own.withColumn("__all", F.lit(1))
            out = lookup(out, own, keys or ["__all"])
        more = SHORT / F.sqrt(F.greatest("n_chars", F.lit(1)))
        most = F.coalesce("most_2", F.col("most_1") + more, F.col("most_0") + more)
        out = out.withColumn("most", most).withColumn("least", F.coalesce("least_2", "least_1", "least_0"))
        fits = F.coalesce((F.col("log_perplexity") <= F.col("most")) & (F.col("variety") >= F.col("least")), F.lit(True))
        kept = F.col("log_perplexity").isNotNull() & fits
        return out.withColumn("kept", kept).drop("__all", *[f"{m}_{k}" for m in ("most", "least") for k in range(3)])

    def verdicts(self) -> DataFrame:
        """Per row: ``doc_id, lang, perplexity, most`` (of the perplexity), ``variety, least`` (of the variety), ``kept``.

        A null or empty text has a null perplexity and is not kept. Rows with equal ids are judged one by one. A null
        language is one of its own. No rows give no rows.
        """
        out = self.judged()
        return out.select(F.col("id").alias("doc_id"), "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("most").alias("most"), "variety", "least", "kept")

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are accepted, with their own columns.

        Verdicts are those of the language and text, by a 128-bit hash of both.
        """
        text = text_or_empty(self.text_col)
        lang = F.col(self.lang_col).cast("string")
        keyed = docs.withColumns({"__g1": F.xxhash64(lang, text), "__g2": F.xxhash64(F.lit(1), lang, text)})
        kept = self.judged().where("kept").select(F.col("g1").alias("__g1"), F.col("g2").alias("__g2")).distinct()
        return keyed.join(kept, ["__g1", "__g2"], "left_semi").select(*docs.columns)

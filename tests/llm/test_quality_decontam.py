import math
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import ROWS, WORDS, documents, ordered, prose, tuples
from pyspark.sql import functions as F

import corpus_pipeline
from trackgrid.llm import decontam, quality


def plain_model(texts, base):
    """A model in dictionaries: the probability of a character after four."""
    pad = chr(quality.START) * (quality.ORDER - 1)
    counts = {5: Counter((pad + t)[i : i + 5] for t in texts for i in range(len(t)))}
    for k in (4, 3):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: quality.discounts(np.array(list(c.values()))) for k, c in counts.items()}
    total, lost = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            lost[k][g[:-1]] += off[k][min(n, 3)]

    def p(gram):
        k = len(gram)
        if k == 2:
            return base
        context, n = gram[:-1], counts[k].get(gram, 0)
        if not total[k][context]:
            return p(gram[1:])
        return (n - off[k][min(n, 3)]) / total[k][context] + lost[k][context] / total[k][context] * p(gram[1:])

    return p


def test_scores_match_a_plain_model(spark):
    texts = [prose(60, i) for i in range(30)] + ["Ωμέγα 12, été!", "x", "", "日本語テキスト 日本", "%%% &&& zzz", "ñandú 世界" * 40, "aaaa" * 300]
    trusted = {i for i in range(len(texts)) if i % 3 != 2}
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(None, None, texts[0])], "id long, lang string, text string")
    got = {r["id"]: r for r in quality.score(docs, spark.createDataFrame([(i,) for i in trusted], "good_id long")).collect()}
    fold = {i: r["f"] for i, r in enumerate(docs.select(F.expr("pmod(xxhash64(text), 2)").alias("f")).collect())}
    known = {c for i in trusted for c in texts[i]}
    models = [plain_model([texts[i] for i in sorted(trusted) if fold[i] == f], 1 / (1 + len(known))) for f in (0, 1)]
    assert sum(fold[i] for i in trusted) not in (0, len(trusted))
    for i, t in enumerate(texts):
        grams = [("\n\n\n\n" + t)[k : k + 5] for k in range(len(t))]
        assert got[i]["n_chars"] == len(t) and got[i]["n_distinct"] == len(set(grams)) and got[i]["trusted"] == (i in trusted)
        if t:
            want = -sum(math.log(models[1 - fold[i]](g)) for g in grams) / len(t)
            assert got[i]["log_perplexity"] == pytest.approx(want, rel=1e-5)
        else:
            assert got[i]["log_perplexity"] is None
    assert not got[None]["trusted"] and got[None]["log_perplexity"] == pytest.approx(got[0]["log_perplexity"])
    several = [p("e st") for p in [lambda s: sum(models[0](s + c) for c in known | {"\0"})]]
    assert several[0] == pytest.approx(1)


def test_many_blocks_and_buckets_find_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, prose(40, i)) for i in range(60)]).select(F.col("doc_id").alias("id"), "lang", "text")
    good = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "good_id long")
    one = {r["id"]: r for r in quality.score(docs, good).collect()}
    monkeypatch.setattr(quality, "BLOCK_CHARS", 2000)
    many = {r["id"]: r for r in quality.score(docs, good).collect()}
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert many[i]["n_distinct"] == r["n_distinct"] and many[i]["log_perplexity"] == pytest.approx(r["log_perplexity"], rel=1e-5)
    monkeypatch.setattr(quality, "BUCKET_CHARS", 4000)  # discounts are those of a bucket
    parts = {r["id"]: r for r in quality.score(docs, good).collect()}
    assert all(parts[i]["log_perplexity"] == pytest.approx(r["log_perplexity"], rel=0.1) for i, r in one.items())


def test_wide_alphabets_are_coded_by_hashes():
    wide = "".join(chr(0x4E00 + k * 7 % 9000) for k in range(9000))
    coder = quality.Coder(np.unique(quality.points_of([wide])))
    code, sizes, characters = coder.of_texts([wide, "", wide[:100]])
    columns = characters(np.arange(len(code)))
    assert sizes.tolist() == [9000, 0, 100] and len(np.unique(code)) == len({tuple(c) for c in np.stack(columns).T.tolist()})
    assert (coder.of_characters(quality.split(*quality.joined(columns))) == code).all()


def test_thresholds_and_verdicts_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["en", "de"]) if i % 9 else None, r.randrange(1, 3000), r.random() < 0.6, r.gauss(2, 0.3) if i % 50 else None, r.randrange(1, 900)) for i in range(900)]
    scores = spark.createDataFrame([(i, i, i, lang, n, t, v, min(k, n)) for i, lang, n, t, v, k in rows], quality.SCORES)
    found = object.__new__(quality.Classifier)
    found.scores = quality.measures(scores)
    found.limits = quality.thresholds(found.scores.where("trusted"))
    groups = {}
    variety = {i: math.log(min(k, n) + 1) / math.log(n + 1) for i, _, n, _, _, k in rows}
    bins = lambda v: math.floor(v / quality.BIN + 0.5)
    for i, lang, n, t, v, k in rows:
        if t and v is not None:
            for key in ((lang, int(math.log2(n))), (lang,), ()):
                groups.setdefault(key, []).append((bins(v), bins(variety[i])))

    def quantile(values, q):
        values = sorted(values)
        return values[max(0, math.ceil(round(q * len(values), 9)) - 1)] * quality.BIN

    def limits(key):
        v, w = zip(*groups[key])
        mid = lambda x: quantile(x, 0.5)
        (high, up), (low, down) = quality.PERPLEXITY, quality.VARIETY
        return mid(v) + up * (quantile(v, high) - mid(v)) + quality.BIN, mid(w) + down * (quantile(w, low) - mid(w)) - quality.BIN

    got = {x["id"]: x for x in found.judged().collect()}
    levels = set()
    for i, lang, n, t, v, k in rows:
        key = next(key for key, least in (((lang, int(math.log2(n))), 40), ((lang,), 50), ((), 1)) if len(groups.get(key, [])) >= least)
        levels.add(len(key))
        most, least = limits(key)
        most += 0 if len(key) == 2 else quality.SHORT / math.sqrt(n)
        assert got[i]["most"] == pytest.approx(most) and got[i]["least"] == pytest.approx(least)
        assert got[i]["kept"] == (v is not None and v <= most and variety[i] >= least)
    assert levels >= {1, 2}


def sentences(n, seed):
    """Prose in sentences: a capital at the start of each, a full stop at its end."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        words = [r.choice(WORDS) for _ in range(r.randrange(4, 10))]
        out += [words[0].capitalize(), *words[1:-1], words[-1] + "."]
    return " ".join(out[:n])


def test_shuffled_and_repeated_words_go(spark):
    r = random.Random(8)
    clean = [(i, sentences(r.randrange(40, 400), i)) for i in range(700)]
    mix = lambda t: " ".join(r.sample(t.split(), len(t.split())))
    shuffled = [(1000 + i, mix(t)) for i, t in clean if len(t) > 400][:200]
    repeated = [(3000 + i, " ".join([w] * 80)) for i, w in enumerate(WORDS * 4)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in clean + shuffled + repeated], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 700, 2)], "doc_id long, quality long, toxic long")
    kept = {d: k for d, k in tuples(quality.Classifier(spark, docs, labels).verdicts(), "doc_id", "kept")}
    share = lambda rows: sum(kept[d] for d, _ in rows) / len(rows)
    assert share(clean) >= 0.98 and share(shuffled) <= 0.1 and share(repeated) <= 0.1


def corpus():
    r = random.Random(0)
    rows = [(i, prose(r.randrange(20, 200), i)) for i in range(200)]
    noise = [(1000 + i, " ".join("#%&@"[r.randrange(4)] * 3 + chr(33 + r.randrange(15)) + chr(107 + r.randrange(16)) * 2 for _ in range(60))) for i in range(20)]
    return rows, noise


def test_noise_goes_and_prose_stays(spark):
    rows, noise = corpus()
    docs = documents(spark, rows + noise + [(520, None), (521, "")])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i in range(0, 1020, 2)] + [(None, 1, 0), (2, 1, 0), (4, None, None)], "doc_id long, quality long, toxic long")
    kept = {d: k for d, k in tuples(quality.Classifier(spark, docs, labels).verdicts(), "doc_id", "kept")}
    assert not any(kept[d] for d, _ in noise)
    assert sum(kept[d] for d, _ in rows) >= 0.98 * len(rows)
    assert not kept[520] and not kept[521]
    out = quality.Classifier(spark, docs, labels).accepted(docs)
    assert out.columns == docs.columns and {d for d, in tuples(out, "doc_id")} == {d for d, k in kept.items() if k}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    none = documents(spark, [])
    assert quality.Classifier(spark, none, labels).verdicts().count() == 0
    some = quality.Classifier(spark, documents(spark), labels).verdicts()
    assert some.where("kept").count() == sum(bool(t) for _, t in ROWS)


def items(n=40):
    return [(i, f"{prose(8 + i, 300 + i)}. What {prose(4, i)}? {prose(5, 900 + i)}.") for i in range(n)] + [(90, prose(300, 77)), (91, None), (92, "..."), (None, "no id here at all"), (93, "Une seule phrase courte")]


def test_retrieval_finds_all_above_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 2)
    table = spark.createDataFrame(items() + items()[:3], "item_id long, text string")
    indexes = [i for part in decontam.build_indexes(table) for i in part]
    assert sorted(i for x in indexes for i in x.ids) == sorted([*range(40), 90, 93])
    r = random.Random(6)
    checked = 0
    for index in indexes:
        words = list(index.number)
        for _ in range(60):
            terms = sorted({index.number[w] for w in r.sample(words, min(len(words), r.randrange(1, 30)))})
            scores = {}
            for t in terms:
                for item, share in zip(index.items[t], index.shares[t]):
                    scores[item] = scores.get(item, 0.0) + share
            for threshold in (0.05, 0.2, 0.6):
                want = {i: s for i, s in scores.items() if s >= threshold}
                assert {i: pytest.approx(s) for i, s in index.retrieve(terms, threshold)} == want
                checked += len(want)
    assert checked > 100


def test_leaks(spark):
    tests = items()
    docs, want = [], set()
    for k, (i, text) in enumerate(tests[:41]):
        before = prose(k * 7, 5000 + k)
        docs.append((k, f"{before} {text.upper() if k % 2 else text} {prose(50, 6000 + k)}"))
        want.add((k, i))
    docs += [(500 + k, prose(80, 7000 + k)) for k in range(60)] + [(600, None), (601, ""), (None, tests[0][1]), (602, tests[5][1]), (602, tests[5][1])]
    want |= {(None, 0), (602, 5)}
    table = spark.createDataFrame(tests, "item_id long, text string")
    frame = documents(spark, docs)
    assert set(tuples(decontam.find_leaks(frame, table), "doc_id", "item_id")) == want
    clean = decontam.without_leaks(frame, table)
    leaked = {d for d, _ in want}
    assert clean.columns == frame.columns
    assert ordered(d for d in tuples(clean, "doc_id")) == ordered((d,) for d, _ in docs if d not in leaked)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(frame, nothing).count() == 0 and decontam.without_leaks(frame, nothing).count() == len(docs)


def test_many_parts_find_the_same(spark, monkeypatch):
    table = spark.createDataFrame(items(), "item_id long, text string")
    frame = documents(spark, [(k, t) for k, (_, t) in enumerate(items()) if t])
    one = set(tuples(decontam.find_leaks(frame, table), "doc_id", "item_id"))
    monkeypatch.setattr(decontam, "INDEX_POSTINGS", 200)
    assert len(decontam.build_indexes(table)) > 2
    got = set(tuples(decontam.find_leaks(frame, table), "doc_id", "item_id"))
    assert got == one and len(one) >= 41


def test_pipeline_stages_keep_columns_and_whole_results(spark, tmp_path):
    rows, noise = corpus()
    tests = items()
    planted = [(2000, rows[0][1]), (2001, rows[1][1].replace(" ", "  ", 1)), (2002, prose(30, 1) + " " + tests[20][1])]
    docs = documents(spark, rows + noise + planted)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in range(0, 1020)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        left.append({d for d, in tuples(now, "doc_id")})
    assert not left[0] & {d for d, _ in noise}
    assert left[0] - left[1] == {0}
    assert left[1] - left[2] == {2001}
    assert left[2] - left[3] == {2002}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {d for d, in tuples(packed, "doc_id")} == left[3]


def test_pipeline_stages_take_awkward_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, None), (None, 1, 0), (40, 1, 0)], "doc_id long, quality long, toxic long")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in items() if i != 5], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {t or "" for _, t in ROWS}
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            kept = ordered(tuples(out, "doc_id", "text"))
            assert set(kept) <= set(rows), name
            if name == "exact_dedup":
                assert sorted(t or "" for _, t in kept) == sorted(texts if rows else [])
            if name == "quality_classifier":
                assert all(t for _, t in kept)
            if name == "near_dedup" and rows:
                assert {d for d, t in kept if not t} == {d for d, t in ROWS if not t}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.where("piece = 0").count() == len(rows)

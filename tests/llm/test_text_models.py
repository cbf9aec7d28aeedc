"""Language model, language identification, toxicity, quality: against plain
recomputation and on held-out texts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docreg.llm import crf, language_id, ngram_lm, quality, toxicity
from docreg.llm.base import fold

DOCS = "doc_id long, text string, score string, words string, chunk int, label int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", "y", -1, 7) for i, t in rows], DOCS)


def prose(rng, syllables, words):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))


# --- op1


def plain_tokens(text):
    return (text or "").encode().lower().split() + [None]


def lm_rows():
    rng = random.Random(3)
    rows = [(i, prose(rng, ["ba", "do", "ki"], rng.randint(1, 60))) for i in range(60)]
    rows += [(None, "Ba do"), (61, None), (62, ""), (63, "   \t\n"), (64, "unseen1 UNSEEN2"), (5, rows[5][1]), (65, "ba " * 30_000), (66, "É é")]
    return rows


def is_fold(i, held):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == held


@pytest.mark.parametrize("chunk_bytes", [300, 10_000_000])
def test_deleted_interpolation(spark, chunk_bytes):
    rows = lm_rows()
    part = fold(F.col("doc_id"), 7)
    model = ngram_lm.fit(docs_of(spark, rows), part == 2, part == 3, chunk_bytes, chunk_bytes)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngram_lm.score(model).collect())
    word, pair, start = Counter(), Counter(), 0
    for i, text in rows:
        if not is_fold(i, 2):
            tokens = plain_tokens(text)
            word.update(tokens)
            pair.update(zip(["<s>"] + tokens, tokens))
            start += 1
    n, v = sum(word.values()), len(word)
    want = []
    for i, text in rows:
        tokens, base, full = plain_tokens(text), 0.0, 0.0
        for before, t in zip(["<s>"] + tokens, tokens):
            single = (word[t] + 1) / (n + v + 1)
            context = start if before == "<s>" else word[before]
            w = model.weights[0 if context == 0 else int(math.log2(context)) + 1]
            base += math.log10(single)
            full += math.log10((w * pair[before, t] / context if context else 0) + (1 - w) * single)
        want.append((i is None, i or 0, is_fold(i, 2), len(tokens), sum(word[t] > 0 for t in tokens), n, round(base, 6), round(full, 6)))
    assert got == sorted(want)


def test_weights_are_the_best_ones(spark):
    rows = lm_rows()
    part = fold(F.col("doc_id"), 7)
    model = ngram_lm.fit(docs_of(spark, rows), part == 2, part == 3, 10_000_000, 10_000_000)
    word, pair, start = Counter(), Counter(), 0
    for i, text in rows:
        if not is_fold(i, 2) and not is_fold(i, 3):
            tokens = plain_tokens(text)
            word.update(tokens)
            pair.update(zip(["<s>"] + tokens, tokens))
            start += 1
    n, v = sum(word.values()), len(word)
    by_bucket = {}
    for i, text in rows:
        if is_fold(i, 3):
            tokens = plain_tokens(text)
            for before, t in zip(["<s>"] + tokens, tokens):
                context = start if before == "<s>" else word[before]
                if context:
                    by_bucket.setdefault(int(math.log2(context)) + 1, []).append((pair[before, t] / context, (word[t] + 1) / (n + v + 1)))
    assert by_bucket
    for bucket, both in by_bucket.items():
        likelihood = lambda w: sum(math.log(w * a + (1 - w) * b) for a, b in both)  # noqa: B023, E731
        best = max(likelihood(w / 200) for w in range(1, 200))
        assert likelihood(min(max(model.weights[bucket], 0.001), 0.999)) >= best - 0.05 * len(both) ** 0.5


def test_language_model_without_training_texts(spark):
    empty = docs_of(spark, [(1, "a")]).where("false")
    part = fold(F.col("doc_id"), 7)
    assert ngram_lm.score(ngram_lm.fit(empty, part == 2, part == 3)).collect() == []
    held = [i for i in range(40) if is_fold(i, 2)][:1]
    row = ngram_lm.score(ngram_lm.fit(docs_of(spark, [(held[0], "a b")]), part == 2, part == 3)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


# --- op4


def test_codewords():
    for n in (2, 3, 4, 7, 8, 30):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_languages(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ka", "to", "mi"], "bb": ["schu", "ver", "ung"], "cc": ["é", "tion", "eau"]}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        rows.append((i, prose(rng, kinds[lang], rng.randint(4, 60)), lang if i % 10 else None, "s"))
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 34 !?", "aa", "s"), (None, "schuver ungver", None, "s"), (903, "éeaution " * 20_000, "cc", "s"), (1, rows[1][1], "bb", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = language_id.identify_language(df, fold(F.col("doc_id"), 5) != 0).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert sum(by_id[i]["lang_pred"] == list(kinds)[i % 3] for i in range(240)) >= 238
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by_id[None]["lang_pred"] == "bb" and by_id[903]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    one = language_id.identify_language(df.where("lang = 'aa' or lang is null")).where("doc_id = 0").collect()
    assert all(r["lang_pred"] in ("aa", "und") for r in one)
    assert language_id.identify_language(df.where("false")).collect() == []


# --- chain


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    emission = rng.normal(size=11)
    chain = crf.Chain(np.zeros(0), 0.3, rng.normal(size=(2, 2)))
    got = crf.marginals(crf.Sequences(lengths), emission, chain)[0]
    begin = 0
    for n in lengths:
        total, ones = 0.0, np.zeros(n)
        for path in range(2**n if n else 0):
            tags = [(path >> k) & 1 for k in range(n)]
            s = sum(emission[begin + k] * t for k, t in enumerate(tags)) + 0.3 * tags[0] + sum(chain.moves[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(s)
            ones += math.exp(s) * np.array(tags)
        if n:
            assert np.allclose(got[begin : begin + n], ones / total)
        begin += n


# --- op3


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["scumble", "vexor", "dratful"]
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, ["ka", "to", "mi", "su", "re"], rng.randint(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad).upper() if i % 8 else rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, None, int(toxic)))
    odd = [(900, None), (901, ""), (902, "..."), (None, "ka vexor to"), (903, "kato " * 30_000 + "dratful"), (4, rows[4][1])]
    labels += [(4, 1, 1), (4, 1, 1), (None, 1, 1), (7777, 0, 0), (901, 1, None)]
    docs, marks = docs_of(spark, rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks, fold(F.col("doc_id"), 5) != 0).collect()
    assert len(got) == len(rows) + len(odd)
    texts = dict(rows + odd)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0), r
            found = {w.lower() for s in r["spans"] for w in texts[r["doc_id"]][s["start"] : s["end"]].split()}
            assert found == {w.lower() for w in texts[r["doc_id"]].split() if w.lower() in bad}
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["score"] >= 0.5 and by_id[903]["score"] >= 0.5 and by_id[903]["n_toxic"] == 1
    assert all(by_id[i]["score"] < 0.5 and by_id[i]["n_toxic"] == 0 for i in (900, 901, 902))
    kept = toxicity.keep_civil(docs, marks, fold(F.col("doc_id"), 5) != 0)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["score"] < 0.5)
    assert toxicity.score_toxicity(docs.where("false"), marks).collect() == []
    assert {r["score"] for r in toxicity.score_toxicity(docs, marks.where("false")).collect()} == {0.5}


# --- op5


def test_quality(spark):
    rng = random.Random(4)

    def good():
        return "\n".join(prose(rng, ["ka", "to", "mi", "su"], rng.randint(5, 15)).capitalize() + "." for _ in range(rng.randint(1, 6)))

    def bad(i):
        if i % 2:
            return "\n".join(" | ".join(prose(rng, ["ka", "to"], 6).split()) for _ in range(rng.randint(1, 5)))
        return "\n".join("!! ".join(prose(rng, ["ka", "to"], 9).upper().split()) for _ in range(rng.randint(1, 5)))

    rows = [(i, (good() if i % 4 else prose(rng, ["ka", "to", "mi", "su"], 8).capitalize() + ".\n" + bad(i // 4))) for i in range(320)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 320) if i % 3]
    odd = [(900, None), (901, ""), (902, "\n\n"), (None, good()), (903, "\n".join(good() for _ in range(4_000))), (4, rows[4][1])]
    docs, marks = docs_of(spark, rows + odd), spark.createDataFrame(labels + [(5, None, 1), (None, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, marks, fold(F.col("doc_id"), 3) != 1).collect()
    assert len(got) == len(rows) + len(odd)
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(right) >= len(right) - 3
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["score"] >= 0.5 and by_id[903]["score"] >= 0.5
    assert [by_id[i]["n_lines"] for i in (900, 901, 902)] == [1, 1, 3]
    bad_lines = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 4 == 0]
    assert sum(0 not in r["bad_lines"] and len(r["bad_lines"]) == r["n_lines"] - 1 for r in bad_lines) >= 0.8 * len(bad_lines)
    kept = quality.keep_good(docs, marks, fold(F.col("doc_id"), 3) != 1)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in got)
    assert quality.score_quality(docs.where("false"), marks).collect() == []
    assert {r["score"] for r in quality.score_quality(docs, marks.where("false")).collect()} == {0.5}


@pytest.mark.parametrize("lengths", [[300], [1, 0, 900, 3, 101, 0, 17, 2000], [150] * 5, [0, 0]])
def test_long_sequences_are_cut_without_a_change(monkeypatch, lengths):
    rng = np.random.default_rng(len(lengths))
    n = sum(lengths)
    chain = crf.Chain(np.zeros(1), 0.7, rng.normal(size=(2, 2)) * 2)
    emission = rng.normal(size=n) * 8
    whole = crf.marginals(crf.Sequences(np.array(lengths)), emission, chain)
    monkeypatch.setattr(crf, "LONG", 100)
    cut = crf.marginals(crf.Sequences(np.array(lengths)), emission, chain)
    for a, b in zip(whole, cut):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_the_slope_of_the_fit_is_that_of_the_likelihood():
    """One round of the fit moves along the slope, compared with finite differences."""
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 6, 3])
    x, tags = rng.normal(size=(14, 3)), rng.integers(0, 2, 14)

    class Features:
        size = 3

        def scores(self, w):
            return x @ w

        def pull(self, g):
            return x.T @ g

    def likelihood(w):
        total, at = 0.0, 0
        for n in lengths:
            own, e = tags[at : at + n], x[at : at + n] @ w
            paths = [sum(t * v for t, v in zip(path, e)) for path in itertools.product((0, 1), repeat=int(n))]
            total += (own * e).sum() - np.log(np.exp(paths).sum())
            at += n
        return total / lengths.sum()

    w = np.zeros(3)
    want = [(likelihood(w + d) - likelihood(w - d)) / 2e-5 for d in np.eye(3) * 1e-5]
    p = crf.marginals(crf.Sequences(lengths), x @ w, crf.Chain(w))[0]
    assert np.allclose(Features().pull(tags - p) / lengths.sum(), want, atol=1e-6)
    assert likelihood(crf.train(Features(), tags, lengths).weights) > likelihood(w)


def test_evidence_by_windows_is_that_of_the_features(monkeypatch):
    texts = ["a b.\n\nc!! d 1 2\n" * 9, None, "", "x", "\n\n", "É é|é\n#"]
    rng = np.random.default_rng(5)
    features = quality.LineFeatures(texts)
    weights = rng.normal(size=features.size)
    for window in (1, 3, 20_000):
        monkeypatch.setattr(quality, "WINDOW", window)
        found, length = quality._emission(*quality._lines(texts), features.scale, weights)
        assert np.allclose(found, features.scores(weights)) and (length == features.length).all()
    # a document's score from plain sums over its lines
    model = quality.Model(crf.Chain(weights, 0.3, rng.normal(size=(2, 2))), features.scale, np.array([0.5, 2.0, -1.0]))
    marked, bad = model.mark(texts)
    at = 0
    for row, n in zip(model.evidence(marked, bad), marked.counts):
        share = sum((marked.length[i] + 1) * (1 - bad[i]) for i in range(at, at + n)) / sum(marked.length[i] + 1 for i in range(at, at + n))
        assert np.isclose(row[1], share) and np.isclose(row[0], np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))) / 3)
        at += n


def test_six_megabytes_of_line_ends():
    import tracemalloc

    model = quality.fit([("good line here.\nAnother fine one.\n" * 3, 1), ("$$$ ### |||\n!!!\n", 0)] * 10)
    text = "\n" * 6_000_000
    tracemalloc.start()
    try:
        marked, bad = model.mark([text])
        assert len(bad) == 6_000_001 and 0 <= model.score(marked, bad)[0] <= 1
        assert tracemalloc.get_traced_memory()[1] < 500_000_000
    finally:
        tracemalloc.stop()

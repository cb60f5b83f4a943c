"""Words, rules, languages, quality."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.llm import folds, langid, quality, rules, textcore

from .brute import DOCS, documents, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t . $", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_are_those_of_the_pattern(texts, limit):
    seen = {}
    for lo, hi, c in textcore.chunks(pa.array(texts, pa.string()), limit):
        assert c.n == hi - lo
        raw = c.data.tobytes()
        for k in range(c.n):
            a, b = c.word_offsets[k], c.word_offsets[k + 1]
            own = [raw[x:y].decode() for x, y in zip(c.starts[a:b], c.ends[a:b], strict=True)]
            assert own == words(texts[lo + k])
            for w, h in zip(own, c.words[a:b], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_features_match_a_plain_count(texts):
    for lo, _, c in textcore.chunks(pa.array(texts, pa.string())):
        f = rules.features(c)
        for k in range(c.n):
            text = texts[lo + k] or ""
            w = words(text)
            lines = [x for x in text.split("\n") if words(x)]
            windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            again = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
            assert f["n_words"][k] == len(w)
            assert f["word_chars"][k] == sum(map(len, w))
            assert f["n_symbols"][k] == sum(text.count(x) for x in "#*$%&|<>")
            assert f["n_dup_lines"][k] == len(lines) - len(set(lines))
            assert f["n_repeat_words"][k] == len(again)


def test_rules_verdicts(spark):
    rng = random.Random(1)
    good = [f"w{rng.randint(0, 30)}" for _ in range(4000)]
    docs = [(i, " ".join(good[i * 70 : i * 70 + 70])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x " * 500), (103, " ".join(f"JUNK{rng.randint(0, 30)}" for _ in range(90))), (None, docs[0][1]), (0, docs[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(103, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(documents(spark, docs).withColumnRenamed("n_chars", "score"), labels).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(40)) and by[None].kept
    assert all(by[i].base_failed and not by[i].kept for i in (100, 101, 102))
    assert not by[103].base_failed and not by[103].kept
    assert rules.quality_rules(documents(spark, []), labels).count() == 0
    none = labels.where("false")
    assert all(r.score == 0 for r in rules.quality_rules(documents(spark, docs), none).collect())


def _language(k: int, n: int, rng: random.Random) -> str:
    parts = [["th", "er", "ing", "and"], ["ung", "sch", "ein", "ich"], ["ción", "os", "ada", "ñ"]][k]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    docs = [(i, _language(i % 3, rng.randint(5, 60), rng), ("en", "de", "es")[i % 3], None) for i in range(300)]
    extra = [(1000, None, "en", None), (1001, "123 !!", "en", None), (1002, "", None, None), (None, _language(1, 50, rng), "de", None), (1003, _language(2, 20_000, rng), None, None)]
    got = {r.doc_id: r for r in langid.identify(documents(spark, docs + extra)).collect()}
    assert len(got) == 305
    right = sum(got[d[0]].lang_pred == d[2] for d in docs if got[d[0]].held_out)
    assert right == sum(got[d[0]].held_out for d in docs) > 30
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    assert got[None].lang_pred == "de" and not got[None].held_out and got[1003].lang_pred == "es"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert langid.identify(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark, [(1, "abc")])).collect()} == {"und"}  # nothing was learned


def test_out_of_place_distance_by_hand():
    profiles = {"x": langid.ranked(*langid.grams("aaab ab"), 5).tolist(), "y": langid.ranked(*langid.grams("zz z"), 5).tolist()}
    own = langid.ranked(*langid.grams("aaab"), 5).tolist()
    distance = sum(abs(profiles["x"].index(g) - k) if g in profiles["x"] else 5 for k, g in enumerate(own))
    assert langid._judge(profiles, 5)("aaab") == ("x", 1 - distance / (5 * len(own)))


def test_long_texts_are_counted_and_hashed_in_parts(monkeypatch):
    rng = random.Random(4)
    text = " ".join(_language(k % 3, 20, rng) for k in range(40))
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PART", 100)
    parts = langid.grams(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    long = "é word, " * 150_000
    own = [c for _, _, c in textcore.chunks(pa.array([long, "word,", long]))]
    assert len(own) == 3 and len(own[0].data) > textcore.CHUNK_BYTES
    assert (own[0].words[1::2] == own[1].words[0]).all() and len(set(own[0].words[::2].tolist())) == 1
    assert own[0].hashes(own[0].offsets[:1], own[0].offsets[1:]) == own[2].hashes(own[2].offsets[:1], own[2].offsets[1:])


def test_bounded_sample(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id % 2 as g")
    n = folds.bounded_sample(df, "doc_id", 100).count()
    assert 60 < n < 150
    by = {r.g: r["count"] for r in folds.bounded_sample(df, "doc_id", 100, "g").groupBy("g").count().collect()}
    assert len(by) == 2 and all(60 < v < 150 for v in by.values())
    assert folds.bounded_sample(df, "doc_id", 5000).count() == 1000
    same = folds.bounded_sample(df, "doc_id", 100, "g").orderBy("doc_id").select("doc_id", "g").collect()
    monkeypatch.setattr(folds, "FEW", 1)  # more values than fit in a broadcast
    assert folds.bounded_sample(df, "doc_id", 100, "g").orderBy("doc_id").select("doc_id", "g").collect() == [r for r in same]


def test_quality_on_held_out_documents(spark):
    rng = random.Random(3)
    make = lambda q: " ".join((rng.choice(["alpha", "beta", "gamma"]) if rng.random() < 0.8 else "delta") + ("" if q else rng.choice(["!!", "$$"])) for _ in range(40))
    rows = [(i, make(i % 4 > 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (0, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (None, rows[1][1]), (1, rows[1][1])]
    got = quality.classify(documents(spark, rows + extra), labels).collect()
    assert len(got) == 404
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if by[i].held_out]
    assert sum(by[i].predicted == int(i % 4 > 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[1000].score == by[1001].score
    one = labels.where("quality = 1")
    assert {round(r.score, 3) for r in quality.classify(documents(spark, rows[:5]), one).collect()} == {0.999}
    assert {r.score for r in quality.classify(documents(spark, rows[:5]), one.where("false")).collect()} == {0.5}
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.array([0, 2 + k % 5]) if k % 2 else np.array([1, 2 + k % 5]) for k in range(60)]
    model = quality.fit(rows, np.arange(60) % 2, bits=4)
    offsets = np.arange(0, 122, 2)
    m = model.scores(np.concatenate(rows), offsets)
    assert ((m > 0.5) == (np.arange(60) % 2 == 1)).all() and rng is not None


def test_verdicts_match_dictionary_multinomials(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(pool[: 30 + i % 30]) for _ in range(rng.choice([5, 55, 80]))) for i in range(120)}
    texts |= {200: None, 201: "", 202: "same same same " * 40}
    labels = [(i, int(i % 4 > 0), int(i % 7 == 0)) for i in range(0, 120, 2)] + [(200, 1, 0), (None, 1, 0), (4, 1, 0), (999, 1, 0)]
    size, threshold = 64, -0.02

    def bucket(*w: str) -> int:
        c = next(textcore.chunks(pa.array([" ".join(w)])))[2]
        return int((c.words[0] if len(w) == 1 else c.grams(2)[0][0]) % np.uint64(size))

    seen: dict = {}
    grams = {k: [seen.setdefault(g, bucket(*g)) for g in [*((x,) for x in words(t)), *zip(words(t), words(t)[1:])]] for k, t in texts.items()}
    per: dict = {}
    for i, q, t in labels:
        per.setdefault(i, []).append((q, t))
    trusted = {i for i, x in per.items() if i is not None and min(q for q, _ in x) == 1 and max(t for _, t in x) == 0}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for k, x in grams.items() if k in trusted for g in x)
    n, m = sum(raw.values()), sum(target.values())

    def ratio(g: int) -> float:
        p = (raw[g] + 1) / (n + size)
        return math.log((target[g] + size * p) / (m + size) / p)

    rows = documents(spark, list(texts.items())).withColumnRenamed("lang", "trusted").withColumnRenamed("source", "quality")
    got = {r.doc_id: r for r in rules.quality_rules(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), size, threshold).collect()}
    kept = 0
    for k, x in grams.items():
        score = sum(map(ratio, x)) / max(1, len(x))
        assert abs(got[k].score - score) < 1e-9
        assert got[k].kept == (not got[k].base_failed and score >= threshold)
        kept += got[k].kept
    assert 5 < kept < 100 and got[202].base_failed and got[200].base_failed


def test_languages_match_dictionary_profiles(spark):
    rng = random.Random(9)
    docs = [(i, _language(i % 3, rng.randint(1, 40), rng) + rng.choice(["", " É1x!", " 日本"]), ("en", "de", "es")[i % 3], None) for i in range(150)]
    docs += [(500, "", "en", None), (501, None, "en", None), (502, "12 ?", None, None), (503, "AaAa aa", None, None)]

    def counted(text: str | None) -> Counter:
        out: Counter = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f" {w} "
            out.update(w[1:-1])
            out.update(w[k : k + 2] for k in range(len(w) - 1))
            out.update(w[k : k + 3] for k in range(len(w) - 2))
        return out

    def ranks(counts: Counter, size: int) -> list[str]:
        code = lambda g: sum(ord(x) << 21 * k for k, x in enumerate(g))
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]

    size, sums = 40, {}
    for i, text, lang, _ in docs:
        if lang and zlib.crc32(str(i).encode()) % 5:
            sums.setdefault(lang, Counter()).update(counted(text))
    profiles = {lang: {g: k for k, g in enumerate(ranks(x, size))} for lang, x in sums.items()}
    got = {r.doc_id: r for r in langid.identify(documents(spark, docs), size).collect()}
    for i, text, _, _ in docs:
        own = ranks(counted(text), size)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        distance, lang = min((sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        assert got[i].lang_pred == lang and abs(got[i].score - (1 - distance / (size * len(own)))) < 1e-12


def test_hinge_model_matches_a_plain_dense_solver():
    rng = np.random.default_rng(4)
    y = np.array([0, 1, 1, 0, 1, 0, 1] * 9)[:60]
    rows = [np.unique(np.concatenate([rng.choice(12, 4) + 4 * label, rng.choice(16, 2)])) for label in y]
    model = quality.fit(rows, y, bits=5, beta=0.0, epochs=4000)
    train = [i for i in range(len(y)) if i % 5]
    x = np.zeros((len(y), 32))
    for i, at in enumerate(rows):
        x[i, at] = 1
    p, q = (1 + x[[i for i in train if y[i] == label]].sum(0) for label in (1, 0))
    scale = np.log(p / p.sum()) - np.log(q / q.sum())
    assert np.allclose(scale, model.scale)
    z = x * scale
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    sign, share = 2 * y[train] - 1, y[train].mean()
    cost = np.where(sign > 0, 0.5 / share, 0.5 / (1 - share))
    # the dual by plain projected gradient steps
    a, g = np.zeros(len(train)), (z[train] @ z[train].T) * np.outer(sign, sign)
    for _ in range(200_000):
        a = np.clip(a - (g @ a - 1) / np.linalg.norm(g, 2), 0, cost)
    w = (a * sign) @ z[train]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert np.allclose(model.margins(np.concatenate(rows), offsets), z @ w, atol=0.02)


def test_very_long_texts_and_extra_columns(spark):
    long = "the quick brown fox " * 100_000
    docs = documents(spark, [(1, long), (2, "a b"), (2, "a b"), (2, "other text"), (None, long)]).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "held_out").withColumnRenamed("lang", "quality")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 5
    assert {r.n_words for r in rules.quality_rules(docs, labels).collect()} == {400_000, 2}
    named = docs.withColumn("lang", docs.doc_id.cast("string")).withColumnRenamed("held_out", "lang_pred")
    assert langid.identify(named).count() == 5

"""Near copies and repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skyframe.llm import components, jaccard, substring
from skyframe.llm.textcore import chunks, seeds

from .brute import classes, documents, links, words


def corpus(rng: random.Random, n: int = 60, length: int = 90) -> dict[int, str]:
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, length))]
        texts[i] = " ".join(base)
        if i % 3 == 0 and len(base) > 20:
            for k in range(3):
                copy = list(base)
                for _ in range(k):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts[1000 + 10 * i + k] = " ".join(copy)
    return texts


def test_links_and_classes_match_brute_force(spark):
    texts = corpus(random.Random(4))
    extra = [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (5003, "one two"), (5004, "one  two"), (5005, "x " * 30_000)]
    rows = [*texts.items(), *extra, (0, texts[0])]
    got = jaccard.similar(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    full = {**texts, **{k: v for k, v in extra if k is not None}}
    rep = {}
    for k in sorted(full):
        rep.setdefault(full[k], k)
    unique = {k: full[k] for k in rep.values() if words(full[k])}
    edges = links(unique)
    group = classes(full, [*edges, *((k, rep[t]) for k, t in full.items() if words(t))])
    for r in got:
        if r.doc_id is None:
            assert (r.class_id, r.n_links) == (None, 0)
            continue
        own = rep[full[r.doc_id]] if words(full[r.doc_id]) else r.doc_id
        assert r.text_class == own and r.class_id == group[r.doc_id]
        assert r.n_links == sum(own in e for e in edges)
    assert jaccard.similar(documents(spark, [])).count() == 0


def test_large_group_is_verified_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    texts = {}
    for i in range(70):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"e{i}"
        texts[i] = " ".join(copy)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    monkeypatch.setattr(jaccard, "TILE", 5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar(documents(spark, list(texts.items()))).collect()}
    edges = links(texts)
    assert got == {i: (0, sum(i in e for e in edges)) for i in texts}


def test_prefix_depth_reaches_the_recall():
    for t, trees, recall in ((0.8, 16, 0.999), (0.9, 8, 0.99), (0.8, 4, 0.5)):
        d = jaccard.depth_for(t, trees, 10, recall)
        assert 1 - (1 - t**d) ** trees >= recall
        assert d == 10 or 1 - (1 - t ** (d + 1)) ** trees < recall


def test_labels_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**62, 50).astype(np.uint64)])) for _ in range(2)]
    raw = [x.tobytes() for x in jaccard.labels(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 200, 8)]
    for depth in (1, 4):
        p = jaccard.prefixes(raw, 200, depth)
        assert abs((p[0] == p[1]).mean() - 0.8**depth) < 0.1


def test_prefixes_are_shortened_until_the_measured_recall_is_reached(spark):
    rng = random.Random(12)
    almost, rows = [f"v{i}" for i in range(5000)], []
    for g in range(120):  # many links, nearly all at 0.99
        base = [rng.choice(almost) for _ in range(600)]
        for k in range(3):
            rows.append((10 * g + k, " ".join([*base, f"end{k}"])))
    forest = jaccard.Forest(documents(spark, rows), 0.8, 16, 8, 0.999)
    found, tried = jaccard.search(forest, 0.998)
    assert len(tried) < 3 and tried[-1][0] > forest.floor and tried[-1][1] >= 0.998
    assert found.where("node is not null").agg({"links": "sum"}).collect()[0][0] == 2 * len(links(dict(rows)))
    # few links, at the threshold: the length at which any pair is found
    low = [(i, " ".join([*(rng.choice(almost) for _ in range(100)), "x"])) for i in range(3)]
    low += [(9, low[0][1] + " " + " ".join(f"n{i}" for i in range(22)))]
    forest = jaccard.Forest(documents(spark, low), 0.8, 16, 8, 0.999)
    assert [d for d, _ in jaccard.search(forest)[1]][-1] == forest.floor == 4
    exact = {0.99: 1000, 0.8: 2}
    assert jaccard.expected_recall(exact, 8, 8, 0.8, 16) < jaccard.expected_recall(exact, 8, 6, 0.8, 16) < jaccard.expected_recall(exact, 8, 4, 0.8, 16) < 1


def test_every_link_of_the_test_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    unique = {k: t for t, k in first.items() if words(t)}
    edges = links(unique)
    got = {r.doc_id: r for r in jaccard.similar(docs).collect()}
    assert sum(got[k].n_links for k in unique) == 2 * len(edges) > 0
    group = classes(unique, edges)
    assert all(got[k].class_id == group[k] for k in unique)


def test_texts_that_share_an_identifier_are_judged_each(spark):
    a, b, c = (" ".join(passages_of(random.Random(i), 40)) for i in (1, 2, 3))
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (5, None), (5, None), (6, ""), (None, a), (7, c)]
    docs = documents(spark, rows).withColumnRenamed("lang", "k1").withColumnRenamed("source", "stays")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (2, b), (4, c), (5, None), (5, None), (6, ""), (None, a)], key=repr)
    got = {(r.doc_id, r.class_id) for r in jaccard.similar(docs).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (7, 4), (5, 5), (6, 6), (None, None)}


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 15)).astype(np.uint64) for _ in range(9)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(9, dtype=bool)  # a set is not compared with itself
    assert (jaccard.intersections(sets, 9, 7) == exact)[apart].all()
    assert (jaccard.intersections(sets, 4, 5) == exact[:4, 4:]).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == classes({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def passages_of(rng: random.Random, n: int) -> list[str]:
    return [f"p{rng.randint(0, 10**6)}" for _ in range(n)]


def test_repeated_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(7)
    shared, long = passages_of(rng, 55), passages_of(rng, 300)
    near = list(long)
    near[40], near[200] = "changed", "also"
    line = ["common"] * 1 + passages_of(rng, 12)
    docs = {}
    for i in range(40):
        docs[i] = passages_of(rng, 80) + line + passages_of(rng, 40)  # a short common line isn't a passage
    for i in (3, 9, 21):
        docs[i] = docs[i][:30] + shared + docs[i][30:]
    docs[11] = docs[11] + long
    docs[30] = near + docs[30]
    docs[35] = list(docs[2])  # a whole copy
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(100, None), (101, ""), (102, "short text"), (None, " ".join(shared)), (2, " ".join(docs[2]))]
    got = substring.report(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {3, 9, 21, 11, 30, 35, 2}
    again = {}
    for r in got:
        if r.repeats:
            again.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    assert set(again) == {9, 21, 30, 35}
    assert again[9] == set(range(30, 85)) == again[21]
    assert again[30] == set(range(300)) and again[35] == set(range(len(docs[2])))
    spans = substring.repeats(documents(spark, rows))
    kept = {r.doc_id: r for r in substring.without(documents(spark, rows), spans).collect() if r.doc_id is not None}
    assert 35 not in kept and kept[9].text == " ".join(docs[9][:30] + docs[9][85:])
    assert kept[9].n_chars == len(kept[9].text) and kept[0].text == rows[0][1] and kept[3].text == rows[3][1]
    assert kept[100].text is None and kept[101].text == ""
    assert substring.report(documents(spark, [])).count() == 0


def test_exact_repeats_are_all_covered(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(100_000)]
    docs = {}
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(50, 120))] for _ in range(8)]
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 2:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(pool)
        docs[i] = own
    where = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    must = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            if min(where[tuple(w[k : k + 50])]) < i:
                must.setdefault(i, set()).update(range(k, k + 50))
    got = {}
    for r in substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    assert all(must[i] <= got.get(i, set()) for i in must) and len(must) > 15
    assert set(got) == set(must)


def test_a_large_group_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    shared, docs = passages_of(rng, 58), {}
    for i in range(90):
        docs[i] = passages_of(rng, 60) + (shared if i % 3 else shared[9:45]) + passages_of(rng, 50)
    got = []
    for part_rows, sample in ((substring.PART_ROWS, 64), (8, 1)):
        monkeypatch.setattr(substring, "PART_ROWS", part_rows)
        monkeypatch.setattr(substring, "SAMPLE", sample)
        rows = substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()
        got.append({(r.doc_id, r.first_word, r.end_word) for r in rows})
        assert all(r.kept_in < r.doc_id for r in rows)
    assert got[0] == got[1] == {(i, 60, 118) for i in range(2, 90) if i % 3}


def test_exact_repeats_are_found_behind_documents_with_a_part(spark):
    rng = random.Random(11)
    docs, must = {}, {}
    for g in range(40):
        shared = passages_of(rng, 50 + g % 3 * 10)
        line = shared[5 : 45 + g % 3 * 2]  # under 50 words: no passage, though its document leads most groups
        docs[g] = passages_of(rng, 70) + line + passages_of(rng, 80)
        for i in (100 + g, 200 + g):
            docs[i] = passages_of(rng, 60 + g) + shared + passages_of(rng, 90 - g)
        must[200 + g] = set(range(60 + g, 60 + g + len(shared)))
    got = {}
    for r in substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect():
        if r.kept_in >= 100:
            got.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    assert got == must


def test_passages_of_repeated_words_line_up():
    a, b, c, d = (np.uint64(x) for x in (1, 2, 3, 4))
    other = np.array([d] * 20 + [a] * 30 + [c] + [b] * 30 + [d] * 20)
    own = np.array([a] * 150 + [c] + [b] * 30)
    assert (120, 185, 20, 85) in substring.passages(own, other)


def test_passages_with_an_inserted_run_are_found():
    rng = np.random.default_rng(5)
    for length, run in ((90, 8), (90, 10), (90, 12), (80, 8), (80, 10), (94, 12), (300, 40)):
        ids = iter(rng.permutation(2**20).astype(np.uint64))
        take = lambda n: [next(ids) for _ in range(n)]
        for at in (length // 2, length // 3):
            # shingles over an edge differ, so a hole of run + 4 stands against one of 4
            head, tail = take(at - 4), take(length - 4 - at)
            own = np.array([*take(60), *head, *take(run + 4), *tail, *take(60)])
            other = np.array([*take(30), *head, *take(4), *tail, *take(90)])
            assert substring.passages(own, other) == [(60, 60 + length + run, 30, 30 + length)]
    apart = take(40), take(40)
    assert substring.passages(np.array([*apart[0], *take(60), *apart[1]]), np.array([*apart[0], *take(60), *apart[1]])) == []


def test_sliding_minima():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 99, 60)
    for width in (1, 2, 3, 7, 46):
        assert substring.sliding_minima(v, width).tolist() == [v[i : i + width].min() for i in range(60 - width + 1)]


def test_windows_are_the_nodes_of_the_cartesian_tree():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(n)) for n in (200, 3, 60, 54, 120)]
    for _, _, c in chunks(pa.array(texts)):
        key, own, place, stretches, sizes = substring.compact_windows(c, 50, 3)
        assert (substring.unpacked(substring.packed(place)) == place).all() and sizes.sum() == len(stretches) == len(c.grams(50)[0])
        h, at = c.grams(5)
        for k in range(c.n):
            v0 = h[c.doc[at] == k]
            expected = set()
            for f in range(3):
                a, b = seeds(2, 900 + 2 * f)
                v = ((v0 ^ b) * (a | np.uint64(1))).tolist()
                for i in range(len(v) - 45):
                    m = min(range(i, i + 46), key=lambda x: (v[x], x))
                    lo, hi = m, m
                    while lo > 0 and v[lo - 1] > v[m]:
                        lo -= 1
                    while hi + 1 < len(v) and v[hi + 1] >= v[m]:
                        hi += 1
                    expected.add((f, lo, m, hi))
            got = {(int(x) & 7, *p) for x, p in zip(key[own == k], place[own == k].tolist())}
            assert {x[:3:2] for x in got} == {x[:3:2] for x in expected}
            if len(set(v0.tolist())) == len(v0):
                assert got == expected


def test_agreements_are_passages_that_hold_enough_centres():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = rng.integers(1, 9)
        f, shift = rng.integers(0, 3, n), rng.choice([0, 0, 40], n)
        centre = rng.integers(10, 90, n)
        own = np.stack([centre - rng.integers(0, 30, n), centre, centre + rng.integers(0, 30, n)], 1)
        other = own + shift[:, None]

        def holds(k, i, j, side):
            return side[k, 0] <= i <= side[k, 1] <= j <= side[k, 2]

        expected = any(
            len({f[k] for k in range(n) if holds(k, i, i + 19, own)} & {f[k] for k in range(n) if holds(k, x, x + 19, other) and holds(k, i, i + 19, own)}) >= 2
            for i in range(0, 130)
            for x in (i, i + 40)
        )
        got = substring.agreements(f, own, other, 20, 2)
        assert bool(got) >= expected
        assert all(b - a >= 20 and d - c >= 20 for a, b, c, d in got)


@pytest.mark.parametrize("rows", [substring.PART_ROWS, 1])
def test_near_passages_are_found(spark, monkeypatch, rows):
    monkeypatch.setattr(substring, "PART_ROWS", rows)  # in parts or whole
    monkeypatch.setattr(substring, "SAMPLE", 2)
    rng = random.Random(5)
    docs, near = {}, set()
    for g in range(150):
        first = passages_of(rng, rng.choice([55, 60, 80, 120, 200]))
        second = list(first)
        for _ in range(max(1, len(first) // 60)):
            second[rng.randrange(5, len(first) - 5)] = f"changed{rng.randint(0, 10**9)}"
        a, b = (frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (first, second))
        docs[g] = passages_of(rng, rng.randint(10, 90)) + first + passages_of(rng, rng.randint(10, 90))
        docs[1000 + g] = passages_of(rng, rng.randint(10, 90)) + second + passages_of(rng, rng.randint(10, 90))
        if len(a & b) >= 0.8 * len(a | b):
            near.add(1000 + g)
    got = {r.doc_id for r in substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert len(got & near) >= 0.97 * len(near) > 100 and got <= {1000 + g for g in range(150)}


def test_texts_that_share_an_identifier_have_passages_of_their_own(spark):
    rng = random.Random(3)
    a, b, c = (passages_of(rng, 60) for _ in range(3))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join([*c, *a])), (3, " ".join(b)), (3, " ".join(b)), (4, " ".join(["z"] * 400)), (5, " ".join(["z"] * 300))]
    docs = documents(spark, rows).withColumnRenamed("lang", "cuts").withColumnRenamed("source", "k1")
    spans = substring.repeats(docs)
    kept = substring.without(docs, spans)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id, r.text) for r in kept.collect())
    assert (2, " ".join(b)) in left and (2, " ".join(c) + " ") in left and not any(i == 3 for i, _ in left) and (1, " ".join(a)) in left


def test_the_run_that_passages_at_the_threshold_share():
    assert substring.sure_run(50, 0.8) == 25 and substring.sure_run(50, 1.0) == 50
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(n)) for n in (300, 3, 25, 24, 60)]
    shared = passages_of(rng, 25)
    texts += [" ".join(passages_of(rng, 20) + shared + passages_of(rng, 30)), " ".join(shared), " ".join(["x"] * 60)]
    for _, _, c in chunks(pa.array(texts)):
        key, own, place = substring.anchors(c, 25)
        for k, t in enumerate(texts):
            w, at = words(t), set((place[own == k] >> 32).tolist())
            assert all(any(i <= p <= i + 16 for p in at) or len(set(w[i : i + 25])) < 25 for i in range(len(w) - 24)) and all(p + 9 <= len(w) for p in at)
        assert set(key[own == 6].tolist()) <= set(key[own == 5].tolist()) and (own == 7).sum() == 1 and not (own == 3).any()


def test_near_passages_of_least_length_are_all_found(spark):
    rng = random.Random(13)
    docs, near = {}, set()
    for g in range(700):
        first = passages_of(rng, 50)
        second = list(first)
        second[rng.choice([1, 2, 3, 20, 25, 29, 46, 47])] = f"changed{rng.randint(0, 10**9)}"
        a, b = (frozenset(tuple(x[i : i + 5]) for i in range(46)) for x in (first, second))
        assert len(a & b) >= 0.8 * len(a | b)
        docs[g], docs[1000 + g] = passages_of(rng, 40) + first + passages_of(rng, 40), passages_of(rng, 30) + second + passages_of(rng, 50)
        near.add(1000 + g)
    got = {r.doc_id: r for r in substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert set(got) == near and all(r.end_word - r.first_word >= 50 and r.kept_in == i - 1000 for i, r in got.items())


def test_near_passages_are_found_behind_documents_with_a_part(spark):
    rng = random.Random(14)
    docs, near = {}, set()
    for g in range(60):
        first = passages_of(rng, 60)
        second = list(first)
        second[rng.randint(24, 35)] = f"changed{rng.randint(0, 10**9)}"
        docs[g] = passages_of(rng, 70) + first[:40] + passages_of(rng, 80)  # under 45 words in a row: no passage
        docs[100 + g], docs[200 + g] = passages_of(rng, 50) + first + passages_of(rng, 60), passages_of(rng, 60) + second + passages_of(rng, 40)
        near.add(200 + g)
    got = {r.doc_id for r in substring.repeats(documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert got == near


def test_passages_against_all_pairs_of_runs():
    rng = np.random.default_rng(9)
    for runs in ((30, 15, 10, 10, 10), (30, 15, 8, 8), (10, 10, 30, 15, 10), (43,), (41,), (20, 21, 20), (12, 40, 12)):
        ids = iter(rng.permutation(2**20).astype(np.uint64))
        take = lambda n: [next(ids) for _ in range(n)]
        own, other, at = take(60), take(30), []
        for n in runs:
            same = take(n)
            at.append((len(own), len(own) + n))
            own += [*same, *take(5)]
            other += [*same, *take(5)]
        own, other = np.array(own + take(60)), np.array(other + take(60))
        best = [(a, b) for i, (a, _) in enumerate(at) for j, (_, b) in enumerate(at) if i <= j and sum(runs[i : j + 1]) >= 0.8 * (2 * max(46, b - a) - sum(runs[i : j + 1]))]
        got = substring.passages(own, other)
        assert best and all(any(x <= a and b + 4 <= y for x, y, _, _ in got) for a, b in best), runs
        assert all(y - x >= 50 and len(np.intersect1d(own[x : y - 4], other[z : w - 4])) >= 0.8 * len(np.union1d(own[x : y - 4], other[z : w - 4])) for x, y, z, w in got)


def test_stretches_are_made_once(spark, monkeypatch):
    made, cut = [], substring.runtime.cut

    def seen(df, *a):
        made.append(df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(stretches"))
        return cut(df, *a)

    monkeypatch.setattr(substring.runtime, "cut", seen)
    monkeypatch.setattr(substring, "PART_ROWS", 8)
    monkeypatch.setattr(substring, "SAMPLE", 1)
    rng = random.Random(2)
    shared = passages_of(rng, 58)
    substring.repeats(documents(spark, [(i, " ".join(passages_of(rng, 60) + shared)) for i in range(40)]))
    assert max(made) == 1 and sum(made) == 2  # the second for groups in parts only


def test_runs_of_a_chain_are_compared_once(monkeypatch):
    tried, widened = [], substring._widened

    def seen(*a):
        tried.append(a[-3])
        return widened(*a)

    monkeypatch.setattr(substring, "_widened", seen)
    rng, found = np.random.default_rng(5), 0
    for size, length, changes in ((6, 100, 14), (8, 150, 20), (400, 300, 30), (2**20, 300, 24)) * 4:
        base = rng.integers(0, size, length).astype(np.uint64)
        own, other = base.copy(), base.copy()
        for x, new in ((own, 2**30), (other, 2**31)):
            for i, at in enumerate(rng.choice(length - 4, changes // 2, replace=False)):
                x[at : at + rng.integers(1, 5)] = new + i
        tried.clear()
        found += len(substring.passages(own, other))
        assert len(tried) == len(set(tried)) <= length
    assert found


def test_shuffle_files_go_once_their_table_is_written(spark, monkeypatch):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rng, cut, left = random.Random(4), substring.runtime.cut, {}

    def files():
        all_ = disk.getAllFiles()
        return {all_.apply(i).getName() for i in range(all_.size()) if all_.apply(i).getName().startswith("shuffle_")}

    def seen(df, *a):
        left[tuple(df.columns)] = files()  # what there is when the next table is made
        return cut(df, *a)

    monkeypatch.setattr(substring.runtime, "cut", seen)
    monkeypatch.setattr(substring.runtime, "free", lambda _: None, raising=False)  # not left to the garbage's collector
    shared = passages_of(rng, 58)
    substring.repeats(documents(spark, [(i, " ".join(passages_of(rng, 60) + shared)) for i in range(40)]))
    before, after = (next(v for k, v in left.items() if x in k) for x in ("lead", "both"))
    assert len(after - before) == 0

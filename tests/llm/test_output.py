"""Mixing, packing, shards, urls, top-k."""

from __future__ import annotations

import io
import itertools
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.llm import mixing, packing, queries, runtime, sst, textcore, tokens, topk, urls

from .brute import DOCS, documents, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    ours, twin = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns) and len(ours)
    key = sorted(ours.columns)
    assert Counter(map(tuple, ours[key].values.tolist())) == Counter(map(tuple, twin[key].values.tolist()))


def plain_targets(sizes: dict, most: int = 3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} | capped
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    names = ["a", "b", "c", "d", None, "é", "z", "empty"]
    rows = [(i, None if i % 50 == 0 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), "en", rng.choices(names[:-1], [30, 1, 5, 1, 2, 3, 9])[0]) for i in range(3000)]
    rows += [(9000, "", "en", "empty"), (None, "a b", "en", "a"), (1, rows[1][1], "en", rows[1][3]), (9001, "t " * 3000, "en", "b")]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    expected = plain_targets(sizes)
    taken, by_id = Counter(), {r[0]: r for r in rows}
    for g in got:
        source = by_id[g.doc_id][3]
        assert g.size == len(words(by_id[g.doc_id][1])) and g.source_size == sizes[source]
        assert abs(g.target - expected[source]) < 1e-6 * max(1, expected[source])
        assert 0 <= g.taken <= 3 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[source] += g.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(40, 3000 if s == "b" else 0)
    again = {(g.doc_id, g.taken) for g in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(g.doc_id, g.taken) for g in got}
    copies = Counter(r.doc_id for r in mixing.sample(docs).collect())
    assert all(copies[g.doc_id] * g.size == g.taken * (2 if g.doc_id == 1 else 1) for g in got if g.size)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None)])).collect()] == [0]


def test_mix_of_many_sources_is_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "a", "a", None, "b", "c"])) for i in range(400)]
    docs = documents(spark, rows)
    got = []
    for few in (mixing.FEW, 1):
        monkeypatch.setattr(mixing, "FEW", few)
        got.append((sorted(map(tuple, mixing.mix(docs).collect())), sorted(r.doc_id for r in mixing.sample(docs).collect())))
    assert got[0] == got[1]


def least(items: list[int], capacity: int) -> int:
    best, items = [len(items)], sorted(items, reverse=True)

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[k]
                go(k + 1, bins)
                bins[j] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([7, 10, 24]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_small_packings_are_least(case):
    capacity, items = case
    plan = packing.solve(dict(Counter(items)), capacity)
    assert Counter(x for p, n in plan for x in p for _ in range(n)) == Counter(items)
    assert all(sum(p) <= capacity for p, _ in plan)
    assert sum(n for _, n in plan) == least(items, capacity)


def least_of_counts(counts: dict[int, int], capacity: int) -> int:
    """By all patterns and all remainders."""
    lengths = sorted(counts)
    patterns = [p for p in itertools.product(*(range(capacity // x + 1) for x in lengths)) if 0 < sum(x * k for x, k in zip(lengths, p)) <= capacity]
    patterns = [p for p in patterns if all(sum(x * k for x, k in zip(lengths, p)) + x > capacity for x in lengths)]
    best = np.full([counts[x] + 1 for x in lengths], 10**9)
    best[(0,) * len(lengths)] = 0
    for at in itertools.product(*(range(n + 1) for n in best.shape and [counts[x] for x in lengths])):
        for p in patterns:
            if any(at):
                best[at] = min(best[at], 1 + best[tuple(max(0, a - k) for a, k in zip(at, p))])
    return int(best[tuple(counts[x] for x in lengths)])


@pytest.mark.parametrize("counts, capacity", [({3: 40, 4: 33, 5: 21}, 10), ({2: 30, 5: 40, 7: 25}, 12), ({4: 50, 6: 31, 9: 30}, 19), ({6: 65, 7: 9, 11: 20}, 24), ({5: 1, 8: 70, 9: 40}, 25)])
def test_packings_of_more_pieces_are_least(counts, capacity):
    plan = packing.solve(counts, capacity)
    used = Counter()
    for p, n in plan:
        assert sum(p) <= capacity
        for x in p:
            used[x] += n
    assert used == Counter(counts)
    assert sum(n for _, n in plan) == least_of_counts(counts, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold_and_fillings_are_undominated(items):
    assert packing.least_bins(dict(Counter(items)) or {1: 0}, 20) <= least(items, 20)
    counts = dict(Counter(items))
    lengths = sorted(counts)
    found = list(packing.fillings(20, counts, lengths))
    waste = [20 - sum(x) for x in found]
    assert waste == sorted(waste) and len(set(found)) == len(found) and min(waste) >= 0
    for f, w in zip(found, waste):
        assert all(counts[x] == f.count(x) or x > w for x in counts)
    every = {sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= 20}
    assert min(waste) == 20 - max(every)


def test_large_packings_have_few_patterns_and_little_waste():
    counts = {x: 10**9 + 7 * x for x in range(1, 1025)}
    plan = packing.solve(counts)
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 1024
        for x in p:
            used[x] += n
    assert used == Counter(counts) and len(plan) < 4096
    assert sum(n for _, n in plan) <= 1.01 * packing.least_bins(counts, 1024)


def some_texts() -> list[tuple]:
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    rows = [(i * 3, " ".join(word() + rng.choice(["", "", ".", ",", "!?"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    return [*rows, (-5, None), (1000, ""), (1001, "  two\t\tblanks \n\n"), (1002, "z " * 9000), (None, "no name"), (3, rows[1][1]), (3, rows[1][1]), (1003, "<|endoftext|> it's\x00 \u3000x")]


def ids_of(text: str | None) -> np.ndarray:
    return np.array([*tokens.encoder()._tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é\n\t .,!'\u3000\xa0\x85\x00日»", max_size=20)), max_size=6))
def test_parts_give_the_librarys_identifiers(texts):
    got = [x for _, found in tokens.encoder().encode(pa.array(texts, pa.string())) for x in found]
    assert [x.tolist() for x in got] == [ids_of(t)[:-1].tolist() for t in texts]


def test_pack(spark):
    rows = some_texts()
    got = packing.pack(documents(spark, rows).withColumnRenamed("n_chars", "length")).toPandas()
    by = {r[0]: ids_of(r[1]) for r in rows}
    assert got.length.sum() == sum(len(ids_of(r[1])) for r in rows)
    for r in got.itertuples():
        own = by[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        assert r.length == 1024 or r.piece == 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = g.offset + g.length
        assert g.offset.iloc[0] == 0 and (g.offset.iloc[1:].values == ends.iloc[:-1].values).all() and ends.iloc[-1] <= 1024
    n = got.sequence_id.nunique()
    assert n == -(-got.length.sum() // 1024)
    assert packing.pack(documents(spark, [])).count() == 0


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    real = textcore.Chunk.hashes
    monkeypatch.setattr(textcore.Chunk, "hashes", lambda self, a, z: real(self, a, z) % np.uint64(7))
    texts = ["one two three, four", "five six", "seven eight nine ten eleven", "one two"]
    encoder = tokens.Encoder(tokens.VOCABULARY)
    for _ in range(2):
        got = [x for t in ([texts[0]], texts, texts[::-1]) for _, found in encoder.encode(pa.array(t)) for x in found]
        assert [x.tolist() for x in got] == [ids_of(x)[:-1].tolist() for x in (texts[0], *texts, *texts[::-1])]


def test_checks_tell_ranges_apart_wherever_they_stand(monkeypatch):
    a, b = (next(textcore.chunks(pa.array([x])))[2] for x in ("abc" * 300_000 + "xyz end", "xyz"))
    n = len(a.data)
    assert a.checks(np.array([n - 7]), np.array([n - 4])) == b.checks(np.array([0]), np.array([3]))
    assert len(set(a.checks(np.arange(0, 60), np.arange(0, 60) + 2).tolist())) == 3


def test_shards_round_trip_and_lookup(spark, tmp_path):
    rows = some_texts()
    shards = sst.write(documents(spark, rows), f"file://{tmp_path}/sst", 3)
    got = sst.read(shards).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for r in order:
        own = ids_of(r[1])
        expected.append((r[0], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert [tuple(g) for g in got] == expected
    readers = [sst.open_shard(r.uri) for r in shards.collect()]
    for doc_id, n in ((1002, 1), (3, 3), (None, 1), (4, 0), (10**12, 0)):
        found = [x for reader in readers for x in reader.get(doc_id)]
        assert len(found) == n and all(np.array_equal(x, ids_of(dict(rows)[doc_id])) for x in found)
    assert sst.export(documents(spark, [])).count() == 0


def test_shards_roll_over_and_split_one_identifier(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, " ".join(str(rng.randint(0, 10**9)) for _ in range(30))) for _ in range(400)] + [(None, f"x {i}") for i in range(50)] + [(i, "tail") for i in range(8, 30)]
    folder = f"file://{tmp_path}/sst"
    files = sst.write(documents(spark, rows), folder, 4, roll=20_000)
    n = files.agg({"n_docs": "max"}).collect()[0][0]
    assert files.count() > 4 and n < 200 and files.where("n_docs > 0 and shard > 0").count()
    (tmp_path / "sst" / "other.sst").write_bytes(b"")
    (tmp_path / "sst" / "mine-left.sst").write_bytes(b"")
    sst._tidy(folder, "mine", set())
    assert (tmp_path / "sst" / "other.sst").exists() and not (tmp_path / "sst" / "mine-left.sst").exists()
    got = sst.read(files).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((d, zlib.crc32(ids_of(t).tobytes())) for d, t in rows)
    assert sum(len(sst.open_shard(r.uri).get(7)) for r in files.collect()) == 400


def test_shard_blocks_and_wide_identifiers():
    out = io.BytesIO()
    writer = sst.Writer(out)
    for k in range(-500, 500):
        writer.add(sst.key_of(k), np.arange(k + 500, dtype=np.uint32) + (70_000 if k % 2 else 0))
    writer.close()
    reader = sst.Reader(out)
    assert len(reader.index) > 3 and reader.n_docs == 1000
    assert [sst.id_of(k) for k, _ in reader] == list(range(-500, 500))
    assert reader.get(7)[0].tolist() == (np.arange(507) + 70_000).tolist() and reader.get(500) == []
    assert [k for k, _ in reader.block(1)][0] == reader.index[1][0]


def plain_url(url: str | None) -> tuple:
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    rng = random.Random(3)
    fixed = [None, "", "no scheme/a", "http://", "HTTP://A.NET", "http://a.net/", "http://É.Net/x?y#z", "http://a.net?x=/b", "http://example.com/de/1", "http://x.example.com/de/1", "http://notexample.com/de/1", "http://example.net/en/a/b/c/d/e/f", "a://b://c/d", "http://h.org/fr/\nx", "http://h.org//fr/", "https://u@h.net:80/p#q/r"]
    made = [f"http://{rng.choice(['a', 'b.c'])}.{rng.choice(['net', 'org', 'com', 'example.net'])}/{rng.choice(['en', 'fr', 'de', 'x'])}/{rng.randint(0, 99)}{rng.choice(['', '.html', '/', '?q'])}" for _ in range(300)]
    rows = list(enumerate(fixed + made)) + [(3, fixed[3]), (None, "http://a.net/z")]
    got = urls.judge(spark.createDataFrame([(*r, "t", "html") for r in rows], "page_id long, url string, template string, html string"), rules=None).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, r)
    for page_id, url in rows:
        host, path, rule = plain_url(url)
        r = by[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == urls.RULES[rule] if rule else r.verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else 'blog'}/{i}.html") for i in range(200)]
    rows += [(1000 + i, f"http://many.com/user{chr(97 + i % 26)}{chr(97 + i // 26)}/post") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(0, 60)], "page_id long, bad boolean")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, rules={}, labelled=labels).collect()}
    assert {got[i].verdict for i in range(1, 200, 2)} == {"block"} and {got[i].verdict for i in range(0, 200, 2)} == {"allow"}
    assert got[1].template == "/spam/*.html"
    assert {got[1000 + i].template for i in range(300)} == {"/*/post"}  # many rare siblings are one wildcard


def test_an_unruled_branch_inherits_the_verdict_of_its_look_alikes(spark, tmp_path, monkeypatch):
    ends = ["", "", ".html"]
    rows = [(i, f"http://h.example.com/{('de', 'xx', 'odd')[i % 3]}/{'q/' * 2 if i % 3 == 2 else ''}{i}{ends[i // 3 % 3]}") for i in range(300)]
    rows += [(1000 + i, f"http://ok.org/{('fr', 'yy')[i % 2]}/{i}{ends[i // 2 % 3]}") for i in range(100)]
    rows += [(2000 + i, f"http://mixed.{('org/fr', 'org/zz')[i % 2]}/{i}") for i in range(100)]
    spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, template string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for hot in (urls.HOT, 0):  # joined by a broadcast, and by a shuffle
        monkeypatch.setattr(urls, "HOT", hot)
        got = {r.page_id: r for r in queries.queries()["op8_url_filters"](spark, str(tmp_path)).collect()}
        assert len(got) == len(rows)
        assert {(got[i].rule, got[i].verdict, got[i].template.split("/")[1]) for i in range(1, 300, 3)} == {(None, "block", "de|xx")}
        assert {(got[i].verdict, got[i].bad_share) for i in range(2, 300, 3)} == {("allow", 0.2)}  # not alike below
        assert {(r.verdict, r.bad_share < 0.1) for i, r in got.items() if i >= 1000} == {("allow", True)}


def test_branches_with_other_contents_or_verdicts_stay_apart(spark):
    rows = [(i, "h", [("a", "b", "c")[i % 3], "x" if i % 3 < 2 or i % 2 else "y"], {0: True, 1: False}.get(i % 3)) for i in range(600)]
    got = {r.template for r in urls.templates(spark.createDataFrame(rows, "id long, host string, shape array<string>, bad boolean")).collect()}
    assert got == {"/a/x", "/b/x", "/c/x", "/c/y"}


def test_no_plan_of_the_tree_holds_more_than_a_level(spark, monkeypatch):
    scans = []
    cut = urls.runtime.cut
    monkeypatch.setattr(urls.runtime, "cut", lambda df, *spent: (scans.append(df._jdf.queryExecution().analyzed().toString().count("Relation")), cut(df, *spent))[1])
    urls.judge(spark.createDataFrame([(1, "http://a.com/x/y/1")], "page_id long, url string")).count()
    assert max(scans) <= 10


def plain_top(rows: list[tuple], k: int = 5) -> Counter:
    ok = [(v, np.floor(256 * np.array(x, np.float64))) for v, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    out = Counter()
    for i, (q, x) in enumerate(ok):
        if q is None or q % 50:
            continue
        scored = []
        for j, (v, y) in enumerate(ok):
            if j != i:
                n = min(len(x), len(y))
                scored.append((-sum(int(a) * int(b) for a, b in zip(x[:n], y[:n])), v is None, v or 0))
        for place, (s, lost, v) in enumerate(sorted(scored)[:k]):
            out[(q, place + 1, None if lost else v, -s)] += 1
    return out


def test_top_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "WORTH", 64)
    monkeypatch.setattr(topk, "QUERY_BYTES", 32)
    monkeypatch.setattr(topk, "BLOCK", (3, 50))
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.round(rng.normal(0, 0.3, 8), 1)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(120)]  # one common vector: ties
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[0][1]), (50, rows[50][1]), (950, []), (951, [0.5] * 3)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = Counter(tuple(r) for r in topk.top(frame).collect())
    exact = [(v, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for v, x in rows]
    assert got == plain_top(exact)
    assert Counter(tuple(r) for r in topk.top(frame, lists=3).collect()) == plain_top(exact)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top(few.where("false")).count() == 0 and topk.top(few.where("vec_id = 0")).count() == 0


def test_lists_send_few_of_all_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(2000)]
    got = topk.phases(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    pairs = 40 * 1999
    assert got.open.count() <= got.entries.count() < 0.1 * pairs
    assert Counter(map(tuple, got.placed.collect())) == plain_top(rows)


def test_scores_are_exact_beyond_doubles(spark):
    q = np.array([[2.0**29, 1.0]])
    assert topk.scores(q, q, 1 << 61).tolist() == [[2**58 + 1]]
    assert topk.scores(2.0**20 * q, q, 1 << 60).tolist() == [[1 << 60]]
    rows = [(0, [2.0**20, 1.0, 0.5]), (1, [2.0**20, 0.0, 1.0]), (2, [2.0**20, 0.0, 0.25]), (3, [-1.0, 5.0, 3.0]), (50, [2.0**20, 1.0, 2.0])]
    assert Counter(map(tuple, topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == plain_top(rows)
    assert DOCS


def test_tables_that_are_spent_go(spark, monkeypatch):
    first = runtime.cut(spark.range(3).toDF("a"))
    second = runtime.cut(first.selectExpr("a + 1 as a"), (first,))
    assert second.count() == 3 and not Path(first._skyframe_at.removeprefix("file://")).exists()
    home = Path(second._skyframe_at.removeprefix("file://"))
    monkeypatch.setattr(runtime, "_home", lambda spark: second._skyframe_at)
    runtime.clear(spark)
    assert not home.exists()


def test_a_cluster_must_name_a_shared_folder():
    class Unset:
        def get(self, *_):
            return None

    class Session:
        conf = Unset()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return Unset()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())

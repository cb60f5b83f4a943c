"""Stages in order, each on all that its predecessor kept."""

from __future__ import annotations

import random

import corpus_pipeline
from skyframe.llm import packing

from .brute import documents


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "an"]) for _ in range(3)) + str(rng.randint(0, 10**6))
    text = [[word() for _ in range(rng.randint(60, 120))] for _ in range(30)]
    shared = [word() for _ in range(70)]
    text[4], text[8] = text[4] + shared, shared + text[8]
    text[12] = [*text[3][:-1], "changed"]
    rows = [(i, " ".join(w), "en", f"s{i % 2}") for i, w in enumerate(text)] + [(100, "123 456", "en", "s0"), (101, None, "en", "s0"), (102, " ".join(text[5]), "en", "s1")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    language, copies, passages, mixed, packed = kept
    assert all(d.columns == names for d in kept[:-1])
    assert {r.doc_id for r in language.collect()} == set(range(30)) | {102}
    assert {r.doc_id for r in copies.collect()} == set(range(30)) - {12}
    cut = {r.doc_id: r for r in passages.collect()}
    assert set(cut) == set(range(30)) - {12}
    assert cut[8].text == " ".join(text[8][70:]) and cut[8].n_chars == len(cut[8].text)
    assert all(cut[i].text == " ".join(text[i]) for i in cut if i != 8)
    assert set(map(tuple, mixed.select("doc_id", "text").collect())) <= {(i, r.text) for i, r in cut.items()}
    assert packed.groupBy("doc_id").count().count() == mixed.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert packed.agg({"length": "sum"}).collect()[0][0] == packing.pieces(mixed).agg({"length": "sum"}).collect()[0][0]


def test_stages_on_clashing_columns_nulls_ties_and_empty_tables(spark, tmp_path):
    rng = random.Random(4)
    text = [" ".join(f"ther{rng.randint(0, 10**6)}ing" for _ in range(70)) for _ in range(4)]
    rows = [(1, text[0], "en", "a"), (1, text[0], "en", "a"), (2, text[1], None, None), (2, text[2], "en", "b"), (3, text[2], "en", "b"), (None, text[3], "en", "a"), (5, None, "en", "a"), (6, "", "en", "a"), (7, text[3] + " " + text[0], "en", "a")]
    clash = ("_id", "_cuts", "_row", "_size", "k1", "row", "part", "node", "whole", "sequence_id", "size", "lang_pred", "score", "class_id", "cuts")
    docs = documents(spark, rows)
    for x in clash:
        docs = docs.withColumn(x, docs.doc_id)
    for n, table in enumerate((docs, docs.where("false"), docs.where("text is null"))):
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, str(tmp_path))
            table.write.parquet(f"{tmp_path}/{n}{name}")
            table = spark.read.parquet(f"{tmp_path}/{n}{name}")
            if name != "best_fit_packing":
                assert table.columns == docs.columns
            if name == "jaccard_join" and not n:
                assert sorted((r.doc_id or 0, r.text) for r in table.collect()) == sorted([(0, text[3]), (1, text[0]), (2, text[1]), (2, text[2]), (7, rows[8][1])])
            if name == "substring_dedup" and not n:
                assert (7, text[3] + " ") in {(r.doc_id, r.text) for r in table.collect()}
        assert (table.count() > 0) == (n == 0)

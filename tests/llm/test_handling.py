"""Odd columns, repeated rows and small tables, for the operators that had trouble with them."""

import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import bpe, decontaminate, entries, html_text, licenses, near_dedup, packing, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(scored, labels, label, modulus, out):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = [(truth[r.doc_id], r.predicted) for r in scored.collect() if truth.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == out]
    return [sum(p == y for t, p in rows if t == y) / max(1, sum(t == y for t, _ in rows)) for y in (0, 1)]


def test_quality_rejects_on_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    low, good = held_out(quality.report(docs, labels), labels, "quality", 5, 0)
    assert low > 0.8 and good > 0.97
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).select("doc_id").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    bad = [i for i, q in truth.items() if q == 0]
    assert sum(i in kept for i in bad) < 0.2 * len(bad) and sum(i in kept for i, q in truth.items() if q == 1) > 0.97 * sum(q == 1 for q in truth.values())


def test_toxicity_on_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean, toxic = held_out(toxicity.report(docs, labels), labels, "toxic", 4, 2)
    assert clean > 0.9 and toxic > 0.4  # a few labelled rows make a poor dictionary


def test_columns_with_dots_and_maps(spark):
    rows = spark.createDataFrame([(1, "some words of a text that goes on", 7, {"k": 1}), (1, "some words of a text that goes on", 7, {"k": 1}), (2, "another one", 8, None)], "doc_id long, text string, `a.b` int, m map<string,int>")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    benchmark = spark.createDataFrame([("i", "another one")], "item_id string, text string")
    got = lambda df: sorted((r.doc_id, r["a.b"]) for r in df.collect())
    whole = [(1, 7), (1, 7), (2, 8)]
    assert got(quality.keep_good(rows, None)) == got(toxicity.keep_ordinary(rows, None)) == whole
    assert got(decontaminate.decontaminate(rows, benchmark)) == whole[:2]
    assert got(near_dedup.deduplicate(rows)) == [(1, 7), (2, 8)]
    assert got(toxicity.keep_ordinary(rows, toxicity.fit(docs, labels))) == whole
    path, pattern = bpe.vocabulary()
    tokenizer = bpe.Tokenizer(spark, bpe.read_ranks(spark, path), pattern)
    out = tokenizer.encode(rows.drop("m"))
    assert out.columns == ["doc_id", "text", "a.b", "ids"] and got(out) == whole
    tokenizer.close()


def test_packing_of_equal_rows_and_decimal_ids(spark):
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(spark, path)
    rows = spark.range(600).select(F.lit(Decimal("12.50")).cast("decimal(10,2)").alias("doc_id"), F.lit("the very same text " * 5).alias("text"))
    packed = packing.pack(rows, ranks=ranks, pattern=pattern, row=64, shard_bytes=6_000)
    tokens = packed.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(tokens) >= 8 and max(r.n for r in tokens) < 0.3 * sum(r.n for r in tokens)
    assert {s.doc_id for r in packed.select("segments").collect() for s in r.segments} == {Decimal("12.50")}


def extract(page):
    return html_text.extract(page, set()).split("\n")


def test_html_of_articles():
    inside = "<body><main><p>A<div class=ad-slot>x</div><div class='comments-list big'>x</div><div class=notice>x</div><div class=banner>x</div><p class=social>B<p id=newsletter>C<p class=ad>x<div class=post-header>D</div><p class=share-price>E<div class=has-sidebar>F</div></main>"
    assert extract(inside) == ["A", "B", "C", "D", "E", "F"]
    assert extract("<body><div class=top-nav>x</div><h1>T</h1><p class=lead>L</p><article><p>A</article><p>x") == ["T", "L", "A"]
    assert extract("<body><h1>Site</h1><ul><li>x</ul><article><h1>T</h1><p>A</article>") == ["T", "A"]
    assert extract("<body><h1>T</h1><ul><li>x</ul><p>x<article><p>A</article>") == ["T", "A"]


def test_negated_licenses():
    labels = lambda text: [x[2] for x in licenses.rules().scan(text.encode())[1]]
    assert labels("this is not licensed under the gpl") == labels("in the public domain name system") == labels("neither mit nor bsd license") == []
    assert labels("licensed under the gpl, not the mit license") == ["gpl"] and labels("this work is in the public domain") == ["public-domain"]
    assert labels("if not, see the gnu general public license version 3") == ["gpl-3"]
    assert labels("you may not use this file except in compliance with the apache license version 2.0") == ["apache-2"]


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_top_k", "op9_url_rules"])
def test_sql_keeps_repeated_rows(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(60)
        more = rows.limit(8) if t != "benchmark" else rows.limit(3).withColumn("item_id", F.lit(None).cast(rows.schema["item_id"].dataType))
        rows.unionByName(more).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want, got = con.sql(entries.oracle_sql()[name]), entries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())

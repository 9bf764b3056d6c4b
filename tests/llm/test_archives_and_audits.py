"""Archives, whitening and source divergence against plain versions; repeated rows of the tokenizer."""

import gzip
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from orderflow.llm import bpe, divergence, entries, warc, whitening

D = "/root/testdata/sf0.001"


# Tokenizer


def encoding():
    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(None, path), special_tokens={})


def test_bpe_takes_repeated_rows(spark, tmp_path):
    enc, digest = encoding(), lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    texts = ["the same words again and again", "", "naïve façade 12345"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for i in (0, 1):
        rows.where("doc_id = 0").write.parquet(f"{tmp_path}/one/{i}")
    two_files = spark.read.parquet(f"{tmp_path}/one/0", f"{tmp_path}/one/1")
    for frame, times in ((rows.union(rows), 2), (two_files, 2)):
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(frame).collect())
        ids = {r.doc_id: enc.encode_ordinary(texts[r.doc_id]) for r in frame.collect()}
        assert got == {(k, len(v), digest(v), hashlib.sha256(texts[k].encode()).hexdigest()): times for k, v in ids.items()}


def test_bpe_takes_a_long_run_of_one_row(spark):
    text = "one and the same line of a long text, " * 30_000  # 40 rows are several chunks
    rows = spark.range(40).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text")).coalesce(1)
    ids = encoding().encode_ordinary(text)
    got = {(r.n_tokens, r.ids_sha256) for r in bpe.report(rows).collect()}
    assert got == {(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())} and bpe.report(rows).count() == 40


# Archives

BIG = "<p>" + "x" * 120
PAGES = [
    (1, "http://a/x", BIG), (2, "http://b/", BIG), (3, "http://c", BIG), (3, "http://c", BIG), (4, None, "small"), (5, "http://a/5", "small"), (6, "http://d", None), (7, "http://e", ""),
    (8, "http://f/\r\nWARC-Type: response\r\n x é", "y" * 100), (9, "http://g", "y" * 100), (10, "http://h", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (None, "http://i", BIG), (12, "http://j", "é中" * 40), (-5, "http://k", "é中" * 40), (13, "http://l", "z" * 99), (14, "http://m", "z" * 99),
]


def plain_archive(pages):
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for key, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 100 and key is not None and key > first[html or ""]
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return Counter(out)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(pages.repartition(3)).collect())
    assert got == plain_archive(PAGES)
    assert warc.report(pages.limit(0)).count() == 0
    assert warc.report(pages.withColumn("page_id", F.col("page_id").cast("string"))).count() == len(PAGES)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_records_hold_everything(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    at = str(tmp_path / "w")
    warc.write(pages, at, compression=compression)
    records = warc.read(spark, at)
    assert records.where("error is not null").count() == 0
    assert {r.record_type: r.n for r in records.groupBy("record_type").agg(F.count("*").alias("n")).collect()} == {"request": 16, "metadata": 16, "response": 11, "revisit": 5}
    captures = warc.assemble(records).collect()
    assert len(captures) == len(PAGES) and all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    bodies = Counter(bytes(c.response.block) for c in captures if c.response.record_type == "response")
    assert bodies[BIG.encode()] == 2 and bodies[PAGES[10][2].encode()] == 1
    assert {c.target_uri for c in captures} >= {"http://f/%0D%0AWARC-Type:%20response%0D%0A%20x%20é", None}


def test_warc_reads_other_archives(spark, tmp_path):
    def record(kind, name, *to, block=b"", http=False):
        fields = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", *[b"WARC-Concurrent-To: <" + t + b">" for t in to], b"Content-Type: " + (b"application/http" if http else b"text/plain"), b"Content-Length: %d" % len(block)]
        return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"

    answer = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody\r\n\r\n"
    one = [record(b"warcinfo", b"i"), record(b"metadata", b"m2", b"m1"), record(b"metadata", b"m1", b"q"), record(b"request", b"q", b"r"), record(b"request", b"lost", b"nowhere")]
    two = [record(b"response", b"r", block=answer, http=True), record(b"response", b"s", b"sq", block=answer, http=True), record(b"request", b"sq")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "two.warc").write_bytes(b"".join(two) + b"WARC/1.0\r\nno length\r\n\r\n" + two[0])
    records = warc.read(spark, str(tmp_path))
    assert records.where("error is not null").count() == 1
    got = {c.capture_id: c for c in warc.assemble(records).collect()}
    assert set(got) == {"<r>", "<s>", "<lost>"} and got["<lost>"].response is None
    assert [m.record_id for m in got["<r>"].metadata] == ["<m1>", "<m2>"] and [q.record_id for q in got["<r>"].requests] == ["<q>"]
    assert [q.record_id for q in got["<s>"].requests] == ["<sq>"] and (got["<s>"].response.http_status, bytes(got["<s>"].response.block)) == (404, b"body\r\n\r\n")


# Whitening


def plain_whitening(vectors, k=4):
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in rows)
    rows = [(i, tuple(x + [0] * (dims - len(x)))) for i, x in rows]
    fit = np.array(sorted({x for _, x in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    away = (n * fit - sums).astype(np.float64) / n
    e, v = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-e)[:k]
    return rows, n, sums, e[order], v[:, order], e.sum()


def check_whitening(got, vectors):
    rows, n, sums, e, v, trace = plain_whitening(vectors)
    assert len(got) == len(rows) * len(e)
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    want = Counter((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in rows)
    for c in range(1, len(e) + 1):
        assert Counter((r.vec_id, r.n, r.deviation) for r in by[c]) == want
        assert all(abs(r.explained - e[c - 1] / trace) <= 1e-9 and r.identity_error < 1e-9 for r in by[c])
    for c in range(1, len(e) + 1):
        place = lambda i: (i is None, i or 0)
        plain = sorted((*place(i), float(np.dot(np.array([n * a - s for a, s in zip(x, sums, strict=True)], dtype=np.float64) / n, v[:, c - 1]) / np.sqrt(e[c - 1]))) for i, x in rows)
        mine = lambda sign, c=c: sorted((*place(r.vec_id), sign * r.whitened) for r in by[c])
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(mine(sign), plain, strict=True)) for sign in (1, -1))


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=7) * [3, 2, 1.5, 1, 0.4, 0.2, 0.1] + 5).tolist()) for i in range(300)]
    vectors += [vectors[4], vectors[4], (900, vectors[5][1]), (None, vectors[6][1]), (901, None), (902, [1.0, None, 2.0]), (903, [float("nan")] * 7), (904, [float("inf")] + [0.0] * 6), (905, [1.5, -2.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<double>, x string")
    check_whitening(whitening.report(frame.repartition(37)).collect(), vectors)


def test_whitening_of_few(spark):
    made = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.report(made([(1, [1.0])]).limit(0)).count() == whitening.report(made([(1, []), (2, None)])).count() == 0
    one = whitening.report(made([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    line = whitening.report(made([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1, 2, 3} and all(r.whitened == 0.0 for r in line if r.component > 1)
    assert abs(sum(r.whitened**2 for r in line if r.component == 1) / 5 - 1) < 1e-9
    wide = whitening.report(spark.createDataFrame([(i, [1e15 * i, float(i)]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in wide if r.vec_id != 1} == {None} and {r.deviation for r in wide if r.vec_id == 1} == {0}


@pytest.mark.parametrize("dims", [1, 2, 9, 30])
def test_rank_one_updates(dims):
    rng = np.random.default_rng(dims)
    x = np.floor(256 * rng.normal(size=(80, dims)) * np.linspace(0.1, 2, dims))
    x[::7] = x[0]  # repeats, and equal eigenvalues at the start
    a, b = whitening.Spectrum(dims), whitening.Spectrum(dims)
    for k, row in enumerate(x):
        (a if k < 50 else b).add(row)
    a.merge(b)
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    assert np.abs(a.q @ np.diag(a.d) @ a.q.T - scatter).max() < 1e-11 * np.abs(scatter).max() and np.abs(a.q.T @ a.q - np.eye(dims)).max() < 1e-12


# Divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(docs, least, most):
    words = [(la or "", so or "", TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for la, so, t in docs]
    out = []
    for lang in {w[0] for w in words}:
        seen, total, by = Counter(), Counter(), defaultdict(Counter)
        for la, so, terms in words:
            if la == lang:
                seen.update(set(terms))
                total.update(terms)
                by[so].update(terms)
        kept = [t for t in seen if seen[t] >= least]
        p = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, of = p(total), {so: p(c) for so, c in by.items()}
        for so in by:
            pairs = sorted(((sum(abs(of[so][t] - of[o][t]) for t in kept), o) for o in by if o != so), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((of[so][t] - q[t], t) for t in kept if by[so][t] > 0 and of[so][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, so, part, item, value, k) for part, rows in (("pair", pairs), ("term", terms[:most])) for k, (value, item) in enumerate(rows, 1)]
    return Counter(out)


def test_divergence_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "中文", "a", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "x" * 40, "x" * 41, "1no", "under_score"]
    docs = [(["en", "de", None, "one"][k % 4], None if k % 11 == 0 else f"s{k % 5}", None if k % 13 == 0 else " \x7f;".join(rng.choice(vocabulary, rng.integers(0, 15)))) for k in range(160)]
    docs += [("lone", "only", "alpha beta"), ("bare", "s1", "777"), ("bare", "s2", ""), *docs[:6]]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "lang string, source string, text string, n int, term string")
    for least, most in ((1, 3), (12, 50), (1000, 50)):
        got = Counter(tuple(r) for r in divergence.divergence(frame.repartition(5), least_docs=least, most_terms=most).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain_divergence(docs, least, most)
    assert divergence.report(frame.limit(0)).count() == 0


def test_divergence_of_a_long_text(spark):
    text = "word Other " * ((divergence.SLICE + 5000) // 11) + "z" * 9000
    frame = spark.createDataFrame([("en", "a", text), ("en", "b", "word")], "lang string, source string, text string")
    counts = {(r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(frame).collect()}
    n = text.count("word")
    assert counts == {("a", "word"): (n, 1), ("a", "other"): (n, 1), ("a", "z" * 9000): (1, 1), ("b", "word"): (1, 1)}


@pytest.mark.parametrize("name", ["op11_warc", "op13_divergence"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want, got = con.sql(entries.oracle_sql()[name]), entries.queries()[name](spark, D)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())

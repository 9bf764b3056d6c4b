"""The operators against brute force, on small fixtures with the edge cases of their docstrings."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import bpe, decontaminate, entries, html_text, licenses, near_dedup, packing, quality, topk, toxicity, url_rules
from orderflow.llm.common import buffer_of

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n ", "One two", "one TWO three. four-five é中 x9", "a" * 500, "under the MIT license, and cc-by-nc; Apache License, Version 2.0", "it's ’s  \t\n y"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = ODD + [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 60))) for _ in range(60)]
    texts += texts[20:24]  # exact copies
    texts += [t + " more" for t in texts[30:34]]
    rows = [(i, t, "en", "s", 0, 1) for i, t in enumerate(texts)] + [(3, "One two", "en", "s", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score int")


def encoding():
    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(None, path), special_tokens={})


def test_bpe(spark, docs):
    enc, texts = encoding(), dict(docs.select("doc_id", "text").collect())
    for r in bpe.report(docs).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert bpe.report(docs.limit(0)).count() == 0


def test_bpe_splits_like_the_pattern():
    rnd, known = random.Random(1), regex.compile(bpe.KNOWN)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "中", "1", "２", "!", "…", "😀", "\u00a0", "\u3000", "\x1c", "ⅷ", "_", "ß", "\u0301"]
    for _ in range(1500):
        rows = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(5)]
        raw, offsets = buffer_of(pa.array([r.encode() for r in rows], pa.binary()))
        words = itertools.accumulate([len(w.encode()) for r in rows for w in known.findall(r)], initial=0)
        assert bpe.split(raw, offsets).tolist() == list(words)[:-1] == bpe.words_of(raw, offsets, bpe.KNOWN + "|(?!)").tolist()


def test_bpe_rank_map_and_chunks(spark, docs, monkeypatch):
    ranks = bpe.read_ranks(spark, bpe.vocabulary()[0])
    base, cells = bpe.rank_map(ranks)
    for k, v in list(ranks.items())[::97]:
        for i in range(1, len(k)):
            a, b = ranks.get(k[:i]), ranks.get(k[i:])
            if a is not None and b is not None:
                assert cells[base[a] + b] == a << 40 | v
    some = random.Random(2).sample(sorted(ranks.values()), 60)
    for a, b in itertools.product(some, some):
        known = cells[base[a] + b] >> 40 == a
        assert known == (next(k for k, v in ranks.items() if v == a) + next(k for k, v in ranks.items() if v == b) in ranks)
    # Chunks of a few rows, extra columns, a kept column named like the result.
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    frame = docs.withColumn("ids", F.lit("x")).withColumn("words", F.array("lang"))
    tokenizer = bpe.Tokenizer(spark, ranks, bpe.vocabulary()[1])
    got = tokenizer.encode(frame)
    assert got.columns == [*frame.columns, "_ids"]
    enc = encoding()
    rows = got.withColumn("back", tokenizer.decode(F.col("_ids"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r._ids == enc.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode() and r.ids == "x"
    assert tokenizer.encode(frame.limit(0)).count() == 0


def test_bpe_long_runs(spark):
    texts = ["ab" * 400, "x" * 250 + "é" * 30, "word " * 3000, "\U0001f600" * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = encoding()
    for r in bpe.report(frame).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()


def brute_windows(items, text, w=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        k = min(w, len(own))
        for p in range(len(own) - k + 1 if k else 0):
            for q in range(len(words) - k + 1):
                if words[q : q + k] == own[p : p + k]:
                    hit |= set(range(q, q + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontamination(spark, docs, block):
    texts = [r.text for r in docs.collect()]
    items = [(1, texts[30]), (2, "alpha"), (3, ""), (4, None), (10, " ".join((texts[40] or "").split()[2:14])), (5, "no such words at all in any of these"), (6, texts[30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(docs.select("doc_id", "text"), bench, block_bytes=block).collect()
    for r in found:
        n, hit, own = brute_windows(items, r.text)
        assert (r.n_words, sum(s.end - s.start for s in r.hit_spans), [m.item_id for m in r.matches]) == (n, hit, own)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.hit_spans for r in found)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [4 << 20, 70])
def test_decontamination_without_item_ids(spark, block):
    rows = spark.createDataFrame([(1, "so one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "One two"), (None, "two three"), (7, "four five")], "item_id long, text string")
    found = {r.doc_id: (sum(s.end - s.start for s in r.hit_spans), [m.item_id for m in r.matches]) for r in decontaminate.find_overlaps(rows, bench, block_bytes=block).collect()}
    assert found == {1: (3, []), 2: (2, ["7"]), 3: (0, [])}
    assert [r.doc_id for r in decontaminate.decontaminate(rows, bench, block_bytes=block).collect()] == [3]


def test_decontamination_longest_matches():
    words = ["w", "x", "y"]
    rnd = random.Random(4)
    for _ in range(60):
        items = [(str(k % 3) if k else None, " ".join(rnd.choices(words, k=rnd.randrange(12))).encode()) for k in range(4)]
        texts = [" ".join(rnd.choices(words, k=rnd.randrange(30))).encode() for _ in range(3)]
        _, spans, matches = decontaminate._judge(*buffer_of(pa.array(texts, pa.binary())), decontaminate.Patterns(items, 4))
        for r, text in enumerate(texts):
            best, hit, own = {}, set(), text.split()
            for name, item in items:
                item = item.split()
                for p, q in itertools.product(range(len(own)), range(len(item))):
                    n = next((k for k in range(min(len(own) - p, len(item) - q)) if own[p + k] != item[q + k]), min(len(own) - p, len(item) - q))
                    if n >= min(4, len(item)):
                        hit |= set(range(p, p + n))
                        if name is not None and (-n, p) < best.get(name, (0, 0)):
                            best[name] = (-n, p)
            assert {w for a, b in spans.get(r, []) for w in range(a, b)} == hit
            assert matches.get(r, {}) == {k: (-n, p) for k, (n, p) in best.items()}


def test_decontamination_of_one_repeated_word():
    began = time.time()
    n, spans, matches = decontaminate._judge(*buffer_of(pa.array([b"w " * 20000], pa.binary())), decontaminate.Patterns([("a", b"w " * 200)], 10))
    assert (n.tolist(), spans, matches) == ([20000], {0: [(0, 20000)]}, {0: {"a": (200, 0)}}) and time.time() - began < 20


def test_fingerprints_by_plain_counting(spark, docs):
    rows = docs.select("doc_id", "text").distinct().collect()
    got = dict(near_dedup.near_duplicates(docs).select("doc_id", "fingerprint").collect())
    for r in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))
        grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert int(got[r.doc_id], 16) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_dedup_by_component_not_by_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue grey pink black"
    rows = [(5, a, 1), (5, b, 2), (9, b, 3), (9, b, 3), (None, c, 4), (None, c, 4), (None, "", 5), (7, a, 6)]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, root long"))
    assert sorted((r.doc_id or 0, r.text, r.root) for r in kept.collect()) == [(0, "", 5), (0, c, 4), (5, a, 1), (5, b, 2)]
    assert kept.columns == ["doc_id", "text", "root"]


def test_components_of_a_large_star(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {5001 + i: 5000 for i in range(40)}


def test_near_dedup(spark, docs):
    got = near_dedup.near_duplicates(docs).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    reach = {i: i for i in fps}
    for _ in fps:
        new = {i: min(reach[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in fps}
        if new == reach:
            break
        reach = new
    assert all(r.component_id == reach[r.doc_id] for r in got) and len(got) == docs.count()
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(reach.values()))
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert near_dedup.deduplicate(nameless).count() == len(set(reach.values()))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_golay_keys_meet():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 300, dtype=np.int64)
    for n in (1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rnd.choice(63, n, replace=False):
                y[i] ^= np.int64(1) << np.int64(b)
        kx, rx, hx = near_dedup.bucket_keys(x)
        ky, ry, hy = near_dedup.bucket_keys(y)
        for i in range(len(x)):
            assert set(kx[rx == i]) & set(ky[(ry == i) & hy])


def test_top_k(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rnd.normal(0, 1, 40)]) for i in range(200)] + [(200, None), (201, [float("nan")] * 40), (202, [None] * 40), (203, [1.0] * 3), (204, []), (20, [0.5] * 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, is_query=F.col("id") % 40 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    valid = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows if v and len(v) == 40 and None not in v and np.isfinite(v).all()]
    for q, v in valid:
        if q % 40 == 0:
            best = sorted(((-int(v @ u), i) for i, u in valid if i != q))[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(frame.limit(0), is_query=F.lit(True)).count() == 0


def test_top_k_of_large_components_and_repeated_queries(spark):
    rows = [(0, [4e7, 1.0]), (1, [5e7, 0.0]), (2, [6e7, 0.0]), (3, [-1e300, 0.0]), (4, [1e300, 2.0]), (5, [1e15, 3.0]), (6, [-0.001, 0.02]), (20, [3.5, -7.25]), (20, [3.5, -7.25]), (20, [-1.0, 2.0]), (7, [float("inf"), 1.0])]
    valid = [(i, [int(x * 64 // 1) if abs(x) < 1e18 else int(x * 64) for x in v]) for i, v in rows if abs(v[0]) < 1e308]
    near = lambda x: max(-(2**63), min(2**63 - 1, x))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (8 << 20, 40):
        want = []
        for i, v in valid:
            if i % 20 == 0:
                best = sorted((-near(v[0] * u[0] + v[1] * u[1]), j) for j, u in valid if j != i)[:4]
                want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
        got = topk.top_k(frame, is_query=F.col("id") % 20 == 0, k=4, block_bytes=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_html(spark):
    page = '<html><body><nav><ul><li><a>M</a></ul></nav><div class="cookie-notice">C</div><article><h1>T &amp; x</h1><p>a <b>b</b><p>c\n d<script>"<p>"</script><aside>s</aside><div id=comments>r</div></article><footer>f</footer>'
    plain = ["<body><div><p>text %d</div><div>Subscribe now</div></body>" % i for i in range(6)]
    rows = [(1, "http://h/a", page), (2, None, None), (3, "http://e/", "")] + [(10 + i, "http://s/%d" % i, p) for i, p in enumerate(plain)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("T & x\na b\nc d", 13)
    assert got[2] == got[3] == ("", 0)
    assert got[12][0] == "text 2"


def texts_of(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_html_branches_keep_what_differs(spark):
    wraps = ["<html><body><div id=page><article><p>own %d</article></div>", "<html><body><div id=page><div class=content><p>own %d</p></div></div>"]
    pages = [(f"http://w{k}/{i}", w % i) for k, w in enumerate(wraps) for i in range(5)]
    assert texts_of(spark, pages) == [f"own {i}" for _ in wraps for i in range(5)]
    same = "<body><div><p>%s</p></div><article><h1>%s</h1><p>%s</p></article>"
    hosts = [("http://c/%d" % i, same % ("x", "copy", "text") if i < 90 else same % (i, f"t {i}", f"own {i}")) for i in range(100)]
    plain = [("http://d/%d" % i, "<html><body><div class=a><p>%s</p></div><div class=b>Read on</div>" % (i if i > 90 else "copy")) for i in range(100)]
    assert texts_of(spark, hosts) == ["copy\ntext"] * 90 + [f"t {i}\nown {i}" for i in range(90, 100)]
    assert texts_of(spark, plain) == ["copy"] * 91 + [str(i) for i in range(91, 100)]


def test_html_names_and_attributes():
    text = lambda page: html_text.extract(page, set())
    whole = ['<article>a <a href="/trips/hidden-gems">b</a><p title="a hidden gem">c<p><a href="/x?id=ad">d</a> <a href=/x?id=ad>e</a><p data-id=ad>f</article>', '<article class="post has-sidebar"><div class="post-header">a b</div><p class=share-price>c<p id=social-history>d e f</article>', '<div class=widget><form><article class=promo>a b c d e f</article></form></div>', '<main><h1>a</h1><div class=social><article class=share>b c d e f</article></div></main>', "<aside><article>a b c d e f</article></aside>"]
    assert [text(f"<html><body>{p}</body></html>").split() for p in whole] == [list("abcdef")] * len(whole)
    gone = ["<p hidden>x", "<p class='x' hidden=''>x", "<p class='big ad'>x", "<p\nid=comment-12>x", "<div role=search>x</div>", "<div id=comments><article>x</article></div>"]
    assert [text(f"<html><body><article>a{p}</article></body></html>") for p in gone] == ["a"] * len(gone)
    assert text("<article>a</article><div class=related><article>x</article></div><main hidden>x</main>") == "a"


def test_html_tree_judges_parts_of_names(spark):
    page = "<html><body><article><p>own %d</p><div class=post-share>Share it</div><div class=share-price>%d</div></article>"
    assert texts_of(spark, [("http://h/%d" % i, page % (i, i)) for i in range(5)]) == [f"own {i}\n{i}" for i in range(5)]


def test_html_hosts_without_article(spark):
    unique = ["<html><body><div><p>unique text %d</p></div></body></html>", "<div class=page><div class=box>Subscribe now</div><div class=box><p>unique %d</p><p>more %d</p></div><div class=box>Read on</div></div>"]
    pages = [("http://u/%d" % i, unique[0] % i) for i in range(6)] + [("http://v/%d" % i, unique[1] % (i, i)) for i in range(6)]
    assert texts_of(spark, pages) == [f"unique text {i}" for i in range(6)] + [f"unique {i}\nmore {i}" for i in range(6)]
    # Repeated boxes after a varying number of paragraphs; nothing is repeated often enough on two pages.
    varied = ["<body>" + "".join(f"<p>p {i} {k}</p>" for k in range(i + 1)) + "<p>Follow us</p></body>" for i in range(6)]
    assert texts_of(spark, [("http://w/%d" % i, p) for i, p in enumerate(varied)]) == ["\n".join(f"p {i} {k}" for k in range(i + 1)) for i in range(6)]
    assert texts_of(spark, [("http://x/%d" % i, "<body><p>alike</p></body>") for i in range(2)]) == ["alike"] * 2
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_counts_what_the_tree_decides(spark):
    pages = spark.createDataFrame([("h", "<body><div>menu</div><p>text %d</p></body>" % i) for i in range(5)], "host string, html string")
    assert html_text.low_branches(pages).count() == 2  # the box, counted from the first and from the last


def test_html_importance_is_composed_up_the_tree(spark):
    """The importances of all nodes, and what is noise, are those of a plain recursion over the merged pages."""
    pick = random.Random(8)
    pages = []
    for i in range(40):
        items = "".join(f"<li>{'Home' if k else f'item {pick.randrange(6)}'}</li>" for k in range(pick.randrange(2, 5)))
        deep = "<div>" * 9 + f"own {i} text" + "</div>" * 9
        pages.append((f"h{i % 3}", f"<body>Hello<div class=a><ul>{items}</ul><p>Read <b>on</b></p></div><div class=b>{deep}</div><div class=c><p>Foot</p></div>" + "<p>x</p>" * pick.randrange(3)))
    trees = {}
    for host, page in {(h, p): 0 for h, p in pages}:
        for _, node, up, share, look, _, words in html_text.Page(page).tree():
            trees.setdefault(host, {}).setdefault(node, []).append((up, share, look, words))
    want = {}
    for host, tree in trees.items():
        def composed(node):
            rows, below = tree[node], [(n, r) for n, rs in tree.items() for r in rs if r[0] == node]
            m, given = len(rows), {n: composed(n) for n in dict.fromkeys(n for n, _ in below)}
            noise = all(given[n][1] for n in given)
            if m < 3:
                value = 1.0
            elif rows[0][3]:
                seen = Counter(w for r in rows for w in r[3])
                value = 1 - sum(math.log(c, m) for c in seen.values()) / len(seen)
            else:
                kinds = Counter(r[2] for r in rows)
                entropy, left = -sum(c / m * math.log(c / m, m) for c in kinds.values()), 0.9 ** len(kinds)
                value = (1 - left) * entropy + left * sum(r[1] * given[n][0] for n, r in below) / m
            want[host, node] = value, noise and value < 0.2
            return want[host, node]

        for root in {n for n, rows in tree.items() if rows[0][0] is None}:
            composed(root)
    found = html_text.importance(html_text.style_nodes(spark.createDataFrame(pages, "host string, html string")))
    got = {(r.host, r.node): (r.importance, r.noise) for r in found.collect()}
    assert set(got) <= set(want) and all(want[k][0] == 1 for k in set(want) - set(got))
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in got)
    assert {noise for _, noise in got.values()} == {True, False}


def test_html_words_and_nodes_below_decide(spark):
    # A box in four versions goes by its common words, a text that is alike on most pages stays for the others' sake.
    box = "<body><div><p>own %d</p></div><div class=box>Share this page with all of your friends on %s</div>"
    pages = [("http://a/%d" % i, box % (i, "wxyz"[i % 4])) for i in range(12)]
    alike = "<body><div><p>%s</p></div><p>page %d</p>"
    pages += [("http://b/%d" % i, alike % ("the same" if i < 38 else f"quite another text of page n{i}", i)) for i in range(40)]
    texts = texts_of(spark, pages)
    assert texts[:12] == [f"own {i}" for i in range(12)]
    assert texts[12] == "the same\npage 0" and texts[-1] == "quite another text of page n39\npage 39"


@pytest.mark.parametrize("page", ["<a " * 150_000 + "'", "<div>" * 40_000 + "</b>" * 20_000 + "</div>" * 40_000, "<b>" * 5 + "<div>" * 40_000 + "</b>" * 60_000, "<i>" * 60_000 + "<h1></h1>" * 20_000, "<aside>" * 30_000 + "<main></main>" * 20_000, "<a x='" * 90_000, "<" * 500_000, "<!--" * 120_000, "<p>" * 100_000, "<a " + " " * 500_000 + "=>"], ids=range(10))
def test_html_of_long_malformed_pages(page):
    began = time.time()
    html_text.extract(page + "text", {1})
    assert time.time() - began < 40


def test_packing(spark, docs):
    path, pattern = bpe.vocabulary()
    enc = encoding()
    packed = packing.pack(docs.where("doc_id > 8"), ranks=bpe.read_ranks(spark, path), pattern=pattern, row=32, shard_bytes=4000).cache()
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.first, r.ids))
    for r in docs.where("doc_id > 8").collect():
        assert [i for _, p in sorted(parts[r.doc_id]) for i in p] == [*enc.encode_ordinary(r.text), packing.END]
    for r in packed.collect():
        positions = np.frombuffer(r.positions, "<i4")
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)) and r.cu_seqlens[-1] == r.n_tokens <= 32
    lengths = np.random.default_rng(3).integers(1, 33, 500)
    free = []  # best fit decreasing by plain search
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [i for i, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= n
        else:
            free.append(32 - n)
    assert len(packing.best_fit_decreasing(lengths, 32)) == len(free)


def test_licenses(spark, docs):
    for r in licenses.report(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        words, places, labels = WORD.findall(lower(r.text)), [], set()
        for phrase, label in licenses.PHRASES:
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_fire_through_their_gates():
    found = lambda text: {d[2] for d in licenses.rules().scan(lower(text).encode())[1]}
    said = {"Released under the FreeBSD license": "bsd-2-clause", "licensed under 0BSD": "0bsd", "under the PSF license": "psf", "GPLv2": "gpl-2", "GPL3+": "gpl-3", "a LGPLv2.1 b": "lgpl-2.1", "LGPLv3": "lgpl-3", "MPLv2": "mpl-2", "MPLv2.0": "mpl-2", "licensed under GNU GPLv3": "gpl-3"}
    assert {t: found(t) for t in said} == {t: {label} for t, label in said.items()}
    assert not found("apache2 gplv4 gplx pgpl2 mitv2")
    for family, _, names, versions in licenses.FAMILIES:
        for name in names:
            for words in {name.replace("?", ""), " ".join(w for w in name.split() if not w.endswith("?"))}:
                for before in [b for form in licenses.FORMS for b in form[0] or [""]]:
                    for v in [*versions, None]:
                        if v or before or name not in licenses.WEAK:
                            label = family if v is None else f"{family}-{v.removesuffix(' 0').replace(' ', '.')}"
                            for mark in [" ", " version ", " v", "v"] if v else [""]:
                                text = f"so {before} {words}{mark}{(v or '').replace(' ', '.')} ok"
                                assert label in found(text), (text, found(text))


def test_license_signatures_fire_through_their_gates():
    for label, _, words, _, _ in licenses.SIGNATURES:
        for pick in (0, -1):
            text = " ".join("one two" if w == "*" else w.rstrip("?").split("|")[pick] for w in words.split())
            found = licenses.rules().scan(lower(f"So: {text.replace(' ', ', ', 1)}.").encode())[1]
            assert label in {d[2] for d in found}, (text, found)
    found = lambda text: {d[2] for d in licenses.rules().scan(lower(text).encode())[1]}
    assert found("licensed under the GNU GPL, with Classpath exception") >= {"gpl-with-classpath-exception"}
    assert found("GPL-2.0-or-later") == {"gpl-2"}


def test_license_priority_and_containment():
    scanner = licenses.rules()
    texts = ["licensed under the apache license version 2.0 and under the mit license", "GNU Lesser General Public License v2.1, or the BSD 3-clause license; in the public domain", "cc-by-nc-sa 4.0 and cc by 3.0", "all rights reserved. proprietary license"]
    for text in texts:
        low = lower(text).encode()
        every = [(-priority, m.start() - m.end(), order, m.start(), m.end(), label) for order, (_, rule, label, priority, _) in enumerate(scanner.rules) for m in rule.finditer(low)]
        kept = []
        for *_, a, b, label in sorted(every):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, label))
        assert [d[:3] for d in scanner.scan(low)[1]] == sorted(kept) and kept


def test_url_rules_separators(spark):
    urls = ["http://com,example/de/", "http://net,foo/x", "http://net foo/", "http://a..net/x", "http://.net/", "http://net./", "http://x.net:80/", "http://net\x00foo/", "http://NET", "http://a.b.example.com/de/x", "http://xexample.com/de/", "x://org/fr", "http://org/fr/?a"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit("h"))
    con = duckdb.connect()
    pages = frame.select("page_id", "url").toPandas()  # noqa: F841
    want = con.sql(url_rules.ORACLE).fetchall()
    got = url_rules.apply_rules(frame, url_rules.rules_frame(spark, url_rules.RULES))
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(want)
    assert url_rules.apply_rules(frame.limit(0), url_rules.rules_frame(spark, url_rules.RULES)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET/x", "https://a.example.net/en/x?q", "http://b.example.net/de/", "http://example.com/de/1#x", "http://x.org/fr/", "http://x.org/de/", "http://net", "http://mynet/x", "ftp://example.net?/en/"]
    rules = [(h, p, v) for h, p, v in url_rules.RULES]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(spark.createDataFrame(rows, "page_id long, url string"), url_rules.rules_frame(spark, rules)).collect() if r.rule)
    assert [(g[0], g[3], g[4]) for g in got] == [(3, "net/", "block"), (3, "net/", "block"), (4, "example.net/en/", "allow"), (5, "net/", "block"), (6, "example.com/de/", "block"), (7, "org/fr/", "allow")]


@pytest.mark.parametrize(("module", "label", "held"), [(quality, "quality", (5, 0)), (toxicity, "toxic", (4, 2))])
def test_classifiers(spark, module, label, held):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = module.report(documents.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8), labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]) for r in rows)
    good, bad = [r.score for r in out if r[label] == 1], [r.score for r in out if r[label] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in module.score(empty, None).collect())


def test_factorisation_machine_by_pairs():
    rnd = np.random.default_rng(5)
    texts = [b"", b"one two two", " ".join(map(str, rnd.integers(0, 50, 40))).encode(), b"A line\nand another, 1 2 3"] * 6
    machine = quality.Machine(texts, np.arange(24) % 2, np.ones(24), epochs=1)
    raw, offsets = buffer_of(pa.array(texts[:4], pa.binary()))
    row, col, val = machine._columns(*quality.features(raw, offsets))
    z, _ = machine._linear(row, col, val, 4)
    for r in range(4):
        own = [(c, x) for k, c, x in zip(row, col, val, strict=True) if k == r]
        pairs = sum(float(machine.v[a] @ machine.v[b]) * x * y for (a, x), (b, y) in itertools.combinations(own, 2))
        assert abs(z[r] - (machine.b[0] + sum(machine.w[c] * x for c, x in own) + pairs)) < 1e-9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_meet_nulls_ties_and_clashing_names(spark, docs, module):
    words = {0: "calm water garden letter window", 1: "vile awful nasty rotten filthy"}
    rows = [(i, " ".join(random.Random(i).choices((words[i % 2] + " the and of to in a").split(), k=60))) for i in range(240)]
    known = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")
    model = module.fit(known, labels)
    assert model is not None
    got = module.score(docs, model)
    assert got.columns == [*docs.columns, "_score"] and got.count() == docs.count()
    assert all(0 <= r._score <= 1 for r in got.collect())
    assert module.score(docs.limit(0), model).count() == 0
    same = [r._score for r in got.where("text = 'One two'").collect()]
    assert len(same) == 2 and same[0] == same[1]


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    for name, sql in entries.oracle_sql().items():
        frame, want = entries.queries()[name](spark, D), con.sql(sql)
        columns = sorted(frame.columns)
        assert columns == sorted(want.columns)
        place = [want.columns.index(c) for c in columns]
        assert sorted(str(tuple(r)) for r in frame.select(columns).collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    ids, frame = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, D)
        assert frame.columns == docs.columns
        now = {r.doc_id for r in frame.select("doc_id").collect()}
        assert now <= ids, name
        ids = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, D).collect()} == ids


def test_pipeline_stages_by_brute_force(spark):
    """Each stage's kept rows from its own input, one document after the other."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    good, toxic = quality.fit(docs, labels), toxicity.fit(docs, labels)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, kept = now.collect(), stage(spark, now, D)
        if name == "quality":
            want = [r.doc_id for r in rows if good.score(*buffer_of(pa.array([(r.text or "").encode()], pa.binary())))[0] >= quality.THRESHOLD]
        elif name == "toxicity":
            want = [r.doc_id for r in rows if toxic.score([(r.text or "").encode()])[0] < toxicity.THRESHOLD]
        elif name == "near_dedup":
            prints = {r.doc_id: near_dedup.fingerprint((r.text or "").encode()) for r in rows}
            want, left = [], set(prints)
            while left:
                reach, todo = set(), [min(left)]
                while todo:
                    i = todo.pop()
                    reach.add(i)
                    left.discard(i)
                    todo += [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 3]
                    left -= set(todo)
                want.append(min(reach))
        else:
            windows = {" ".join(w[p : p + k]) for _, t in bench if (w := WORD.findall(lower(t))) for k in [min(10, len(w))] for p in range(len(w) - k + 1)}
            sizes = {len(w.split()) for w in windows}
            held = lambda t: any(" ".join(w[p : p + k]) in windows for w in [WORD.findall(lower(t))] for k in sizes for p in range(len(w) - k + 1))
            want = [r.doc_id for r in rows if not held(r.text)]
        now = spark.createDataFrame(kept.collect(), docs.schema)
        assert sorted(r.doc_id for r in now.collect()) == sorted(want), name
    enc, texts = encoding(), dict(now.select("doc_id", "text").collect())
    last = corpus_pipeline.STAGES[-1][1](spark, now, D).collect()
    assert {r.doc_id for r in last} == set(texts)
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(texts[r.doc_id] or ""))).encode()).hexdigest() for r in last)

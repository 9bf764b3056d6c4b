"""How the sources of a language differ in their words, from sorted token-start pointers.

A shard is a slice of whole texts in one Arrow buffer. Its word-start pointers (one for each term) are
sorted by a multikey quicksort: pointers are ordered by the next eight bytes of their words, then the
runs that are still equal, and whose words go on, by the eight bytes after those. Runs of equal words
then give, for each language and source, the number of occurrences and of documents that hold the word.
These partial counts are added up by Spark: first by (language, source, term), then by (language, term),
where terms of too few documents go. What stays is written as a table, which all later steps read.

Probabilities are whole numbers of a billionth, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with
decimals for what exceeds 64 bits. The distances of all pairs of sources are added up over blocks of
terms: a task holds a block of at most about BLOCK rows, and adds dense columns, so that terms that
neither source has count too. The first terms of a source are ranked by Spark, which keeps only the
best of each task before it shuffles.

Defined results: null text, language and source are ''; terms are runs of A-Z (lower-cased), a-z and
characters from U+0080 on; every row is a document, repeated rows and ids too; a group without terms has
rows for its pairs; a language of one source has none; without kept terms the values of pairs are 0; an
empty table gives an empty one; a text beyond a slice is sorted in pieces, and counts as one document;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orderflow.llm.common import LOWER, as_bytes, batches_of_rows, bounded_batches, buffer_of, checkpointed, drop_path, stored

LEAST_DOCS, PRIOR, UNIT, TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of text of a shard's slice, rows of (source, term) of a block of pairs, parts of a joined group.
SLICE, BLOCK, SALTS = 8 << 20, 20_000, 16
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[97:123] = True
IS_TERM[128:] = True


# Pointers


def term_starts(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms of lower-cased texts, and the row of each."""
    flags = IS_TERM[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts = flags.copy()
    starts[1:] &= ~flags[:-1] | edge[1:-1]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | edge[1:-1]
    at = np.flatnonzero(starts).astype(np.int32)
    return at, np.flatnonzero(ends).astype(np.int32) + np.int32(1), np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(at, offsets)))


#: For n bytes of a word, the bits of its first n of eight.
_MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], dtype=np.uint64)


def multikey_quicksort(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their words' bytes, and where the runs of equal words begin. A word that
    ends before the next eight bytes has 0 there, which no word holds, so it comes before those that go on."""
    n, length = len(starts), ends - starts
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = np.ndarray((len(low) + 1,), ">u8", np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))

    def key(of: np.ndarray, depth: int) -> np.ndarray:
        return eight[np.minimum(starts[of] + depth, ends[of])].astype(np.uint64) & _MASK[np.clip(length[of] - depth, 0, 8)]

    order, place, run, depth = np.arange(n), np.arange(n), np.zeros(n, np.int64), 0
    fresh = np.zeros(n, bool)
    fresh[0] = True
    while len(place):
        own = order[place]
        keys = key(own, depth)
        by = np.argsort(keys) if depth == 0 else np.lexsort((keys, run))
        own, keys = own[by], keys[by]
        order[place] = own
        begins = fresh[place]
        begins[1:] |= keys[1:] != keys[:-1]
        fresh[place] = begins
        depth += 8
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(place)))
        on = (size > 1) & (np.maximum.reduceat(length[own], first) > depth)
        place, run = place[np.repeat(on, size)], np.repeat(np.arange(int(on.sum())), size[on])
    return order, np.flatnonzero(fresh)


def _taken(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at the pointers as strings."""
    size = (ends - starts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    raw = low[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))


def shard_counts(low: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """For each term and group of a shard: the term, the group, its occurrences, and the rows that hold it."""
    starts, ends, row = term_starts(low, offsets)
    order, first = multikey_quicksort(low, starts, ends)
    many, rows = int(groups.max(initial=0)) + 1, len(offsets) - 1
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    seen = np.sort(run * rows + row[order])
    once = np.flatnonzero(np.diff(seen, prepend=-1))
    times = np.diff(np.append(once, len(seen)))
    run, row = seen[once] // rows, seen[once] % rows
    both = run * many + groups[row]
    by = np.argsort(both, kind="stable")
    both = both[by]
    edge = np.flatnonzero(np.diff(both, prepend=-1))
    if not len(edge):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    head = order[first[both[edge] // many]]
    return _taken(low, starts[head], ends[head]), both[edge] % many, np.add.reduceat(times[by], edge), np.diff(np.append(edge, len(both)))


PARTS = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])


def _of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(lang, source, term, n, docs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=PARTS.fieldNames())

    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        width = max(1, len(sources.dictionary))
        code, group = np.unique(langs.indices.to_numpy() * width + sources.indices.to_numpy().astype(np.int64), return_inverse=True)
        lang, source = langs.dictionary.take(pa.array(code // width)), sources.dictionary.take(pa.array(code % width))
        raw, offsets = buffer_of(batch.column(2))
        for i, j in batches_of_rows(offsets, SLICE):
            low = LOWER[raw[offsets[i] : offsets[j]]]
            if len(low) <= SLICE:
                term, g, n, docs = shard_counts(low, offsets[i : j + 1] - offsets[i], group[i:j])
                if len(term):
                    yield out(lang.take(pa.array(g)), source.take(pa.array(g)), term, n, docs)
                continue
            total: Counter = Counter()
            for a, b in _pieces(low):
                term, _, n, _ = shard_counts(low[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
                total.update(dict(zip(term.to_pylist(), n.tolist(), strict=True)))
            terms = list(total)
            for a in range(0, len(terms), 1 << 16):
                some = terms[a : a + (1 << 16)]
                same = pa.array(np.full(len(some), group[i]))
                yield out(lang.take(same), source.take(same), pa.array(some, pa.string()), [total[t] for t in some], np.ones(len(some), np.int64))


def _pieces(low: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cuts of a long text between terms."""
    a = 0
    while a < len(low):
        b = min(len(low), a + most)
        while b < len(low) and IS_TERM[low[b]]:
            b += 1
        yield a, b
        a = b


# Counts, probabilities, ranks


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold the term)."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    bounded_batches(docs.sparkSession)
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), as_bytes(docs[f"`{text_col}`"]).alias("text"))
    return rows.mapInArrow(_of_shards, PARTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> F.Column:
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0))) div cast({total} + {PRIOR} * {kept} as decimal(20,0))")


def _distances(terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's terms of the absolute differences of each two sources' p."""
    groups = groups.sort_values("source", ignore_index=True)
    many, zero = len(groups), groups["zero"].fillna(0).to_numpy(np.int64)
    at = {s: k for k, s in enumerate(groups["source"])}
    code, _ = pd.factorize(terms["term"])
    own, p = terms["source"].map(at).to_numpy(np.int64), terms["p"].to_numpy(np.int64)
    by = np.argsort(code, kind="stable")
    code, own, p = code[by], own[by], p[by]
    total, step, n = np.zeros((many, many), np.int64), max(1, (1 << 21) // max(1, many)), int(code.max(initial=-1)) + 1
    for a in range(0, n, step):
        i, j = np.searchsorted(code, [a, a + step])
        dense = np.tile(zero, (min(step, n - a), 1))
        dense[code[i:j] - a, own[i:j]] = p[i:j]
        for k in range(many - 1):
            total[k, k + 1 :] += np.abs(dense[:, k : k + 1] - dense[:, k + 1 :]).sum(axis=0)
    i, j = np.triu_indices(many, 1)
    names = groups["source"].to_numpy(object)
    lang = groups["lang"].iloc[0] if many else ""
    text = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({"lang": text([lang] * len(i)), "a": text(names[i]), "b": text(names[j]), "value": total[i, j]})


def divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, most_terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of each source from the others of its language,
    and the terms that it has more of than its language."""
    counts = term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= least_docs)
    terms, terms_at = stored(terms.select("lang", "term", "total", "by"), "divergence-terms")
    rows = terms.select("lang", "term", "total", F.explode("by").alias("b")).select("lang", "term", "total", "b.source", "b.n")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"), F.sum(F.size("by")).alias("cells"))
    text = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    groups = docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct()
    groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_n", "kept", "lang_n", "cells"])
    groups, groups_at = stored(groups.withColumn("zero", F.when(F.col("kept") > 0, share("0", "own_n", "kept"))), "divergence-groups")
    salted = groups.select("lang", "source", "own_n", "kept", "lang_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    rows = rows.select("lang", "source", "term", share("n", "own_n", "kept").alias("p"), share("total", "lang_n", "kept").alias("q"))

    blocks = -(-(groups.agg(F.max("cells")).first()[0] or 0) // BLOCK) or 1
    left = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    right = groups.select("lang", "source", "zero", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInPandas(_distances, "lang string, a string, b string, value long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    own = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = checkpointed(ranked(pairs).unionByName(ranked(own).where(F.col("rank") <= most_terms)))
    drop_path(docs.sparkSession, terms_at, groups_at)
    return out


def report(docs: DataFrame) -> DataFrame:
    """What the query op13_divergence returns."""
    return divergence(docs.select("lang", "source", "text"))


ORACLE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by lang, term having count(distinct r) >= 30),
l as (select lang, count(*) as v, sum(total) as n from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by lang, source, term),
s as (select lang, source, sum(n) as n from c group by lang, source),
g as (select o.lang, o.source, coalesce(s.n, 0) as n from (select distinct lang, source from d) o left join s using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as cnt, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v)::hugeint as p, 1 + (1000000000::hugeint * (k.total + 5)) // (l.n + 5 * l.v)::hugeint as q
      from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pv as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, b.source as item, coalesce(pv.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
o as (select lang, source, 'pair' as part, item, value from pr union all select lang, source, 'term', term, p - q from p where cnt > 0 and p > q),
x as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from x where part = 'pair' or rank <= 50
"""

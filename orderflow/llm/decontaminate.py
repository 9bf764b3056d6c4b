"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0:
not in it), a suffix array of the stretches that can hold a window is built by prefix doubling, and
every distinct window at the beginning of a benchmark suffix is binary-searched in it. A hit's range gives
all locations. Of the pairs of a location and a suffix, those that don't go on to the left are extended
word by word to the longest verbatim match; pairs are looked at in slices of bounded size. No text is shuffled: a document's result is complete in
its own shard, for any number of executors.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES; each block is one pass that
carries the hits of the passes before it.

Defined results: a null or empty text has no words, no hits; an item without words is never found; an
item of fewer words than the window is one window; repeated rows are judged one by one; ties (a
window in several items) count for every item; an item with a null id counts for hits and removal, and
is left out of the items found only; an empty benchmark hits nothing; other columns of
either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import as_bytes, batches_of_rows, buffer_of, equal_bytes, free_name, map_arrow, new_name, word_hashes, word_spans

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Words of one suffix array; a longer stretch is cut with an overlap that no window can escape.
SHARD_WORDS = 1 << 20
#: (place, suffix) pairs that are looked at together.
PAIRS = 1 << 20

MATCH = "array<struct<item_id:string,longest:int,first_word:int>>"
SPAN = "array<struct<start:int,end:int>>"


class Patterns:
    """The suffixes of one block of benchmark items, as numbers of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        text = pa.array([t for _, t in items], pa.binary())
        raw, offsets = buffer_of(text)
        low, s, e, first = word_spans(raw, offsets)
        hashes = word_hashes(low, s, e)
        self.window = window
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        #: Each item's number among the names, -1 for null.
        self.name = np.array([-1 if i is None else number[i] for i, _ in items], np.int64)
        self.vocab, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        #: The vocabulary's words: all bytes, begin and size.
        self.low, self.begin, self.size = low, s[at], e[at] - s[at]
        n = np.diff(first)
        self.longest = int(n.max(initial=0))
        #: Distinct windows of one length: (length, matrix, where each one's suffixes begin in the lists of keys,
        #: items, places in the block and words to the item's end).
        self.groups = []
        self.shortest = min((int(min(window, x)) for x in n if x), default=0)
        self.padded = np.concatenate([[0], inverse.astype(np.int32) + 1, np.full(self.longest + window, -1, np.int32)])
        self.first = first[:-1] + 1
        for w in sorted({int(min(window, x)) for x in n if x}):
            own = [(i, p) for i in range(len(items)) if n[i] and min(window, n[i]) == w for p in range(n[i] - w + 1)]
            item, place = np.array(own, dtype=np.int64).T
            start = self.first[item] + place
            matrix, which = np.unique(self.padded[start[:, None] + np.arange(w)], axis=0, return_inverse=True)
            # Suffixes by window and the word before (-1 where the item begins).
            before = np.where(place > 0, self.padded[start - 1], -1)
            key = self.keys(which.ravel(), before)
            order = np.argsort(key, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(which.ravel()))])
            self.groups.append((w, matrix, ends, key[order], item[order], start[order], (n[item] - place)[order]))

    def keys(self, window: np.ndarray, before: np.ndarray) -> np.ndarray:
        return window.astype(np.int64) * (len(self.vocab) + 3) + before + 1


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes that start at a non-zero number, sorted by their first `depth` numbers."""
    at = np.flatnonzero(text)
    rank, k = text.astype(np.int64), 1
    while True:
        _, key = np.unique(rank, return_inverse=True)
        rank = key.astype(np.int64)
        if k >= depth or rank.max(initial=0) + 1 == len(text):
            return at[np.argsort(rank[at], kind="stable")]
        after = np.zeros(len(text), dtype=np.int64)
        if k < len(text):
            after[:-k] = rank[k:] + 1
        rank = rank * (len(text) + 2) + after
        k *= 2


def _bound(text: np.ndarray, order: np.ndarray, patterns: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all patterns at once; `text` is padded by a pattern's length."""
    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
    steps = np.arange(patterns.shape[1])
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.where(open_, (lo + hi) // 2, 0)
        diff = text[order[mid][:, None] + steps] - patterns
        first = (diff != 0).argmax(axis=1)
        sign = diff[np.arange(len(patterns)), first]
        right = (sign < 0) | (upper & (sign == 0))
        lo = np.where(open_ & right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def _expanded(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of `many` numbers from `begin`: the range of each number, and the number."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[of]


def _search(numbers: np.ndarray, patterns: Patterns) -> Iterator[tuple[int, np.ndarray, Iterator]]:
    """Hits in one stretch of words: for each window length the hit places, and in slices
    (item, place, longest match from there) of the matches that begin before no longer one."""
    w0 = patterns.shortest
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (numbers > 0).astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    keep = (b - a) >= w0
    a, b = a[keep], b[keep]
    if not len(a):
        return
    lengths = b - a + 1  # and a separator
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    origin = np.arange(int(lengths.sum())) - np.repeat(starts - a, lengths)
    text = np.where(origin < np.repeat(b, lengths), numbers[np.minimum(origin, len(numbers) - 1)], 0).astype(np.int32)
    order = suffix_array(text, min(patterns.longest, 1 << 20))
    padded = np.concatenate([text, np.zeros(patterns.longest + patterns.window + 1, np.int32)])
    for w, matrix, ends, keys, item, start, left in patterns.groups:
        lo, hi = _bound(padded, order, matrix, False), _bound(padded, order, matrix, True)
        hit = np.flatnonzero(hi > lo)
        if len(hit):
            window, place = _expanded(lo[hit], (hi - lo)[hit])
            place, window = order[place], hit[window]

            def matches(window=window, place=place, ends=ends, keys=keys, item=item, start=start, left=left, w=w) -> Iterator:
                # A match that goes on to the left is not its item's longest, so of a window's suffixes those with
                # the same word before are left out: what stands before and after them is looked at.
                own = patterns.keys(window, np.where(place > 0, padded[place - 1], 0))
                a, b = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                places, begin = np.concatenate([place, place]), np.concatenate([ends[window], b])
                many = np.concatenate([a - ends[window], ends[window + 1] - b])
                total = np.cumsum(many)
                i = 0
                while i < len(places):
                    j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
                    of, suffix = _expanded(begin[i:j], many[i:j])
                    at = places[i:j][of]
                    length = np.full(len(at), w)
                    going = np.arange(len(at))
                    while len(going):
                        going = going[length[going] < left[suffix[going]]]
                        going = going[padded[at[going] + length[going]] == patterns.padded[start[suffix[going]] + length[going]]]
                        length[going] += 1
                    yield item[suffix], origin[at], length
                    i = j

            yield w, origin[place], matches()


def _best(row: np.ndarray, name: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each (row, name) the longest match, ties to the first place."""
    order = np.lexsort((place, -length, name, row))
    row, name, place, length = row[order], name[order], place[order], length[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    return row[new], name[new], place[new], length[new]


def _judge(raw: np.ndarray, offsets: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, dict[int, list], dict[int, dict]]:
    """Number of words of each row; the merged hit spans and the matches of the rows that have any."""
    low, s, e, first = word_spans(raw, offsets)
    rows = len(offsets) - 1
    spans: dict[int, list] = {}
    matches: dict[int, dict] = {}
    if not len(s) or not patterns.shortest:
        return np.diff(first), spans, matches
    hashes = word_hashes(low, s, e)
    near = np.minimum(np.searchsorted(patterns.vocab, hashes), len(patterns.vocab) - 1)
    known = np.flatnonzero((patterns.vocab[near] == hashes) & (patterns.size[near] == e - s))
    # Equal hashes of different words are no match.
    known = known[equal_bytes(np.concatenate([low, patterns.low]), s[known], patterns.begin[near[known]] + len(low), (e - s)[known])]
    # A zero between rows, so that no match crosses from one document to the next.
    row = np.repeat(np.arange(rows), np.diff(first))
    text = np.zeros(len(s) + rows, np.int32)
    text[known + row[known]] = near[known] + 1
    cover = np.zeros(len(text) + 1, np.int32)
    best = tuple(np.zeros(0, np.int64) for _ in range(4))
    begin = first[:-1] + np.arange(rows)
    step, over = SHARD_WORDS, patterns.longest + patterns.window
    for at in range(0, len(text), step):
        for w, places, found in _search(text[at : at + step + over], patterns):
            np.add.at(cover, places + at, 1)
            np.add.at(cover, places + at + w, -1)
            for item, place, length in found:
                name = patterns.name[item]
                place, length, name = place[name >= 0] + at, length[name >= 0], name[name >= 0]
                r = np.searchsorted(begin, place, side="right") - 1
                best = _best(*(np.concatenate(x) for x in zip(best, (r, name, place - begin[r], length), strict=True)))
    hit = np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])
    edge = np.flatnonzero(np.diff(hit))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(np.searchsorted(begin, a, side="right")) - 1
        spans.setdefault(k, []).append((a - int(begin[k]), b - int(begin[k])))
    for k, name, p, n in zip(*(x.tolist() for x in best), strict=True):
        matches.setdefault(k, {})[patterns.names[name]] = (n, p)
    return np.diff(first), spans, matches


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of bounded size: one row of counts first, then block by block."""
    items = bench.select(F.col(item_col).cast("string").alias("i"), as_bytes(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted(((r.i, bytes(r.t)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def find_overlaps(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, out: tuple[str, str, str] = ("n_words", "hit_spans", "matches")) -> DataFrame:
    """The kept columns of `docs` and three more: its number of words, the merged spans of hit words,
    and for each item found the longest verbatim match and its first word. A name that a kept column has is
    underscored."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    hidden = free_name(docs, "__text")
    n_name, span_name, match_name = (new_name(keep, n) for n in out)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], as_bytes(docs[f"`{text_col}`"]).alias(hidden), F.lit(0).cast("long").alias(n_name), F.expr(f"cast(array() as {SPAN})").alias(span_name), F.expr(f"cast(array() as {MATCH})").alias(match_name))
    schema = frame.schema
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    match_type = pa.list_(pa.struct([("item_id", pa.string()), ("longest", pa.int32()), ("first_word", pa.int32())]))
    for block in _blocks(bench, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Patterns(block, window))

        def judge(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            patterns, k = shared.value, len(keep)
            raw, offsets = buffer_of(batch.column(k))
            old_spans, old_matches = batch.column(k + 2).to_pylist(), batch.column(k + 3).to_pylist()
            n_words = []
            for i, j in batches_of_rows(offsets, SHARD_BYTES):
                n, new_spans, new_matches = _judge(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], patterns)
                n_words += n.tolist()
                for r, own in new_spans.items():
                    old_spans[i + r] = [{"start": a, "end": b} for a, b in _merged(own + [(x["start"], x["end"]) for x in old_spans[i + r]])]
                for r, own in new_matches.items():
                    best = {x["item_id"]: (x["longest"], x["first_word"]) for x in old_matches[i + r]}
                    for key, new in own.items():
                        if key not in best or (-new[0], new[1]) < (-best[key][0], best[key][1]):
                            best[key] = new
                    old_matches[i + r] = [{"item_id": key, "longest": n, "first_word": p} for key, (n, p) in sorted(best.items())]
            columns = [*batch.columns[: k + 1], pa.array(n_words, pa.int64()), pa.array(old_spans, span_type), pa.array(old_matches, match_type)]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        frame = map_arrow(frame, judge, schema)
    return frame.drop(hidden)


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    out = tuple(free_name(docs, n) for n in ("__n_words", "__spans", "__matches"))
    marked = find_overlaps(docs, bench, out=out, **options)
    return marked.where(F.size(out[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The digest that the query op2_decontaminate returns."""
    found = find_overlaps(docs.select("doc_id", "text"), bench, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("matches", lambda m: m["item_id"])), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


#: Windows as joined words: an independent way to the same rows.
ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as win
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
dw as (
  select r, p, k, array_to_string(w[p : p + k - 1], ' ') as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from bw) where len(w) >= k)),
hits as (select r, p, dw.k, item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from hits where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

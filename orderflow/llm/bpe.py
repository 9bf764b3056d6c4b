"""Byte-level BPE with Spark's higher-order functions.

Texts are split into words by the tokenizer's pattern, and each distinct word of all texts is folded once:

1. Documents are read in chunks of at most CHUNK_BYTES of text. A chunk has a list of its distinct words
   and, for every place of a word, the word's number in that list.
2. The chunks' lists are cut into buckets by the words' hashes and dealt by bucket; a word stands once in
   a chunk's list, so none is hot. Each distinct word is folded once, by higher-order functions over the
   array of its bytes, and all its rows get the ids.
3. Chunks and their buckets' ids are cogrouped by chunk, and the ids put at the words' places.

No text is shuffled, only the numbers (compressed) and the chunks' distinct words, by size, without separators; nothing but the
vocabulary passes through the driver.

The fold's state is one array of longs, a number for each piece: the rank of the pair that it makes with
the piece after it, its first byte's place in the word, and its id, from the high bits down. The least
element is the leftmost pair of least rank. A step joins it: the pairs left and right of the join get
new ranks, looked up in a literal rank map. A piece's rank is its id. The map is one array of longs in
the plan, addressed by displacement: the pair (a, b) stands at base[a] + b if anywhere, and a cell holds
a, to be told from other rows' cells, and the joined piece's rank.

Words over LONG_WORD bytes (runs without any break) would need as many steps as bytes, each over the
whole word; these alone are folded by the same rule with a heap where they stand.

Decoding looks up each id's bytes and joins the binary pieces.

Defined results: a null or empty text has no ids; unpaired or invalid bytes are kept as they are;
repeated rows are encoded one by one; a null id decodes to nothing; an empty table gives an empty one;
`encode` returns the columns asked for and one more. Its input is read twice
and must come in the same rows, order and partitions both times, as stored tables do; a frame that
doesn't is to be checkpointed before. A chunk that changed in between is an error, not a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from orderflow.llm.common import as_bytes, batches_of_rows, bounded_batches, buffer_of, equal_bytes, new_name, word_hashes

#: Text bytes of one chunk, and those split at a time.
CHUNK_BYTES, SPLIT_BYTES = 12 << 20, 1 << 20
#: Buckets of words for each shuffle partition.
BUCKETS = 2
#: Bytes up to which a word is folded by higher-order functions.
LONG_WORD = 256

#: The pattern that `split` knows how to follow with arrays; any other goes through `regex`.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A public rank file, of bounded size: lines of a base64 piece and its rank."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


# Words of the texts

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    if not _KINDS:
        table = np.full(0x110000, OTHER, np.uint8)
        for begin in [*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)]:
            block = "".join(map(chr, range(begin, begin + 0x800)))
            for kind, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
                for m in regex.finditer(cls, block):
                    table[begin + m.start() : begin + m.end()] = kind
        table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters' first bytes and code points. Bytes that are no UTF-8 belong to what is before them."""
    first = (raw & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(first)
    lead = raw[at]
    code = lead.astype(np.int32)
    for least, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        rows = np.flatnonzero((lead >= least) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        value = lead[rows].astype(np.int32) & bits
        for k in range(1, more + 1):
            value = value << 6 | raw[np.minimum(at[rows] + k, len(raw) - 1)] & 0x3F
        code[rows] = np.minimum(value, 0x10FFFF)
    return at, code


def split(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the words that the pattern KNOWN cuts the rows into; every byte is in a word."""
    if not len(raw):
        return np.zeros(0, np.int64)
    at, code = code_points(raw, offsets)
    n, kind = len(at), kinds()[code]
    row_start = np.zeros(n + 3, bool)
    row_start[np.searchsorted(at, offsets)] = True
    row_start[n:] = True
    run_start = row_start.copy()
    run_start[1:n] |= kind[1:] != kind[:-1]
    word = run_start[:n].copy()
    # White space before something else: its last character is a word of its own, or, if a blank, the
    # beginning of the next word.
    ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_start[1:n])
    word[ends] = True
    word[ends[code[ends] == 32] + 1] = False
    # Contractions: an apostrophe alone, no blank before it, and the letters after it.
    quote = np.flatnonzero((code == 39) & run_start[:n] & run_start[1 : n + 1] & ~row_start[1 : n + 1])
    quote = quote[row_start[quote] | (code[quote - 1] != 32)]
    code = np.concatenate([code, np.zeros(3, np.int32)])
    one, two = code[quote + 1], code[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pairs = np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & ~row_start[quote + 2]
    for which, length in ((short, 2), (pairs, 3)):
        word[quote[which] + 1] = False
        after = quote[which] + length
        word[after[after < n]] = True
    return at[word].astype(np.int64)


def words_of(raw: np.ndarray, offsets: np.ndarray, pattern: str) -> np.ndarray:
    """First bytes of all words of the rows. What a pattern leaves out between its matches is an error."""
    if pattern == KNOWN:
        return split(raw, offsets)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for m in regex.findall(pattern, raw[a:b].tobytes().decode(errors="surrogateescape")):
            out.append(a)
            a += len(m.encode(errors="surrogateescape"))
        if a != b:
            raise ValueError("the pattern does not match the whole text")
    return np.array(out, np.int64)


def distinct(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the list of the first of each of the words (`start`, `size`; in the order of the bytes), and
    each word's number among them."""
    hashes = word_hashes(raw, start, start + size)
    number, kinds = pd.factorize(hashes)
    first = np.empty(len(kinds), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    if (size == size[first[number]]).all() and equal_bytes(raw, start, start[first[number]], size).all():
        return first, number.astype(np.int32)
    known: dict[bytes, int] = {}  # equal hashes of different words
    number = np.array([known.setdefault(raw[a : a + n].tobytes(), len(known)) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.int32)
    return np.unique(number, return_index=True)[1], number


def distinct_words(raw: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of the rows, the most frequent first; the words' numbers; each row's words."""
    starts, sizes, numbers, counts = [], [], [], [np.zeros(0, np.int64)]
    known = 0
    for i, j in batches_of_rows(offsets, SPLIT_BYTES):
        at = offsets[i] + words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], pattern)
        counts.append(np.diff(np.searchsorted(at, offsets[i : j + 1])))
        size = np.diff(np.append(at, offsets[j]))
        first, number = distinct(raw, at, size)
        starts.append(at[first])
        sizes.append(size[first])
        numbers.append(number + np.int32(known))
        known += len(first)
    if not known:
        return [], np.zeros(0, np.int32), np.concatenate(counts)
    start, size, number = np.concatenate(starts), np.concatenate(sizes), np.concatenate(numbers)
    first, again = distinct(raw, start, size)
    number = again[number]
    order = np.argsort(-np.bincount(number), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    first = first[order]
    return [raw[a : a + n].tobytes() for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)], place[number], np.concatenate(counts)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in little room: bytes of the same weight stand together."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int32)


# The fold

NO_RANK, ID, PLACE = 1 << 60, (1 << 20) - 1, (1 << 40) - 1


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Displacements and cells of the map from pairs of ids to the rank of what they join to."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for k, v in ranks.items():
        for i in range(1, len(k)):
            if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None:
                rows.setdefault(a, []).append((b, v))
    end = max(ranks.values(), default=0) + 1  # the id of both ends of a word, in no pair
    room = max(64, 4 * sum(map(len, rows.values())))
    used, cells, base, draw = bytearray(room + end + 1), [end + 1 << 40] * (room + end + 1), [0] * (end + 1), random.Random(1)
    for a in sorted(rows, key=lambda a: -len(rows[a])):
        while any(used[(x := draw.randrange(room) if b is rows[a][0] else x) + b[0]] for b in rows[a]):
            pass
        base[a] = x
        for b, v in rows[a]:
            used[x + b], cells[x + b] = 1, a << 40 | v
    return base, cells


def joined_bytes(parts: Column) -> Column:
    """An array of binaries as one. Joined as strings, which keep any bytes."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


class Literals:
    """Arrays that are values in the plan: session variables until `drop`, then held by the frames alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def array(self, values: pa.Array, kind: str) -> Column:
        name, view = f"bpe_{uuid.uuid4().hex}", f"bpe_{uuid.uuid4().hex}"
        rows = pa.table({"v": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})
        self.spark.createDataFrame(rows).createOrReplaceTempView(view)
        self.spark.sql(f"DECLARE VARIABLE {name} array<{kind}>")
        self.spark.sql(f"SET VAR {name} = (SELECT transform(v, x -> cast(x as {kind})) FROM {view})")
        self.spark.catalog.dropTempView(view)
        self.names.append(name)
        return F.expr(f"session.{name}")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        self.names.clear()


class Fold:
    """The fold of one vocabulary."""

    def __init__(self, literals: Literals, ranks: dict[bytes, int]):
        self.spark = literals.spark
        #: Bytes that an id is written in.
        self.width = 2 if max(ranks.values(), default=0) < 1 << 16 else 4
        self.end = max(ranks.values(), default=0) + 1
        base, cells = rank_map(ranks)
        self.base, self.cells = literals.array(pa.array(base, pa.int64()), "bigint"), literals.array(pa.array(cells, pa.int64()), "bigint")
        first = []  # two neighbour bytes, 256 being the end: the state of the left one
        for a in range(257):
            own = self.end if a == 256 else ranks.get(bytes([a]), self.end)
            first += [(ranks[bytes([a, b])] << 40 if a < 256 and b < 256 and bytes([a, b]) in ranks else NO_RANK) | own for b in range(257)]
        self.first = literals.array(pa.array(first, pa.int64()), "bigint")
        #: Words that are a piece as a whole, even if merges alone would not make it.
        self.whole = {k: v for k, v in ranks.items() if 1 < len(k) <= LONG_WORD and heap_fold(k, ranks, whole=False) != [v]}

    def pair(self, a: Column, b: Column) -> Column:
        """The rank of the pair, in its bits of the state."""
        cell = F.get(self.cells, F.get(self.base, a) + b)
        # Another row's cell, or an empty one, stays above any rank.
        return F.shiftleft(F.least(cell.bitwiseXOR(F.shiftleft(a, 40)), F.lit(NO_RANK >> 40)), 40)

    def joined(self, state: Column, at: Column) -> Column:
        """The state with the pair at the place `at` (from 1) joined."""
        pair, before, after, beyond = (F.get(state, at + k) for k in (-1, -2, 0, 1))
        piece = F.shiftright(pair, 40)
        left = before.bitwiseAND(PLACE) + self.pair(before.bitwiseAND(ID), piece)
        right = pair.bitwiseAND(PLACE - ID) + piece + self.pair(piece, beyond.bitwiseAND(ID))
        rest = F.array_remove(F.array_remove(F.array_remove(state, after), pair), before)
        return F.array_insert(F.array_insert(rest, at - 1, left), at, right)

    def ids(self, codes: Column) -> Column:
        """The ids of a word, `width` bytes each, from the array of its bytes between two ends (256)."""
        begin = F.transform(codes, lambda x, i: F.get(self.first, x * F.lit(257) + F.coalesce(F.get(codes, i + 1), F.lit(256))) + F.shiftleft(i.cast("long"), 20))

        def step(state: Column, _: Column) -> Column:
            least = F.array_min(state)
            # An aggregate over one element names a value, so that it is computed once.
            join = F.aggregate(F.array(F.array_position(state, least).cast("int")), state, self.joined)
            return F.when(least >= NO_RANK, state).otherwise(join)

        done = F.aggregate(F.sequence(F.lit(1), F.size(codes) - 2), begin, step, lambda s: F.slice(s, F.lit(2), F.size(s) - 2))
        return joined_bytes(F.transform(done, lambda x: F.unhex(F.lpad(F.hex(x.bitwiseAND(ID)), 2 * self.width, "0"))))

    def words(self, rows: DataFrame) -> DataFrame:
        """The rows (chunk, bucket, word), dealt by bucket, with the word's ids: of the rows of a word, the
        first one's are folded and the others get them, in one pass over the sorted rows."""
        own = Window.partitionBy("bucket", "word").orderBy("chunk")
        # A byte's code is its character's in ISO-8859-1.
        letters = F.transform(F.split(F.decode("word", "ISO-8859-1"), ""), F.ascii)
        codes = F.concat(F.array(F.lit(256)), letters, F.array(F.lit(256)))
        first = rows.withColumn("n", F.row_number().over(own)).withColumn("codes", F.when(F.col("n") == 1, codes))
        if self.whole:
            whole = self.spark.createDataFrame(pa.table({"word": list(self.whole), "whole": [v.to_bytes(self.width, "big") for v in self.whole.values()]}))
            first = first.join(F.broadcast(whole), "word", "left")
        else:
            first = first.withColumn("whole", F.lit(None).cast("binary"))
        folded = first.withColumn("ids", F.when(F.col("codes").isNotNull(), F.coalesce(F.col("whole"), self.ids(F.col("codes")))))
        return folded.withColumn("ids", F.last("ids", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


# Encoding and decoding

WORDS = "chunk long, bucket int, first int, size int, n int, words binary"
BODY = "chunk long, n_words int, kept binary, counts binary, numbers binary, places binary, long array<int>, long_words array<binary>"


class Chunk:
    """Rows of documents with about CHUNK_BYTES of text, and their distinct words."""

    def __init__(self, rows: pa.RecordBatch, pattern: str, place: tuple[int, int]):
        raw, offsets = buffer_of(rows.column(rows.num_columns - 1))
        self.words, self.numbers, self.counts = distinct_words(raw, offsets, pattern)
        kept = pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.nulls(rows.num_rows)], names=[str(i) for i in range(rows.num_columns)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_batch(kept)
        self.kept = sink.getvalue().to_pybytes()
        # Equal chunks differ by their place: the number of the partition, and of the chunk in it.
        key = hashlib.blake2b(self.kept, digest_size=8, person=place[0].to_bytes(8, "little") + place[1].to_bytes(8, "little"))
        key.update(np.ascontiguousarray(raw))
        key.update(np.ascontiguousarray(offsets))
        self.key = int.from_bytes(key.digest(), "little", signed=True)
        self.long = [k for k, w in enumerate(self.words) if len(w) > LONG_WORD]

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the words up to LONG_WORD bytes in the order (bucket, size, word), their buckets and sizes."""
        order = np.array(sorted((k for k, w in enumerate(self.words) if len(w) <= LONG_WORD), key=self.words.__getitem__), np.int64)
        data, offsets = buffer_of(pa.array(self.words, pa.binary()))
        size = np.diff(offsets)[order]
        own = (word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)[order] if len(order) else size
        by = np.argsort(own * (LONG_WORD + 1) + size, kind="stable")
        return order[by], own[by], size[by]

    def word_rows(self, buckets: int) -> pa.RecordBatch:
        """A row for each bucket and size: the words' bytes one after the other."""
        order, own, size = self.dealt(buckets)
        first = np.flatnonzero(np.diff(own * (LONG_WORD + 1) + size, prepend=-1))
        ends = np.append(first, len(order))[1:]
        words = [b"".join(map(self.words.__getitem__, order[a:b].tolist())) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        numbers = [pa.array(x.astype(np.int32)) for x in (own[first], first, size[first], ends - first)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), self.key)), *numbers, pa.array(words, pa.binary())], names=["chunk", "bucket", "first", "size", "n", "words"])

    def body(self, buckets: int) -> pa.RecordBatch:
        """The kept columns, each row's number of words, the words' numbers, the numbers in the words' order
        in `word_rows`, and the longer words."""
        columns = {"chunk": [self.key], "n_words": [len(self.words)], "kept": [zstandard.compress(self.kept)], "counts": [packed(self.counts)], "numbers": [packed(self.numbers)], "places": [packed(self.dealt(buckets)[0])], "long": [self.long], "long_words": [[self.words[k] for k in self.long]]}
        kinds = {"chunk": pa.int64(), "n_words": pa.int32(), "long": pa.list_(pa.int32()), "long_words": pa.list_(pa.binary())}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()], names=list(columns))


def chunks(docs: DataFrame, keep: list[str], text_col: str, pattern: str, part: Callable[[Chunk], pa.RecordBatch], schema: str) -> DataFrame:
    """What `part` makes of the chunks of the documents."""
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], as_bytes(docs[f"`{text_col}`"]))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own, number = [], 0, TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = buffer_of(batch.column(k))
            for i, j in batches_of_rows(offsets, CHUNK_BYTES):
                more = offsets[j] - offsets[i] + 64 * (j - i)
                if held and size + more > CHUNK_BYTES:
                    yield part(Chunk(pa.concat_batches(held), pattern, (own, number)))
                    held, size, number = [], 0, number + 1
                held.append(batch.slice(i, j - i))
                size += more
        if held:
            yield part(Chunk(pa.concat_batches(held), pattern, (own, number)))

    bounded_batches(docs.sparkSession)
    return frame.toDF(*[f"c{i}" for i in range(k + 1)]).mapInArrow(run, schema)


CHANGED = "a chunk changed between two readings of the documents; checkpoint them before"


def filled(left: pa.Table, right: pa.Table, schema: pa.Schema, ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk with their ids."""
    if not left.num_rows:
        raise ValueError(CHANGED)
    lists = {c: right[c].combine_chunks() for c in ("first", "sizes", "ids")} if right.num_rows else None
    width = 2 if max(ranks.values(), default=0) < 1 << 16 else 4
    for row in left.to_pylist():
        numbers, places = unpacked(row["numbers"]), unpacked(row["places"])
        at, size, flat = (np.zeros(0, np.int32) for _ in range(3))
        if lists:
            many = lists["sizes"].value_lengths().to_numpy()
            at = np.repeat(lists["first"].to_numpy() - np.cumsum(many) + many, many) + np.arange(many.sum())
            if len(at) != len(places) or at.max() >= len(places):
                raise ValueError(CHANGED)
            at, size, flat = places[at], lists["sizes"].flatten().to_numpy().astype(np.int32), buffer_of(lists["ids"])[0].view(f">u{width}").astype(np.int32)
        long = [np.array(heap_fold(w, ranks), np.int32) for w in row["long_words"]]
        at = np.concatenate([at, np.array(row["long"], np.int32)])
        size = np.concatenate([size, np.array([len(x) for x in long], np.int32)])
        flat = np.concatenate([flat, *long])
        begin, length = np.full(row["n_words"], -1, np.int32), np.zeros(row["n_words"], np.int32)
        begin[at], length[at] = np.cumsum(size, dtype=np.int32) - size, size
        if (begin < 0).any():
            raise ValueError(CHANGED)
        offsets, ids = [0], []
        rows = np.concatenate([[0], np.cumsum(unpacked(row["counts"]))])
        for i, j in batches_of_rows(rows, SPLIT_BYTES):
            own = numbers[rows[i] : rows[j]]
            many = length[own]
            after = np.concatenate([[0], np.cumsum(many, dtype=np.int32)])
            ids.append(flat[np.repeat(begin[own] - after[:-1], many) + np.arange(after[-1], dtype=np.int32)])
            offsets += (offsets[-1] + after[rows[i + 1 : j + 1] - rows[i]]).tolist()
        kept = next(iter(pa.ipc.open_stream(zstandard.decompress(row["kept"]))))
        ids = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
        yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], schema=schema)


class Tokenizer:
    """One vocabulary in one session."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark, self.ranks, self.pattern = spark, ranks, pattern
        self.literals, self.pieces = Literals(spark), None

    def encode(self, docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
        """The kept columns (all) and the ids of each text; a name that one of them has is underscored."""
        keep = docs.columns if keep is None else keep
        out = new_name(keep, out)
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = BUCKETS * many
        body = chunks(docs, keep, text_col, self.pattern, lambda c: c.body(buckets), BODY)
        rows = chunks(docs, keep, text_col, self.pattern, lambda c: c.word_rows(buckets), WORDS).repartition(many, "bucket")
        cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("words", i * F.col("size") + 1, F.col("size")))
        words = rows.select("chunk", "bucket", "first", F.posexplode(cut).alias("place", "word")).withColumn("place", F.col("place") + F.col("first"))
        literals = Literals(self.spark)
        fold = Fold(literals, self.ranks)
        # One row for each list that came, its words' ids one after the other: no shuffle, as the rows are dealt by bucket.
        lists = fold.words(words).groupBy("chunk", "bucket", "first").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("all"))
        sizes = F.transform("all", lambda x: (F.octet_length(x["ids"]) / fold.width).cast("smallint"))
        pieces = lists.select(F.col("chunk").alias("of"), "first", sizes.alias("sizes"), joined_bytes(F.transform("all", lambda x: x["ids"])).alias("ids"))
        literals.drop()
        schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
        arrow, ranks = to_arrow_schema(schema), self.spark.sparkContext.broadcast(self.ranks)

        def fill(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches(filled(left, right, arrow, ranks.value), arrow)

        return body.groupBy("chunk").cogroup(pieces.groupBy("of")).applyInArrow(fill, schema)

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids. The column is to be used before `close`."""
        if self.pieces is None:
            pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
            for k, v in self.ranks.items():
                pieces[v] = k
            self.pieces = self.literals.array(pa.array(pieces, pa.binary()), "string")
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "").cast("binary")

    def close(self) -> None:
        """Drops what the session holds; frames made before keep their values."""
        self.literals.drop()
        self.pieces = None


def heap_fold(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The same merges in n log n: a heap of pairs over a linked list of pieces."""
    n = len(word)
    if whole and word in ranks:
        return [ranks[word]]
    start, end = list(range(n)), list(range(1, n + 1))
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, start[i], i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two pieces has changed since
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the query takes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The digest that the query op1_bpe returns."""
    spark = docs.sparkSession
    default = vocabulary() if path is None or pattern is None else ("", "")
    tokenizer = Tokenizer(spark, read_ranks(spark, path or default[0]), pattern or default[1])
    encoded = tokenizer.encode(docs, keep=["doc_id"])
    out = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(tokenizer.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
    tokenizer.close()
    return out

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: hashed words (weights that sum to 1 in square), one-hot bins of its
structure statistics (shares of symbols, digits, capitals, bars and lines, repeated words and lines,
word and line lengths) and of its metadata (length). The score's argument is

    b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

so all pairwise interactions cost time linear in the number of features. It is fitted with Adam on a
bounded sample of labelled rows (PER_CLASS of each class, weighted to the classes' true shares);
scoring reads every whole text.

Defined results: a null or empty text has no words and the statistics' lowest bins; without labelled
rows of both classes every score is 0.5, so nothing is rejected; repeated rows are scored alike; an
empty table gives an empty one; other columns stay untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import as_bytes, batches_of_rows, buffer_of, free_name, map_arrow, new_name, word_hashes, word_spans
from orderflow.llm.labelled import class_weights, remainder, sample, sigmoid

PER_CLASS = 3000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
WORD_BITS = 14
RANK = 8
BINS = 12
CHUNK = 2 << 20

#: Classes of bytes whose shares are statistics.
CLASSES = [b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"|", b"#$%&*+<=>@[\\]^_`{}~", b".!?", b",;:", b"\"'()-/", b"\n", b" \t\r", bytes(range(128, 256))]
_CLASS = np.zeros((len(CLASSES), 256), dtype=bool)
for _i, _c in enumerate(CLASSES):
    _CLASS[_i, list(_c)] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the largest count of one value."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    most = np.zeros(rows)
    np.maximum.at(most, r[new], np.diff(np.concatenate([new, [len(r)]])))
    return np.bincount(r[new], minlength=rows).astype(float), most


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows x STATS), and each word's row and bucket."""
    rows = len(offsets) - 1
    low, s, e, first = word_spans(raw, offsets)
    hashes = word_hashes(low, s, e)
    row = np.repeat(np.arange(rows), np.diff(first))
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    stats = [_sums(c[raw], offsets) / per_byte for c in _CLASS]
    size = (e - s).astype(np.int64)
    distinct, most = _distinct(row, hashes, rows)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    stats += [distinct / per_word, most / per_word, _sums(same, first) / per_word, _sums(size, first) / per_word, _sums(size > 12, first) / per_word, _sums(size < 3, first) / per_word]
    # Lines, by the byte sums between line ends.
    ends = np.flatnonzero(raw == 10)
    edge = np.unique(np.concatenate([ends, offsets[1:] - 1])) if len(raw) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], edge[:-1] + 1]) if len(edge) else edge
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.bincount(line_row, minlength=rows).astype(float)
    content = np.add.reduceat(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (np.arange(len(low), dtype=np.uint64) - np.repeat(begin, edge - begin + 1).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9), begin) if len(edge) else np.zeros(0, np.uint64)
    line_kinds, line_most = _distinct(line_row, content, rows)
    per_line = np.maximum(lines, 1)
    symbols = _CLASS[2][raw] | _CLASS[3][raw]
    after = np.zeros(len(raw), dtype=bool)
    after[1:] = symbols[1:] & symbols[:-1]
    stats += [line_kinds / per_line, line_most / per_line, np.log1p(n_bytes / per_line), np.log1p(n_words), np.log1p(n_bytes), _sums(after, offsets) / per_byte, per_byte / (n_words + 1)]
    return np.array(stats).T, row, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


class Machine:
    """The factorisation machine; `cuts` holds the bins' edges, one row for each statistic."""

    def __init__(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 128, steps: int = 384, seed: int = 11):
        # Few rows need smaller batches and more epochs for the same number of steps, else the scores stay
        # near the classes' shares and no threshold means anything.
        batch = min(batch, max(16, len(y) // 32))
        epochs = max(epochs, -(-steps // max(1, len(y) // batch)))
        raw, offsets = buffer_of(pa.array(texts, pa.binary()))
        parts = [features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in batches_of_rows(offsets, CHUNK)]
        stats = np.concatenate([p[0] for p in parts])
        self.cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        n = (1 << WORD_BITS) + BINS * stats.shape[1]
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = np.zeros(1), np.zeros(n), rng.normal(0, 0.02, (n, RANK))
        columns = [self._columns(*p) for p in parts]
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        row = np.concatenate([c[0] + base[i] for i, c in enumerate(columns)])
        col, val = (np.concatenate([c[k] for c in columns]) for k in (1, 2))
        order = np.argsort(row, kind="stable")
        row, col, val = row[order], col[order], val[order]
        start = np.searchsorted(row, np.arange(len(y) + 1))
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in "bwv"}
        step = 0
        for epoch in range(epochs):
            rate = 0.02 * 0.5 ** (3 * epoch / epochs)
            for ids in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                step += 1
                take = np.concatenate([np.arange(start[i], start[i + 1]) for i in ids])
                r, c, x = np.repeat(np.arange(len(ids)), start[ids + 1] - start[ids]), col[take], val[take]
                z, sums = self._linear(r, c, x, len(ids))
                d = weight[ids] * (sigmoid(z) - y[ids]) / len(ids)
                used, inverse = np.unique(c, return_inverse=True)
                dx = (d[r] * x)[:, None]
                gv = np.zeros((len(used), RANK))
                np.add.at(gv, inverse, dx * (sums[r] - self.v[c] * x[:, None]))
                grads = {"b": (np.array([0]), np.array([d.sum()])), "w": (used, np.bincount(inverse, dx[:, 0]) + 1e-5 * self.w[used]), "v": (used, gv + 1e-5 * self.v[used])}
                for k, (at, g) in grads.items():
                    m, s = state[k]
                    m[at] = 0.9 * m[at] + 0.1 * g
                    s[at] = 0.99 * s[at] + 0.01 * g * g
                    getattr(self, k)[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.99**step)) + 1e-8)

    def _columns(self, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' non-zero features: all words of a row share one weight, each bin weighs a third."""
        rows, k = stats.shape
        bins = np.stack([np.searchsorted(self.cuts[i], stats[:, i], side="right") for i in range(k)], axis=1)
        counts = np.bincount(row, minlength=rows)
        own = (np.arange(k) * BINS + bins + (1 << WORD_BITS)).ravel()
        return np.concatenate([row, np.repeat(np.arange(rows), k)]), np.concatenate([bucket, own]), np.concatenate([1 / np.maximum(counts, 1)[row], np.full(rows * k, 1 / 3)])

    def _linear(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        z = self.b[0] + np.bincount(row, self.w[col] * x, minlength=rows)
        sums = np.empty((rows, RANK))
        for f in range(RANK):
            one = self.v[:, f][col] * x
            sums[:, f] = np.bincount(row, one, minlength=rows)
            z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, one * one, minlength=rows))
        return z, sums

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [sigmoid(self._linear(*self._columns(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])), j - i)[0]) for i, j in batches_of_rows(offsets, CHUNK)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, held: tuple[int, int] = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    rows, sizes = sample(docs, labels, "quality", per_class=per_class, held=held, id_col=id_col, text_col=text_col)
    if set(sizes) != {0, 1}:
        return None

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, t) for batch in batches for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        y = np.array([y for _, y, _ in got])
        if len(set(y.tolist())) == 2:
            model = Machine([t for *_, t in got], y, class_weights(y, sizes))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample is bounded, so one task holds it; the driver gets the fitted weights alone.
    made = rows.select("id", "y", as_bytes("text").alias("t")).repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def score(docs: DataFrame, model: Machine | None, *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns and the score; a name that one of them has is underscored."""
    keep = docs.columns if keep is None else keep
    name = new_name(keep, name)
    hidden = free_name(docs, "__text")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], as_bytes(docs[f"`{text_col}`"]).alias(hidden))
    schema = T.StructType([*frame.schema.fields[: len(keep)], T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = buffer_of(batch.column(len(keep)))
        s = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(raw, offsets)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s)], names=schema.fieldNames())

    return map_arrow(frame, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the query op8_quality."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine | None) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    name = free_name(docs, "__score")
    return score(docs, model, name=name).where(F.col(name) >= THRESHOLD).drop(name)

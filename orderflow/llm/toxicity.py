"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: an ordinary one on windows of ordinary text, and a
toxic one on what sets toxic text apart, its segments at words that stand in many more contexts of toxic
than of ordinary text. Trained on whole toxic windows, the trainer picks what both classes share (the area
under the curve on held-out rows was 0.67 to 0.75). Every window of a document is compressed with the
ordinary dictionary alone and with both; the gain is the difference of the lengths. Bytes are widened to
two-byte codes first, so that a match on a short word is worth more than the cost of coding it. The
document's gains (mean, largest, share of large ones) are turned into a probability by thresholds
calibrated on labelled rows that the dictionaries have not seen.

Fitting uses a bounded sample of labelled rows (PER_CLASS of each class) and of their windows and segments
(MOST_SAMPLES of each class, those of least hash); scoring reads every whole text, window by window.
Defined results: a null or empty text has one empty window; without labelled rows of both classes every
score is 0; where there is too little text to train on, a dictionary is that text itself; repeated rows are
scored alike; an empty table gives an empty one; other columns stay untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import as_bytes, free_name, map_arrow, new_name
from orderflow.llm.labelled import Logistic, class_weights, remainder, sample

PER_CLASS = 4000
HELD_OUT = (4, 2)
WINDOW = 48
TOXIC_WORDS = 3000
#: Windows or segments that a dictionary is trained on, and the dictionaries' bytes (of widened text).
MOST_SAMPLES, ORDINARY_BYTES, TOXIC_BYTES = 60_000, 16 << 10, 4 << 10
LEAST_CONTEXTS, LEAST_LOG_ODDS = 5, 2.5
LEVEL = 9
THRESHOLD = 0.3

_CODES = np.random.default_rng(7).integers(0, 256, (256, 2), dtype=np.uint8)


def widened(text: bytes) -> bytes:
    return _CODES[np.frombuffer(text, np.uint8)].tobytes()


def windows(text: bytes) -> list[bytes]:
    """The text's words, lower-cased and space-joined, cut at the first space after WINDOW bytes."""
    whole = b" " + b" ".join(text.lower().split()) + b" "
    out, at = [], 0
    while True:
        end = whole.find(b" ", at + WINDOW)
        if end < 0:
            if at == 0 or end + len(whole) > at + 1:
                out.append(whole[at:])
            return out
        out.append(whole[at : end + 1])
        at = end


_EDGE = b".,;:!?"


def segments(text: bytes, words: frozenset[bytes]) -> list[bytes]:
    """Each of the words where it stands in the text, with the spaces around it."""
    return [b" " + w + b" " for w in text.lower().split() if w.strip(_EDGE) in words]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard's trainer makes of widened samples; these themselves if they are too few."""
    wide = [widened(s) for s in samples]
    try:
        return zstandard.train_dictionary(size, wide, d=8, k=64).as_bytes()
    except zstandard.ZstdError:
        return b"".join(wide)[-size:]


class Dictionaries:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.content = ordinary or b"\0", toxic + ordinary or b"\0"
        self.compressors: list[zstandard.ZstdCompressor] = []

    def __getstate__(self) -> dict:
        return {"content": self.content, "compressors": []}

    def gains(self, text: bytes) -> np.ndarray:
        if not self.compressors:
            for content in self.content:
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=4 * WINDOW, dict_size=len(content), min_match=3, write_content_size=0)
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(compression_params=params)
                self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))
        a, b = (c.compress for c in self.compressors)
        wide = [widened(w) for w in windows(text)]
        return np.array([len(a(w)) - len(b(w)) for w in wide], dtype=np.float64)

    def features(self, text: bytes) -> list[float]:
        g = self.gains(text)
        top = np.sort(g)[::-1][:3]
        return [float(g.mean()), math.sqrt(max(0.0, float(g.mean()))), float(top[0]), float(top.mean()), float(g[g > 8].sum()) / math.sqrt(len(g)), float((g > 11).mean()), math.log(len(g))]


FEATURES = 7


def toxic_words(rows: DataFrame) -> frozenset[bytes]:
    """From (y, text) rows: counts of contexts are made by Spark, only the chosen words reach the driver."""
    words = rows.select("y", F.split(F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t-\r]+", " ")), " ").alias("w")).dropDuplicates(["y", "w"])
    pairs = words.select("y", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("before"), F.col("w").alias("word"))).alias("p")).where("p.word is not null and p.word <> ''")
    bare = lambda c: F.regexp_replace(c, r"^[.,;:!?]+|[.,;:!?]+$", "")
    contexts = pairs.select("y", bare("p.before").alias("before"), bare("p.word").alias("word")).distinct().groupBy("word").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("o"))
    odds = F.log((F.col("t") + 0.5) / (F.col("o") + 0.5))
    toxic = contexts.where((F.col("t") >= LEAST_CONTEXTS) & (odds > LEAST_LOG_ODDS) & (F.col("word") != "")).orderBy(F.desc(odds), "word").limit(TOXIC_WORDS)
    return frozenset(r.word.encode() for r in toxic.select("word").collect())


def fit_dictionaries(rows: DataFrame) -> Dictionaries:
    """From the bounded sample's (y, text) rows, in one task that keeps windows and segments alone."""
    words = toxic_words(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held[y]
                own += ((xxhash.xxh3_64_intdigest(s, len(own)), s) for s in (segments(text, words) if y else windows(text)))
                if len(own) > 8 * MOST_SAMPLES:
                    own.sort()
                    del own[MOST_SAMPLES:]
        ordinary, toxic = ([s for _, s in sorted(own)[:MOST_SAMPLES]] for own in held)
        made = [train(ordinary, ORDINARY_BYTES), train(toxic, TOXIC_BYTES)]
        yield pa.RecordBatch.from_arrays([pa.array([m]) for m in made], names=["ordinary", "toxic"])

    # Sorted, so that the same rows give the same dictionaries whatever their order was.
    one = rows.select("y", as_bytes("text").alias("t"), "id").repartition(1).sortWithinPartitions("id", "t").select("y", "t")
    return Dictionaries(*map(bytes, one.mapInArrow(run, "ordinary binary, toxic binary").first()))


class Model:
    def __init__(self, dictionaries: Dictionaries, calibration: Logistic):
        self.dictionaries, self.calibration = dictionaries, calibration

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.calibration.score(np.array([self.dictionaries.features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, held: tuple[int, int] = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Dictionaries from two thirds of the sample, calibration on the rest; None without both classes."""
    rows, sizes = sample(docs, labels, "toxic", per_class=per_class, held=held, id_col=id_col, text_col=text_col)
    if set(sizes) != {0, 1}:
        return None
    rows = rows.withColumn("third", F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(3)))
    dictionaries = fit_dictionaries(rows.where("third < 2"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batch: pa.RecordBatch) -> dict:
        x = [shared.value.features(t.as_buffer().to_pybytes()) for t in batch.column(1)]
        return {"y": batch.column(0), "x": pa.array(x, pa.list_(pa.float64()))}

    measured = map_arrow(rows.where("third = 2").select("y", as_bytes("text").alias("t")), measure, schema).collect()
    y = np.array([r.y for r in measured])
    if len(set(y.tolist())) < 2:
        return None
    return Model(dictionaries, Logistic(np.array([r.x for r in measured]), y, class_weights(y, sizes)))


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns and the score; a name that one of them has is underscored."""
    keep = docs.columns if keep is None else keep
    name = new_name(keep, name)
    hidden = free_name(docs, "__text")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], as_bytes(docs[f"`{text_col}`"]).alias(hidden))
    schema = T.StructType([*frame.schema.fields[: len(keep)], T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(len(keep))]
        s = np.zeros(len(texts)) if shared.value is None else shared.value.score(texts)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s)], names=schema.fieldNames())

    return map_arrow(frame, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the query op3_toxicity."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    name = free_name(docs, "__score")
    return score(docs, model, name=name).where(F.col(name) < THRESHOLD).drop(name)

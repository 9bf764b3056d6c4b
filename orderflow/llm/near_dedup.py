"""SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprints of 64 bits link at DISTANCE (3) or fewer differing bits. The bits are cut into three
segments of 22, 21 and 21 bits, each padded to a word of the perfect binary Golay code [23, 12, 7]:
every word lies within 3 bits of exactly one codeword, whose 12-bit index is its decoding. Of three
errors at most one segment can hold more than one, so two segments have at most one error each
(pigeonhole). A segment's keys are the indices that its word and all words one bit away decode to:
one key or six. A fingerprint stands under its home key (the decodings of two segments) and under all
combinations of their keys; a pair that agrees up to one error in both meets where one of them is at
home. Every such meeting is verified by the number of differing bits.

Exact copies are merged before anything is joined. In a bucket only verified links are kept, and a
task keeps no more of them than a spanning forest, so a bucket of n near copies leaves at most n - 1
rows. A key at home to more than HOT_HOMES fingerprints is dealt over several tasks by parts of its
homes. Components come from alternating large-star and small-star steps on the forest's edges.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; a text
of fewer than three words is one shingle; repeated rows and ids stay repeated rows; a null doc_id is a
row of its own in the result and is smaller than no id (a component without any id has a null
component_id); an empty table gives an empty one. Only the id and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import as_bytes, bounded_batches, checkpointed, map_arrow

SHINGLE = 3
DISTANCE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
PAIRS = ((0, 1), (0, 2), (1, 2))
HOT_HOMES = 20_000
#: Verified links that a task holds before it reduces them to a forest.
MOST_LINKS = 1 << 20


# Fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """`bytes.lower` and `bytes.split` change A-Z alone and split at space and \\t to \\r alone."""
    words = text.lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 1 << 16):
        many = min(n, at + (1 << 16)) - at
        grams = (b" ".join(g) for g in zip(*(words[at + k : at + k + many] for k in range(shingle)), strict=True)) if len(words) >= shingle else iter([b" ".join(words)])
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=many)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text and the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("same", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(2)], dtype=np.uint64)
        return {"doc_id": batch.column(0), "same": batch.column(1), "fp": pa.array(values.view(np.int64))}

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("same"), as_bytes(text_col).alias("t")), run, schema)


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


# The Golay code

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the [23, 12, 7] code.
GENERATOR = 0b110001110101
_TABLE: list[np.ndarray] = []


def decoding_table() -> np.ndarray:
    """For each 23-bit word the index of the one codeword within three bits."""
    if not _TABLE:
        words = np.zeros(4096, dtype=np.int64)
        for bit in range(12):
            words ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0)
        table = np.zeros(1 << 23, dtype=np.uint16)
        index = np.arange(4096, dtype=np.uint16)
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a ^ b for i, a in enumerate(one) for b in one[:i]), *(a ^ b ^ c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
        for e in errors:
            table[words ^ e] = index
        _TABLE.append(table)
    return _TABLE[0]


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Row by row: the home index first, then the others that one flipped bit leads to, -1 for none."""
    table = decoding_table()
    flips = np.array([0, *(1 << i for i in range(bits))])
    near = table[words[:, None] ^ flips].astype(np.int32)
    home = near[:, :1]
    others = np.sort(near, axis=1)
    repeat = np.zeros(others.shape, dtype=bool)
    repeat[:, 1:] = others[:, 1:] == others[:, :-1]
    others[repeat | (others == home)] = -1
    others = -np.sort(-others, axis=1)
    return np.concatenate([home, others[:, : max(1, int((others >= 0).sum(axis=1).max(initial=1)))]], axis=1)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row of the fingerprint and whether it is at home there."""
    u = fps.view(np.uint64)
    keys = [segment_keys((u >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64), bits) for at, bits in SEGMENTS]
    out = []
    for p, (a, b) in enumerate(PAIRS):
        both = (p << 24) + (keys[a][:, :, None] << 12) + keys[b][:, None, :]
        valid = (keys[a][:, :, None] >= 0) & (keys[b][:, None, :] >= 0)
        row, i, j = np.nonzero(valid)
        out.append((both[valid], row, (i == 0) & (j == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Links


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: each other member and the component's smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        if (lu == lv).all():
            break
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _bucket_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole buckets; rows come sorted by bucket. Homes are compared with members."""
    edge = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    size = end - start
    homes = np.add.reduceat(home.astype(np.int64), start)
    own = np.flatnonzero(home & np.repeat((size > 1) & (homes > 0), size))
    group = np.searchsorted(start, own, side="right") - 1
    i = 0
    pairs = np.cumsum(size[group]) if len(own) else np.zeros(0, np.int64)
    while i < len(own):
        before = int(pairs[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(pairs, before + (1 << 21), side="right")))
        n = size[group[i:j]]
        left = np.repeat(own[i:j], n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[i:j]], n)
        x = fp[left] ^ fp[right]
        good = (np.bitwise_count(x.view(np.uint64)) <= distance) & (x != 0)
        yield fp[left[good]], fp[right[good]]
        i = j


def links(fps: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """A forest (a, b) over distinct fingerprints `fp` with the components of all links."""
    key_type = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())])
    only = fps.select("fp")

    def homes(batch: pa.RecordBatch) -> dict:
        key, _, home = bucket_keys(batch.column(0).to_numpy())
        return {"key": pa.array(key[home].astype(np.int32))}

    # Keys at home to many fingerprints: at most 3 n / HOT_HOMES, each dealt over several salts.
    at_home = map_arrow(only, homes, T.StructType([key_type["key"]]))
    hot = {r.key: -(-r["count"] // HOT_HOMES) for r in at_home.groupBy("key").count().where(F.col("count") > HOT_HOMES).collect()}
    hot_key = np.array(sorted(hot), dtype=np.int64)
    hot_salts = np.array([hot[k] for k in sorted(hot)], dtype=np.int64)

    def keyed(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy()
        key, row, home = bucket_keys(fp)
        salt = np.zeros(len(key), dtype=np.int64)
        if len(hot_key):
            near = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
            salts = np.where(hot_key[near] == key, hot_salts[near], 1)
            part = fp[row].view(np.uint64) % salts.astype(np.uint64)
            again = np.repeat(np.arange(len(key)), salts)
            salt = np.arange(len(again)) - np.repeat(np.cumsum(salts) - salts, salts)
            home = home[again] & (part[again] == salt)
            key, row = key[again], row[again]
        return {"key": pa.array(key.astype(np.int32)), "salt": pa.array(salt.astype(np.int32)), "fp": pa.array(fp[row]), "home": pa.array(home)}

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0

        def work(table: pa.Table) -> None:
            nonlocal a, b, held
            key = table["key"].to_numpy().astype(np.int64) << 32 | table["salt"].to_numpy()
            for x, y in _bucket_links(key, table["fp"].to_numpy(), table["home"].to_numpy(), distance):
                a.append(x)
                b.append(y)
                held += len(x)
                if held > MOST_LINKS:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], 0

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if rest and (key[0], salt[0]) != last:
                work(pa.Table.from_batches(rest))
                rest = []
            last = (key[-1], salt[-1])
            cut = int(np.argmax((key == key[-1]) & (salt == salt[-1])))
            if cut:  # the last bucket may go on in the next batch
                work(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            work(pa.Table.from_batches(rest))
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            for at in range(0, len(x), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000]), pa.array(y[at : at + 10_000])], names=["a", "b"])

    buckets = map_arrow(only, keyed, key_type).repartition("key", "salt").sortWithinPartitions("key", "salt")
    bounded_batches(fps.sparkSession)
    return buckets.mapInArrow(verified, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that is not its component's smallest, by large-star and small-star."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: each node's larger neighbours go to the smallest of the neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Each side of a join is a stored table, so a node with very many neighbours can be split.
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        # Small star: each node and its smaller neighbours go to the smallest of these.
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()
        edges = checkpointed(small)
        # Stars alone are left when no node is both a member and a root; the sums then stand still.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _classes(docs: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of the rows, and (fp, root, component_id) of the distinct fingerprints."""
    fps = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, distance=distance))
    classes = checkpointed(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # As in `components`: two stored tables, so a root with very many members can be split.
    smallest = checkpointed(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    return fps, classes.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable)."""
    fps, classes = _classes(docs, id_col, text_col, distance)
    # `fp` may be hot (a third of all rows alike): the inner join's large partitions can be split.
    return fps.join(classes, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One document of each component, that with the smallest id, any id before none; of rows that share
    it, the one whose text, then whole row, has the smallest hash. The columns stay."""
    fps, classes = _classes(docs, id_col, text_col, distance)
    rows = fps.join(classes, "fp").groupBy("root", "doc_id", "same").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "n")).alias("c"))
    chosen = checkpointed(first.select(F.col("c.doc_id").alias("doc_id"), F.col("c.same").alias("same"), F.col("c.n").alias("n")))
    mine = lambda rows: docs.join(rows, (text_hash(text_col) == rows["same"]) & docs[id_col].eqNullSafe(rows["doc_id"]), "left_semi")
    once = mine(chosen.where("n = 1").alias("a"))
    # Repeated rows of one id and text: partial aggregation keeps one of each partition.
    again = mine(chosen.where("n > 1").alias("b"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Maps have no hash; their rows are told apart by their JSON.
    mapped = "map<" in docs.schema.simpleString()
    order = F.xxhash64(F.to_json(whole)) if mapped else F.xxhash64(whole)
    least = again.groupBy(F.col(id_col).alias("k0"), text_hash(text_col).alias("k1")).agg(F.min_by(whole, order).alias("r"))
    return once.unionByName(least.select("r.*"))

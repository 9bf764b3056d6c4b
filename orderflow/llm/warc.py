"""WARC archives: captures written as records, and records put together again as captures.

Writing: a capture becomes three records: the request, the response (or a revisit, where an earlier
capture has the same payload) and metadata with the capture's keys as JSON. The request and the metadata
name the response in WARC-Concurrent-To. Equal payloads are found by their SHA-256: an aggregate gives
the groups of two and more with their smallest key, a table whose size is known, so that it is broadcast
only below spark.sql.autoBroadcastJoinThreshold and joined by a salted shuffle beyond. Files are written
by Spark's own committed writer (record by record, with the separator that ends a WARC record), so a lost
executor leaves no half-written archive; a file holds about FILE_BYTES, or one longer record.

Reading: files, compressed by member or not, are cut into records by their declared lengths, whatever a
payload holds. Digests are taken from the payloads as they are read.

Assembly: each request and metadata record is joined to the response that it is concurrent to: directly,
in either direction, or through other records of its transaction, one more step in each round until no
record is added. A capture is then one nested row. A revisit has no payload of its own: `resolved` joins
it by its payload digest with the response of the smallest key.

Defined results: a null payload is empty; payloads below LEAST bytes are always responses; captures with
a null key are responses and nothing refers to them; repeated rows stay repeated (the ones with the
smallest key are all responses); null urls have no WARC-Target-URI, and in others white space and control
characters are written as %XX (the metadata keep the keys exactly); records repeated in the archives
count once; a request or metadata record without a response is a capture of its own; what isn't a record
is passed over up to the next one, and given as a row with `error`; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import BATCH_BYTES, as_bytes, bounded_batches, checkpointed, drop_path, shared_path, stored

#: Bytes of payload from which an equal one is a revisit; bytes of an archive file; parts of a joined group.
LEAST, FILE_BYTES, SALTS = 100, 16 << 20, 16
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
HEADS = ("response", "revisit", "resource")


# Writing


def _header(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + END.encode() + block


def _safe(url: str | None) -> str | None:
    """White space and control characters as %XX."""
    return None if url is None else "".join("".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or ord(c) < 32 or 127 <= ord(c) < 160 else c for c in url)


def transaction(ids: tuple[str, str, str], keys: str, url: str | None, payload: bytes, digest: str, first: tuple[str | None] | None, date: str = DATE) -> list[bytes]:
    """Request, response or revisit, and metadata. `first` is, for a revisit, the url of what it repeats."""
    request, response, metadata = (f"<urn:uuid:{i}>" for i in ids)
    uri = _safe(url)
    host, _, path = (uri or "").partition("://")[2].partition("/")
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    if first is None:
        kind, more, block = "response", [], answer + payload
    else:
        kind, more, block = "revisit", [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _safe(first[0])), ("WARC-Refers-To-Date", date)], answer
    return [
        _header([("WARC-Type", "request"), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/http; msgtype=request")], ask),
        _header([("WARC-Type", kind), ("WARC-Record-ID", response), *common, *more, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")], block),
        _header([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/json")], keys.encode()),
    ]


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def write(captures: DataFrame, path: str, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, compression: str = "none") -> None:
    """Writes the archives into a new folder on a store that Spark reaches."""
    spark = captures.sparkSession
    payload = as_bytes(captures[f"`{payload_col}`"])
    rows = captures.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = rows.where((F.octet_length("payload") >= least) & F.col("key").isNotNull())
    groups = known.groupBy("digest").agg(F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    groups, at = stored(groups.select("digest", "first", "first_url"), "warc-groups")
    salted = groups.withColumn("known", F.lit(True)).select("digest", "first", "first_url", "known", _salts())
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    keys = F.to_json(F.struct(F.col("key").alias(key_col)), {"ignoreNullFields": "true"})
    made = joined.select(keys.alias("keys"), "url", "payload", "digest", F.coalesce(F.col("known") & (F.col("key") > F.col("first")), F.lit(False)).alias("again"), "first_url")
    run_id = uuid.uuid4().bytes

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, size, number, part = 0, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            shards, blocks, held = [], [], 0
            for keys, url, payload, digest, again, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = hashlib.blake2b(run_id + part.to_bytes(8, "big") + number.to_bytes(8, "big"), digest_size=48).digest()
                ids = tuple(str(uuid.UUID(bytes=own[i : i + 16], version=4)) for i in (0, 16, 32))
                number += 1
                made = transaction(ids, keys, url, payload, digest, (first_url,) if again else None)
                if size and size + sum(map(len, made)) > FILE_BYTES:
                    shard, size = shard + 1, 0
                size += sum(map(len, made))
                shards += [shard] * 3
                blocks += made
                held += sum(map(len, made))
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "record"])
                    shards, blocks, held = [], [], 0
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "record"])

    bounded_batches(spark)
    lines = made.mapInArrow(records, "shard int, record binary").select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").option("lineSep", END).option("compression", compression).text(path)
    drop_path(spark, at)


# Reading

RECORD = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("file", "record_id", "record_type", "target_uri", "date")], T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    *[T.StructField(c, T.StringType()) for c in ("refers_to_uri", "content_type", "declared_digest")], T.StructField("http_status", T.IntegerType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("block", T.BinaryType()), T.StructField("error", T.StringType()),
])


def _plain(content: bytes) -> bytes:
    """The archive without compression by members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest) + member.flush())
        rest = member.unused_data
    return b"".join(out)


def parse(content: bytes, file: str = "", payloads: bool = True) -> Iterator[dict]:
    """The records of an archive in their order."""
    content, pos = _plain(content), 0
    while True:
        while content[pos : pos + 2] == b"\r\n":
            pos += 2
        if pos >= len(content):
            return
        stop = content.find(b"\r\n\r\n", pos)
        fields: dict[str, list[str]] = {}
        lines = content[pos : max(stop, pos)].decode("utf-8", "replace").split("\r\n")
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        length = (fields.get("content-length") or [""])[0]
        row = dict.fromkeys(RECORD.fieldNames()) | {"file": file}
        if not lines[0].startswith("WARC/") or not length.isdecimal() or stop + 4 + int(length) > len(content):
            after = content.find(b"\r\nWARC/", pos + 1)
            yield row | {"error": f"no whole record at byte {pos}"}
            if after < 0:
                return
            pos = after + 2
            continue
        begin, one = stop + 4, lambda name: (fields.get(name) or [None])[0]
        block = content[begin : begin + int(length)]
        pos = begin + int(length)
        kind, http = one("warc-type"), (one("content-type") or "").startswith("application/http")
        row |= {"record_id": one("warc-record-id") or f"{file}#{begin}", "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to_uri": one("warc-refers-to-target-uri"), "content_type": one("content-type"), "declared_digest": one("warc-payload-digest")}
        body = block
        if http:
            at = block.find(b"\r\n\r\n")
            head, body = (block[:at], block[at + 4 :]) if at >= 0 else (block, b"")
            status = head.split(b"\r\n", 1)[0].split(b" ")
            if kind in HEADS and len(status) > 1 and status[1].isdigit():
                row["http_status"] = int(status[1])
        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "block": body if payloads or not http else None}
        yield row


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives below `path`; without `payloads`, those of HTTP records are
    measured and digested but not kept. A file is read by one task, and may have up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for row in parse(content.as_py(), file, payloads):
                    held.append(row)
                    size += len(row["block"] or b"") + 512
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,gz,warc}").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD)


# Assembly


def owners(records: DataFrame) -> DataFrame:
    """(record_id, head): the response of each other record that its transaction has one for. Links count in
    both directions; a record that is linked to several responses goes to the one with the smallest id."""
    spark = records.sparkSession
    heads = records.where(F.col("record_type").isin(*HEADS)).select("record_id").distinct()
    named = records.where("error is null").select("record_id", F.explode("concurrent_to").alias("other")).where("record_id <> other")
    links, links_at = stored(named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct().join(heads, "record_id", "left_anti"), "warc-links")
    known, written = None, []
    reached = heads.select(F.col("record_id").alias("other"), F.col("record_id").alias("head"))
    while True:
        new = links.join(reached, "other").groupBy("record_id").agg(F.min("head").alias("head"))
        if known is not None:
            new = new.join(known, "record_id", "left_anti")
        new, at = stored(new, "warc-owners")
        written.append(at)
        if new.isEmpty():
            break
        known = new if known is None else known.unionByName(new)
        links = links.join(new, "record_id", "left_anti")
        reached = new.select(F.col("record_id").alias("other"), "head")
    known = checkpointed(known if known is not None else spark.createDataFrame([], "record_id string, head string"))
    drop_path(spark, links_at, *written)
    return known


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, target_uri, date, response, requests, metadata (structs of the
    records' other columns). The records are read more than once, so they had better be a stored table."""
    whole = records.where("error is null and record_type in ('response', 'revisit', 'resource', 'request', 'metadata')")
    rest = [c for c in records.columns if c not in ("error",)]
    is_head = F.col("record_type").isin(*HEADS)
    others = whole.where(~is_head).join(owners(whole), "record_id", "left").withColumn("head", F.coalesce("head", "record_id"))
    rows = whole.where(is_head).withColumn("head", F.col("record_id")).unionByName(others.select(*records.columns, "head"))
    one = F.struct(*rest)
    of = lambda kind: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("record_type") == kind, one))))
    grouped = rows.groupBy(F.col("head").alias("capture_id")).agg(F.min(F.when(is_head, one)).alias("response"), of("request").alias("requests"), of("metadata").alias("metadata"))
    first = F.coalesce(F.col("response"), F.get("requests", F.lit(0)), F.get("metadata", F.lit(0)))
    return grouped.select("capture_id", first["target_uri"].alias("target_uri"), first["date"].alias("date"), "response", "requests", "metadata")


def resolved(captures: DataFrame, key: str, keys: str) -> DataFrame:
    """key, url, payload_bytes, payload_digest, record_type, refers_to of each capture that has a response.
    The key is read from the metadata by its DDL `keys`; a revisit takes the size and the key of the
    response with its digest that has the smallest key."""
    told = F.from_json(F.get("metadata", F.lit(0))["block"].cast("string"), keys)
    rows = captures.where("response is not null").select(told[key].alias("key"), F.col("target_uri").alias("url"), F.col("response.record_type").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"), F.when(F.col("response.record_type") == "revisit", F.regexp_replace("response.declared_digest", "^sha256:", "")).otherwise(F.col("response.payload_digest")).alias("payload_digest"))
    rows = checkpointed(rows)
    own, again = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = again.select("payload_digest").distinct()
    first = own.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("key").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"))
    salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")
    told = again.withColumn("salt", salt).join(first.select("*", _salts()), ["payload_digest", "salt"], "left")
    columns = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.withColumn("refers_to", F.lit(None).cast(rows.schema["key"].dataType)).select(columns).unionByName(told.select(columns))


def report(pages: DataFrame) -> DataFrame:
    """What the query op11_warc returns: archives written, read back, put together, and removed."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    write(pages, path)
    keys = f"page_id {pages.schema['page_id'].dataType.simpleString()}"
    # The archives are read once; what is put together are their records without the payloads.
    columns = ["record_id", "record_type", "target_uri", "date", "concurrent_to", "declared_digest", "payload_bytes", "payload_digest", "block", "error"]
    records, records_at = stored(read(spark, path, payloads=False).select(columns), "warc-records")
    drop_path(spark, path)
    out = checkpointed(resolved(assemble(records), "page_id", keys).withColumnRenamed("key", "page_id").drop("url"))
    drop_path(spark, records_at)
    return out


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id > first then first end as refers_to from f
"""

"""WARC archives, written and read back by boundary chains (operator 5).

Records are compressed one by one, as archives usually are, or stored plain. Reading splits an archive into byte ranges.
A task finds every place in its range where the version line of a record (or the first bytes of a compressed one)
stands, reads the record there and emits the place with its successor: where the next record must start if this one is
real. Payloads may hold such bytes too, and whole records even, so places prove nothing by themselves: pointer jumping
from the start of each file keeps those that the chain reaches, doubling the jump each round.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, small_batches, written
from .files import open_file, whole_file

MAGIC = b"WARC/1.0\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def decide(pages: DataFrame, least: int = 1000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, digest (hex SHA-1 of the payload in UTF-8), type and refers_to, one row for each pair of id and payload.

    Of payloads that are equal and have at least that many bytes, those with the largest id are responses and the
    others revisit it. Only ids and digests are shuffled, and copies are summed up before that.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).distinct()
    keep = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = rows.join(keep, "digest", "left")
    revisit = F.col("kept").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("kept")))
    return judged.select("id", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def record(page: object, url: str | None, payload: bytes, date: str) -> bytes:
    """A response."""
    fields = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return _head(page, url, "response", hashlib.sha1(payload).hexdigest(), date, fields) + payload + b"\r\n\r\n"


def revisit(page: object, url: str | None, digest: str, length: int, refers: object, date: str) -> bytes:
    """A record without a block that says the digest and length of the payload that it stands for."""
    fields = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers)), ("X-Payload-Length", str(length)), ("Content-Length", "0")]
    return _head(page, url, "revisit", digest, date, fields) + b"\r\n\r\n"


def _urn(page: object) -> str:
    """A page's name: its id as text, what isn't safe in a URI escaped; a null id has a name of its own."""
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def _page(name: str) -> str | None:
    return unquote(name[10:-1]) if name.startswith("<urn:page:") and name.endswith(">") else None


def _head(page: object, url: str | None, kind: str, digest: str, date: str, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    return b"".join([MAGIC, *(f"{k}: {v}\r\n".encode() for k, v in [*head, *more]), b"\r\n"])


def write_warc(pages: DataFrame, uri: str, *, least: int = 1000, most: int = 1 << 28, compress: bool = True, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int]]:
    """Write a record for each row of pages into uri; (name, bytes) of each archive.

    A null html is an empty payload, a null url leaves its field out, a null id is written as such. Repeated rows are
    repeated records; copies of a payload under its largest id are all responses. An archive is closed when it passes
    most bytes. compress: each record is a gzip member of its own, and names end in .gz. Pages meet their verdict by id, so that copies don't meet in one task.
    """
    small_batches(pages.sparkSession)
    verdicts = decide(pages, least, id_col, html_col)
    full = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    kind = pages.schema[id_col].dataType.simpleString()

    def packed(data: bytes) -> bytes:
        return gzip.compress(data, 6, mtime=0) if compress else data

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            out = []
            for page, url, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((hashlib.sha1(payload).hexdigest(), len(payload), packed(record(page, url, payload, date))))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "url", "d", "bytes", "record"])

    # records are made before they are dealt out, so what is shuffled is compressed
    made = full.mapInArrow(responses, f"id {kind}, url string, d string, bytes long, record binary")
    rows = made.join(verdicts, made["id"].eqNullSafe(verdicts["id"]) & (F.col("d") == F.col("digest")))
    rows = rows.select(made["id"], "url", "d", "bytes", F.when(F.col("type") == "response", F.col("record")).alias("record"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        pending = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        one = next(pending, None)
        while one is not None:
            name, size = f"part-{task.partitionId():06d}-{n:04d}.warc{'.gz' * compress}", 0
            with whole_file(uri, name, task.taskAttemptId()) as f:
                while one is not None and size < most:
                    page, url, digest, length, data, refers = one
                    if data is None:
                        data = packed(revisit(page, url, digest, length, refers, date))
                    f.write(data)
                    size += len(data)
                    one = next(pending, None)
            n += 1
            yield pa.RecordBatch.from_pylist([{"name": name, "bytes": size}])

    return sorted((r.name, r.bytes) for r in rows.mapInArrow(run, "name string, bytes long").collect())


def _fields(head: bytes) -> dict[str, str] | None:
    """The fields of a header without its version line and closing empty line; None if it isn't one."""
    fields = {}
    for line in head.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields


def _plain(f: pa.NativeFile, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and successor of a plain record that starts at a place; None if none can be read there. A header is
    read on, twice as far each time, as long as its lines are fields."""
    n = 1024
    while True:
        head = f.read_at(min(n, size - at), at)
        if (end := head.find(b"\r\n\r\n")) >= 0:
            break
        lines = head[len(MAGIC) :].rpartition(b"\r\n")[0]
        if at + n >= size or lines and _fields(lines) is None:
            return None
        n *= 2
    fields, block = _fields(head[len(MAGIC) : end]), at + end + 4
    length = (fields or {}).get("content-length", "")
    if not (length.isascii() and length.isdigit()) or block + int(length) + 4 > size:
        return None
    return fields, f.read_at(int(length), block), block + int(length) + 4


def _compressed(f: pa.NativeFile, at: int, size: int) -> tuple[dict[str, str], bytes, int] | None:
    """The same of a record that is a gzip member; the member's end is the successor."""
    member, data, place = zlib.decompressobj(31), [], at
    try:
        while not member.eof and place < size:
            part = f.read_at(min(1 << 16, size - place), place)
            place += len(part)
            data.append(member.decompress(part))
            if not b"".join(data[:1])[: len(MAGIC)] == MAGIC[: len(data[0])]:
                return None
    except zlib.error:
        return None
    whole = b"".join(data)
    head, _, block = whole.partition(b"\r\n\r\n")
    fields = _fields(head[len(MAGIC) :]) if member.eof and whole.startswith(MAGIC) else None
    length = (fields or {}).get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(block) < int(length):
        return None
    return fields, block[: int(length)], place - len(member.unused_data)


def candidates(spark: SparkSession, uri: str, files: list[tuple[str, int]], split: int = 1 << 23) -> DataFrame:
    """file (its number), off, next, and the record's fields as read, for every place where a record can be read,
    whether one was written there or not. Splits of so many bytes are dealt to tasks; a task holds one
    split and one record at a time."""
    small_batches(spark, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name, size, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f, out = open_file(uri, name), []
                magic, read = (GZIP_MAGIC, _compressed) if name.endswith(".gz") else (MAGIC, _plain)
                data = f.read_at(min(end + len(magic) - 1, size) - begin, begin)
                for m in re.finditer(re.escape(magic), data):
                    if not (found := read(f, at := begin + m.start(), size)):
                        continue
                    fields, block, after = found
                    kind = fields.get("warc-type", "")
                    if kind == "revisit":
                        digest, n = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("x-payload-length", "0")
                    else:
                        digest, n = hashlib.sha1(block).hexdigest(), str(len(block))
                    page, refers = (_page(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                    out.append((i, at, after, page, int(n) if n.isdigit() else 0, digest, kind, refers))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "off", "next", "page", "bytes", "digest", "type", "refers"])

    listed = spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(files)], "file int, name string, size long")
    count = sum(-(-size // split) for _, size in files)
    places = listed.select("file", "name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("a"))
    places = places.withColumn("b", F.least(F.col("a") + split, F.col("size"))).repartition(min(max(1, count), 50_000), "file", "a")
    return places.mapInArrow(run, "file int, off long, next long, page string, bytes long, digest string, type string, refers string")


def reached(places: DataFrame) -> DataFrame:
    """Those rows (file, off) of places (file, off, next) that the chain from offset 0 of their file reaches.

    Round k knows the first 2**k records of each chain and, for every place, the one 2**k further on; a round joins
    the places with themselves once and doubles both. It ends when a round reaches nothing new.
    """
    now, known = written(places.selectExpr("file", "off", "next as jump", "off = 0 as seen"), "warc-chain"), -1
    while (n := now.where("seen").count()) != known:
        known = n
        further = now.select("file", F.col("off").alias("jump"), F.col("jump").alias("far"))
        marks = now.where("seen and jump is not null").select("file", F.col("jump").alias("off"), F.lit(True).alias("mark"))
        after = written(now.join(further, ["file", "jump"], "left").join(marks.distinct(), ["file", "off"], "left").selectExpr("file", "off", "far as jump", "seen or mark is not null as seen"), "warc-chain")
        forget(now)
        now = after
    return now.where("seen").select("file", "off")


def read_warc(spark: SparkSession, uri: str, files: list[tuple[str, int]], split: int = 1 << 23, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives, false starts in
    payloads left out. Ids are read as id_type; one that can't be is an error, none is null. Raises ValueError if a chain doesn't end with its file: then the archive is damaged."""
    places = written(candidates(spark, uri, files, split), "warc-places")
    real = places.join(reached(places.select("file", "off", "next")), ["file", "off"])
    sizes = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(files)], "file int, size long") if files else None
    if sizes is not None:
        bad = sizes.join(real.groupBy("file").agg(F.max("next").alias("end")), "file", "left").where("end is null or end <> size").limit(1).collect()
        if bad:
            raise ValueError(f"the records of {files[bad[0].file][0]} end at {bad[0].end}, the file at {bad[0].size}")
    return real.selectExpr(f"cast(page as {id_type}) as page_id", "bytes as payload_bytes", "digest as payload_digest", "type as record_type", f"cast(refers as {id_type}) as refers_to")

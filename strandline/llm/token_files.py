"""Token ids in Arrow files of fixed-size-list batches (operator 2).

A shard is an Arrow file (the stream format followed by a footer that has every batch's offset) whose batches hold two
fixed-size lists: ids (16 bits each where the vocabulary allows it, else 32) and mask (a bit for each token, 0 for
padding, eight to a byte, the first one highest). All sequences are equally long, so that sequence i lies at a
computable place and is read without a copy. Beside it is an Arrow file with the documents' ids and lengths in the same
order. Documents ascend by id over the shards, and in each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, small_batches
from .encoding import CachedEncoder
from .files import open_file, whole_file


class TokenFile:
    """Random access to a shard: len() sequences; [i] is (ids, mask bits) as NumPy views of the mapped file."""

    def __init__(self, uri: str, name: str):
        self.reader = pa.ipc.open_file(open_file(uri, name))
        self.sizes = [0]
        for i in range(self.reader.num_record_batches):
            self.sizes.append(self.sizes[-1] + self.reader.get_batch(i).num_rows)

    def __len__(self) -> int:
        return self.sizes[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = int(np.searchsorted(self.sizes, i, "right")) - 1
        batch, row = self.reader.get_batch(at), i - self.sizes[at]
        ids, mask = (batch.column(c).values.to_numpy(zero_copy_only=True) for c in ("ids", "mask"))
        width = batch.schema.field("ids").type.list_size
        return ids[row * width : (row + 1) * width], mask[row * width // 8 : (row + 1) * width // 8]


def write_token_files(
    docs: DataFrame, uri: str, tokenizer: str, *, end_id: int = 2, width: int = 2048, rows: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, str, int, int]]:
    """Write docs into uri and return (part, name, documents, tokens) of each shard, in the order of the documents.

    One range exchange by id; each task streams its range, encodes and writes it, holding at most rows sequences and one
    Arrow batch. end_id is appended to each document; a null text is empty. Rows with equal ids ascend by text; null
    ids come first. An empty table gives no shard. width: a multiple of eight. The list has one entry for each file, as a listing would.
    """
    small_batches(docs.sparkSession)
    if width % 8:
        raise ValueError("width must be a multiple of eight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():06d}.arrow", task.taskAttemptId()
        encoder, end = CachedEncoder.of(tokenizer), np.uint32(end_id).tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        small = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        schema = pa.schema([("ids", pa.list_(pa.uint16() if small else pa.uint32(), width)), ("mask", pa.list_(pa.uint8(), width // 8))])
        held: list[bytes] = []
        size = documents = tokens = 0

        def put(out: pa.RecordBatchWriter, last: bool) -> int:
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.uint16 if small else np.uint32)
            used = len(ids) if last else len(ids) // width * width
            held[:] = [ids[used:].astype("<u4").tobytes()]
            ids = np.pad(ids[:used], (0, -used % width))
            mask = np.packbits(np.arange(len(ids)) < used)
            for at in range(0, len(ids), rows * width):
                end = min(at + rows * width, len(ids))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids[at:end]), width), pa.FixedSizeListArray.from_arrays(pa.array(mask[at // 8 : end // 8]), width // 8)]
                out.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))
            return len(held[0]) // 4

        with whole_file(uri, name, attempt) as f, whole_file(uri, f"{name}.docs", attempt) as g, pa.ipc.new_file(f, schema) as out, pa.ipc.new_file(g, pa.schema([("id", first.schema.field(0).type), ("n_tokens", pa.int64())])) as index:
            for b in (b for some in ([first], batches) for b in some):
                lengths = []
                for text in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                    held += (text, end)
                    lengths.append(len(text) // 4 + 1)
                    size += lengths[-1]
                    if size >= rows * width:
                        size = put(out, False)
                documents, tokens = documents + len(lengths), tokens + sum(lengths)
                index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64())], names=["id", "n_tokens"]))
            if size:
                put(out, True)
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "documents": documents, "tokens": tokens}])

    order = F.col(id_col).asc_nulls_first()
    ordered = only(docs, id_col, text_col).repartitionByRange(order)
    shards = ordered.sortWithinPartitions(order, F.col(text_col)).mapInArrow(run, "part long, name string, documents long, tokens long")
    return sorted((r.part, r.name, r.documents, r.tokens) for r in shards.collect())


def read_token_files(spark: SparkSession, uri: str, shards: list[tuple[int, str, int, int]], id_type: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document of the shards: id_col, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32 (of its ids as little-endian unsigned 32-bit integers). One task for each shard, batch by batch."""
    small_batches(spark, 8192)
    base, rows = 0, []
    for _, name, _, tokens in shards:
        rows.append((name, base))
        base += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from read(name, at)

    def read(name: str, start: int) -> Iterator[pa.RecordBatch]:
        index = pa.ipc.open_file(open_file(uri, f"{name}.docs"))
        data = pa.ipc.open_file(open_file(uri, name))
        part, raw, at = 0, memoryview(b""), 0
        for i in range(index.num_record_batches):
            names, found = index.get_batch(i), []
            for n in names.column(1).to_pylist():
                crc, left = 0, 4 * n
                while left:
                    if at == len(raw):
                        column = data.get_batch(part).column(0)
                        raw, at, part = memoryview(column.values.to_numpy(zero_copy_only=True).astype("<u4").tobytes()), 0, part + 1
                    take = min(left, len(raw) - at)
                    crc, at, left = zlib.crc32(raw[at : at + take], crc), at + take, left - take
                found.append((start, n, crc))
                start += n
            yield pa.RecordBatch.from_arrays([names.column(0), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=["id", "start", "n_tokens", "ids_crc32"])

    places = spark.createDataFrame(rows, "name string, base long")
    out = f"id {id_type}, start long, n_tokens long, ids_crc32 long"
    return places.repartition(max(1, len(rows))).mapInArrow(run, out).withColumnRenamed("id", id_col)

"""Token-id output in segment files of shuffled planes.

A segment is one self-contained byte string, kept as one row of a Parquet
table in the shared folder, so Spark's commit protocol covers it::

    magic "SCPL", version, plane kind, block size, number of documents and ids
    document table: doc ids (signed 64 bit), null mask, token counts (unsigned 32 bit)
    chunk index: for each block its ids, and for each plane its place and size
    planes: each a zstandard frame

Each block of ``block`` ids is transposed into 4 byte planes or 32 bit planes,
so that the rarely changing high bits lie together and compress to almost
nothing. A segment ends with the first document that fills it, so every
document lies in one segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exchange_parts, shared_dir, ship_package, text_or_empty
from .tokens import public_path, tokenizer

MAGIC = b"SCPL"
HEADER = struct.Struct("<4sHHIQQ")
KINDS = {"byte": 4, "bit": 32}
SEGMENT_IDS = 1 << 20
BLOCK_IDS = 1 << 16
SEGMENT_SCHEMA = "shard int, segment int, start_in_shard long, n_docs long, n_ids long, blob binary"


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """Planes of a block: row p has byte (or bit) p of every id."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], size: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes])
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :size]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_segment(
    doc_ids: list[int | None], counts: list[int], ids: np.ndarray, kind: str = "byte", block: int = BLOCK_IDS, level: int = 3
) -> bytes:
    """One segment of the documents' ids, given one after another."""
    press = zstandard.ZstdCompressor(level=level).compress
    docs = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes() if doc_ids else b""
    table = press(docs + nulls + np.array(counts, dtype="<u4").tobytes())
    index, payload, place = [], [], 0
    for start in range(0, len(ids), block):
        part = ids[start : start + block]
        index.append(struct.pack("<I", len(part)))
        for plane in to_planes(part, kind):
            frame = press(plane.tobytes())
            index.append(struct.pack("<QI", place, len(frame)))
            payload.append(frame)
            place += len(frame)
    chunks = b"".join(index)
    head = HEADER.pack(MAGIC, 1, KINDS[kind], block, len(doc_ids), len(ids))
    return head + struct.pack("<II", len(table), len(chunks)) + table + chunks + b"".join(payload)


def decode_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a segment."""
    magic, version, planes, block, n_docs, n_ids = HEADER.unpack_from(blob)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of this format")
    kind = "byte" if planes == KINDS["byte"] else "bit"
    n_table, n_index = struct.unpack_from("<II", blob, HEADER.size)
    at = HEADER.size + 8
    expand = zstandard.ZstdDecompressor().decompress
    table = expand(blob[at : at + n_table])
    docs = np.frombuffer(table, dtype="<i8", count=n_docs).tolist()
    mask = np.frombuffer(table, dtype=np.uint8, count=(n_docs + 7) // 8, offset=8 * n_docs)
    null = np.unpackbits(mask, bitorder="little")[:n_docs].astype(bool)
    counts = np.frombuffer(table, dtype="<u4", count=n_docs, offset=8 * n_docs + len(mask)).astype(np.int64)
    index, base = at + n_table, at + n_table + n_index
    ids = np.empty(n_ids, dtype="<u4")
    entry = 4 + 12 * planes
    for k in range((n_ids + block - 1) // block):
        size = struct.unpack_from("<I", blob, index + k * entry)[0]
        frames = []
        for p in range(planes):
            place, length = struct.unpack_from("<QI", blob, index + k * entry + 4 + 12 * p)
            frames.append(expand(blob[base + place : base + place + length]))
        ids[k * block : k * block + size] = from_planes(frames, size, kind)
    return [None if n else d for d, n in zip(docs, null, strict=True)], counts, ids


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    kind: str = "byte",
    block: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode ``docs(doc_id, text)`` and write segments to ``path`` in ascending doc_id order.

    One range exchange sorts the texts; each task then tokenises its range once
    and writes its shard. Null ids come first, a null or empty text has only
    the end id, a very long one fills a segment of its own, equal doc_ids stay
    neighbours in any order, an empty table gives an empty file set, and columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = vocabulary or public_path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = tokenizer(vocabulary)
        segment = start = size = 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        raw: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), dtype="<u4")
            blob = encode_segment(doc_ids, counts, ids, kind, block)
            values = [shard, segment, start, len(doc_ids), len(ids), blob]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["shard", "segment", "start_in_shard", "n_docs", "n_ids", "blob"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc)
                    counts.append(len(ids) // 4 + 1)
                    raw += (ids, end)
                    size += counts[-1]
                    if size >= segment_ids:
                        yield flush()
                        segment, start, size = segment + 1, start + size, 0
                        doc_ids, counts, raw = [], [], []
        if doc_ids:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    (
        texts.repartitionByRange(exchange_parts(texts), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .mapInArrow(encode, SEGMENT_SCHEMA)
        .write.mode("overwrite")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read segments back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, ids.

    A row for each row that was written, null and repeated ids too; a file set
    without segments gives an empty result.
    """
    ship_package(spark)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row for each task of the writer
    base, place = {}, 0
    for row in sorted(totals, key=lambda r: r["shard"]):
        base[row["shard"]] = place
        place += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, start, blob = (batch.column(c)[k].as_py() for c in range(3))
                doc_ids, counts, ids = decode_segment(blob)
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(base[shard] + start + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments.select("shard", "start_in_shard", "blob").mapInArrow(decode, schema)


def output_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens"

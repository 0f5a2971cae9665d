"""Compressed token-id files of a corpus in document order, and their reader (operator 2)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.llm import id_coder
from tracewright.llm.common import cut, shared_dir, table
from tracewright.llm.tokens import ids_of

MAGIC = b"TWID2\0\0\0"
#: Blocks of a segment at most, but for a longer document, which is never split over segments.
SEGMENT_BLOCKS = 64
#: Blocks coded in step.
LANES = 1200
FILE = "file int, segment long, doc_ids array<long>, record binary"


def pack_segment(ids: list[bytes], blocks: list[np.ndarray], coded: list[np.ndarray]) -> bytes:
    """MAGIC; numbers of documents and blocks; the documents' numbers of ids; for each block its number of
    ids, number of words and the crc32 of its ids; the words of all blocks. All little-endian."""
    heads = np.array([[len(b), len(c), zlib.crc32(b.tobytes())] for b, c in zip(blocks, coded)], "<u4")
    return b"".join([MAGIC, struct.pack("<QQ", len(ids), len(blocks)), np.array([len(x) // 4 for x in ids], "<u8").tobytes(), heads.tobytes(), *(c.astype("<u4").tobytes() for c in coded)])


def unpack_segment(record: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The documents' numbers of ids, the blocks' heads and words."""
    if record[:8] != MAGIC:
        raise ValueError("not a token-id segment")
    docs, blocks = struct.unpack_from("<QQ", record, 8)
    sizes = np.frombuffer(record, "<u8", docs, 24)
    heads = np.frombuffer(record, "<u4", 3 * blocks, 24 + 8 * docs).reshape(-1, 3)
    words = np.frombuffer(record, "<u4", -1, 24 + 8 * docs + 12 * blocks)
    return sizes, heads, np.split(words, np.cumsum(heads[:, 1].astype(np.int64))[:-1]) if blocks else []


def _encoder(tokenizer: str, spaced: bool, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def flush(segments: list[tuple[list, list[bytes]]], file: int, number: int) -> pa.RecordBatch:
        blocks = []
        for _, ids in segments:
            whole = np.frombuffer(b"".join(ids), "<u4")
            blocks.append([whole[i : i + id_coder.BLOCK] for i in range(0, len(whole), id_coder.BLOCK)])
        coded = id_coder.encode([b for own in blocks for b in own])
        records, at = [], 0
        for (_, ids), own in zip(segments, blocks):
            records.append(pack_segment(ids, own, coded[at : at + len(own)]))
            at += len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * len(segments), pa.int32()), pa.array(range(number, number + len(segments)), pa.int64()), pa.array([d for d, _ in segments], pa.list_(pa.int64())), pa.array(records, pa.binary())],
            ["file", "segment", "doc_ids", "record"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number = TaskContext.get().partitionId(), 0
        tokens = ids_of(tokenizer, spaced)
        segments, docs, ids, size, blocks = [], [], [], 0, 0
        most = 4 * SEGMENT_BLOCKS * id_coder.BLOCK
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = tokens.encode(text.as_py()) + end
                if docs and size + len(own) > most:
                    segments.append((docs, ids))
                    blocks += -(-size // (4 * id_coder.BLOCK))
                    docs, ids, size = [], [], 0
                    if blocks >= LANES:
                        yield flush(segments, file, number)
                        number += len(segments)
                        segments, blocks = [], 0
                docs.append(doc)
                ids.append(own)
                size += len(own)
        if docs:
            segments.append((docs, ids))
        if segments:
            yield flush(segments, file, number)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end_id: int = 0) -> None:
    """Write the ids of docs (doc_id, text) in ascending doc_id order to a table of segments at path.

    Documents are dealt by ranges of doc_id and sorted there, so file f holds smaller ids than file f+1.
    A null text is empty and has the end id alone; null doc_ids come first; equal doc_ids lie side by side,
    ordered by text. No rows give an empty table.
    """
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_encoder(tokenizer, spaced, end_id), FILE)
        .write.parquet(path)
    )


def _decoder(last: str, of: Callable[[np.ndarray], bytes | int], kind: pa.DataType):
    """Segments to (file, segment, place, doc_id, n_tokens, last), where last is of() of the document's ids."""

    def flush(rows: list) -> pa.RecordBatch:
        parts = [unpack_segment(r["record"]) for r in rows]
        heads = np.concatenate([h for _, h, _ in parts])
        ids = id_coder.decode([w for _, _, own in parts for w in own], heads[:, 0].tolist())
        for n, (got, head) in enumerate(zip(ids, heads)):
            if zlib.crc32(got.tobytes()) != head[2]:
                raise ValueError(f"block {n} of segments {rows[0]['file']}/{rows[0]['segment']} and later ones is damaged")
        out: tuple[list, ...] = ([], [], [], [], [], [])
        at = 0
        for r, (sizes, own, _) in zip(rows, parts):
            whole = np.concatenate(ids[at : at + len(own)])
            at += len(own)
            for k, (doc, part) in enumerate(zip(r["doc_ids"], np.split(whole, np.cumsum(sizes.astype(np.int64))[:-1]))):
                for c, v in zip(out, (r["file"], r["segment"], k, doc, len(part), of(part))):
                    c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["file", "segment", "place", "doc_id", "n_tokens", last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, blocks = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                rows.append(row)
                blocks += len(unpack_segment(row["record"])[1])
                if blocks >= LANES:
                    yield flush(rows)
                    rows, blocks = [], 0
        if rows:
            yield flush(rows)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a table that write() made: file, segment, place, doc_id, n_tokens and ids (bytes,
    little-endian unsigned 32-bit). A block whose ids do not match its checksum raises an error."""
    return spark.read.schema(FILE).parquet(path).mapInArrow(_decoder("ids", np.ndarray.tobytes, pa.binary()), "file int, segment long, place int, doc_id long, n_tokens long, ids binary")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """read() with ids_crc32, the crc32 of a document's ids as read, in place of the ids, which stay in the worker that decodes them."""
    return spark.read.schema(FILE).parquet(path).mapInArrow(_decoder("ids_crc32", zlib.crc32, pa.int64()), "file int, segment long, place int, doc_id long, n_tokens long, ids_crc32 long")


def starts(docs: DataFrame) -> DataFrame:
    """docs of read() with start, the number of ids in all documents before it.

    Sums of files and segments (few rows a gigabyte) carry the count forward; documents never meet in one task.
    """
    segments = docs.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    files = segments.groupBy("file").agg(F.sum("n").alias("n"))
    # One row a file: as few as the partitions of the write.
    whole = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_before"))
    within = segments.select("file", "segment", (F.sum("n").over(Window.partitionBy("file").orderBy("segment")) - F.col("n")).alias("_ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file", "segment").orderBy("place")) - F.col("n_tokens")
    return docs.withColumn("_inside", inside).join(within, ["file", "segment"]).join(whole, "file").withColumn("start", F.col("_before") + F.col("_ahead") + F.col("_inside")).drop("_before", "_ahead", "_inside")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    # The ids of a document are checked and let go before its start is computed.
    docs = cut(checksums(spark, path), "token-index")
    return starts(docs).select("doc_id", "start", "n_tokens", "ids_crc32")

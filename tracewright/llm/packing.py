"""Best-fit packing of tokenized documents into sequences of bounded length (operator 1)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.common import table
from tracewright.llm.tokens import ids_of

#: Documents whose pieces one task packs together.
GROUP_DOCS = 4096

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each length and its offset there.

    A segment tree over the remaining capacities 0..capacity says which of them some open bin has; a
    document goes to a bin with the smallest remaining capacity that holds it, found by one walk up and
    one down the tree, so in O(log capacity) whatever the number of bins. Ties: longer first, then by
    position; among equal bins the one that got there last.
    """
    leaves = 1 << int(capacity).bit_length()
    count = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        node = leaves + n
        if not count[node]:  # up until a right neighbour has a bin, then down to its smallest leaf
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node + (count[2 * node] == 0)
        if node > 1:
            left = node - leaves
            at = open_bins[left].pop()
            while node:
                count[node] -= 1
                node >>= 1
        else:
            left, at = capacity, made
            made += 1
        bins[i], offsets[i] = at, capacity - left
        left -= n
        if left:
            open_bins[left].append(at)
            node = leaves + left
            while node:
                count[node] += 1
                node >>= 1
    return bins, offsets


def cut_pieces(tokenizer: str, spaced: bool, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) batches to batches of PIECE, one row a piece of at most length tokens."""
    end = np.asarray([end_id], "<u4").tobytes()
    wide = 4 * length

    def run(batches):
        ids = ids_of(tokenizer, spaced)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = ids.encode(text.as_py()) + end
                for k, i in enumerate(range(0, len(own), wide)):
                    part = own[i : i + wide]
                    for c, v in zip(rows, (doc, k, i // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


def pack_group(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        bins, offsets = best_fit(t.column("length").to_numpy(), capacity)
        first = t.column("_group")[0].as_py() << 32
        return t.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).drop_columns(["_group"])

    return run


def pack(docs: DataFrame, tokenizer: str, spaced: bool = False, length: int = 2048, end_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Documents as token pieces placed in sequences of at most length tokens.

    docs: doc_id, text (other columns are ignored). One row a piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Only documents longer than a sequence are cut. A null or empty text
    has the end id alone; a repeated row is packed again; a null doc_id stays null; no rows give no rows.

    Tasks pack groups of about group_docs documents, dealt by a hash, each best-fit decreasing. A group
    has at most one piece a document that isn't full, so its size is bounded however long a text is, and
    a group of hundreds of sequences wastes little more than the one it leaves open. Only lengths and
    checksums are shuffled, never texts or ids.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut_pieces(tokenizer, spaced, length, end_id), PIECE)
    # A group is a hash of the document, mixed with its pieces' lengths and checksums, so that rows of one id, or of none,
    # are dealt to many groups; only equal rows stay together, and a salt by place in the partition spreads these.
    salt = F.floor(F.monotonically_increasing_id() / group_docs)
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", salt), F.lit(groups))
    return (
        pieces.withColumn("_group", group)
        .groupBy("_group")
        .applyInArrow(pack_group(length), PIECE + ", sequence_id long, offset long")
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

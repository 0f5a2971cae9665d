"""Bottom-k sketches of documents (operator 10)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.common import table
from tracewright.llm.hashing import shingle_hashes, word_hashes

#: Hashes a sketch keeps. An estimate of a share p has a standard error of sqrt(p (1-p) / K) at most.
K = 128
SHINGLE = 5


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes of a text's shingles, ascending; of fewer shingles, all; of null or no words, none."""
    return np.unique(shingle_hashes(word_hashes(text), SHINGLE))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets of shingles, exactly, from their sketches."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while both sets have at most k shingles; of two empty sets 1, of one 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(both, a, True), b, True)) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; of an empty a 1."""
    if not len(a):
        return 1.0
    r, n = resemblance(a, b, k), distinct(merge(a, b, k), k)
    return min(1.0, r * n / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def _sketch_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [sketch(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(to_text, made), pa.string()), pa.array(map(distinct, made), pa.float64())], ["doc_id", "fingerprint", "n_shingles"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated distinct shingles) of docs (doc_id, text); equal texts have equal fingerprints."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch_column, "doc_id long, fingerprint string, n_shingles double")


_FIRST = -(1 << 63)


def _deal(bounds: list[int]):
    """Adds part, the number of the range a row's key is in, and ahead: false but for the copies of a range's
    first key that go to the range before it (those of the first range to the last one, ahead of it all)."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).fill_null(_FIRST).to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(edges, key, "right") - 1, 0)
            copies = np.flatnonzero(key == edges[part])
            own = pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool))], ["doc_id", "text", "part", "ahead"])
            yield own
            if len(copies):
                c = b.take(pa.array(copies))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(((part[copies] - 1) % len(edges)).astype(np.int32)), pa.array(np.ones(len(copies), bool))], own.schema.names)

    return run


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, then the row that follows it; see edited_pairs."""
    out: tuple[list, ...] = ([], [], [], [], [], [], [])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
    held = None
    done = False
    for b in batches:
        for doc, text, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(3).to_pylist()):
            if done:
                break
            text = text.as_py() or ""
            own = sketch(text)
            if held is not None:
                was, old, old_sketch = held
                n = len(old)
                new = old[: n - n // 2] + text[: n // 2]
                other = sketch(new)
                for c, v in zip(out, (was, n, hashlib.sha256(new.encode()).hexdigest(), to_text(old_sketch), to_text(other), resemblance(old_sketch, other), resemblance(old_sketch, own))):
                    c.append(v)
            held = (doc, text, own)
            done = ahead
        if len(out[0]) >= 1024:
            yield batch()
            for c in out:
                c.clear()
    if out[0]:
        yield batch()


def edited_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The fingerprint of each text, of its edited text, and how alike the sketches find it to that and to the next text.

    docs: doc_id, text; other columns are ignored. Edited: the last floor(n/2) of n code points replaced by the
    first as many, or all, of the next document's. Order: doc_id, null first, then a hash of the text for equal
    doc_ids; after the last document comes the first. A null text is empty. A single document follows itself.

    Texts are shuffled once, to ranges of doc_id. The bounds are doc_ids of the data, so each range's first row
    can be sent to the range before it too and no task needs another one's rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce("doc_id", F.lit(_FIRST))
    got = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("bounds")).first()
    bounds = sorted({got["low"], *(got["bounds"] or [])} - {None}) or [_FIRST]
    dealt = docs.mapInArrow(_deal(bounds), "doc_id long, text string, part int, ahead boolean")
    # The row that follows a range comes after it; after the last range that is a row with the smallest key.
    return (
        dealt.repartitionById(len(bounds), F.col("part"))
        .sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))

"""Counts of words inside tasks: each task sums its own before anything is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words whose counts a task holds before it passes them on; beyond it a word is passed on several times, and summed later.
HELD = 400_000


def byte_table(separators: bytes, breaks: bytes = b"") -> bytes:
    """A table for bytes.translate: A-Z to a-z, separators to blanks, breaks to line feeds, all else as it is."""
    return bytes(32 if c in separators else 10 if c in breaks else c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8, one at a time; null is empty."""
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py() or b""


def word_counts(docs: DataFrame, keys: list[str], split: Callable[[bytes], list[bytes]], by_row: bool = True) -> DataFrame:
    """keys, term, n (occurrences), docs (rows with the term; 0 unless by_row), in parts that have to be summed.

    keys are text without null.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key, (n, rows) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    columns = [pa.array([k] * len(some), pa.string()) for k in key]
                    columns += [pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([rows[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for *key, text in zip(*(batch.column(k).to_pylist() for k in keys), texts(batch)):
                words = split(text)
                n, rows = held.setdefault(tuple(key), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                if by_row:
                    rows.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return docs.select(*keys, "text").mapInArrow(count, ", ".join(f"{k} string" for k in keys) + ", term string, n long, docs long")


def by_text(name: str) -> Column:
    """A column as text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

"""Phrases whose words stand together more often than apart (operator 12).

A sketch of hashed cells bounds the count of every phrase, of one word or more, from above; phrases in cells that reach
the least count are counted exactly in one more pass over the texts, however many they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.llm.common import cut, small, table
from tracewright.llm.counting import byte_table, texts
from tracewright.llm.hashing import _BASE, _tables, mix
from tracewright.llm.radix_select import thresholds

LEAST, MOST_WORDS, INSIDE, RANKS, SCALE = 30, 4, 80, 2000, 2_000_000
#: A-Z to a-z, word separators to blanks, and what ends a piece to a line feed.
_PIECES = byte_table(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
#: Bytes of text hashed at once; cells and places of phrases that a task holds before it passes their counts on.
CHUNK, CELLS, PHRASES = 1 << 16, 4_000_000, 2_000_000
#: Heavy cells that the workers' filter has room for, of ROOM bits each. Where there are more, more of the other phrases pass
#: it as well; these are counted like the rest and dropped by their counts.
HEAVY, ROOM = 1 << 25, 32
#: Bits of a bucket: a language's phrases are summed by buckets, one at a time.
BUCKETS = 10
#: What a cell is multiplied by for its places in the filter.
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: A word's second hash is a polynomial in its bytes modulo a prime.
_PRIME, _ROOT = 4_294_967_291, 0x9E3779B1
_residues: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _chunks(data: bytes) -> Iterator[bytes]:
    """Parts of a text, cut where a piece ends; a piece that is too long is cut between words, its last words begin the next
    part as well, with a carriage return behind them, so that they can be told from words that are met for the first time."""
    at, carry = 0, b""
    while len(data) - at > CHUNK:
        end = data.rfind(b"\n", at, at + CHUNK)
        whole = end > at
        if not whole:
            end = data.rfind(b" ", at, at + CHUNK)
            if end <= at:
                end = min((i for i in (data.find(b"\n", at + CHUNK), data.find(b" ", at + CHUNK)) if i >= 0), default=len(data))
        part = carry + data[at:end]
        carry = b"\n" if whole else b" ".join(part[part.rfind(b"\n") + 1 :].rsplit(None, MOST_WORDS - 1)[1 - MOST_WORDS :]) + b"\r"
        yield part
        at = end
    yield carry + data[at:]


def _together(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, joined to parts of about CHUNK bytes, as pieces."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
        for part in _chunks(text.translate(_PIECES)):
            held.setdefault(lang, []).append(part)
            size[lang] += len(part)
            if size[lang] >= CHUNK:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _phrases(lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Where words begin and end, and for 1 to 4 words the first words of all phrases inside pieces with their hashes, but not
    of those that end before a carriage return: the part before has them."""
    own = np.frombuffer(data, np.uint8)
    gap = np.ones(len(own) + 2, bool)
    gap[1:-1] = (own == 32) | (own == 10) | (own == 13)
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = turns[::2], turns[1::2]
    power, inverse = _tables(len(own) + 1)
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * power[:-1], out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    piece = np.cumsum(own == 10, dtype=np.int32)[begin]
    fresh = np.ones(len(words), bool)
    if b"\r" in data:
        for at in np.flatnonzero(own == 13).tolist():
            fresh[np.searchsorted(begin, data.rfind(b"\n", 0, at)) : np.searchsorted(begin, at)] = False
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    found, running = [], words
    for k in range(1, MOST_WORDS + 1):
        if k > 1:
            running = running[:-1] * np.uint64(_BASE) + words[k - 1 :]
        first = np.flatnonzero((piece[: len(running)] == piece[k - 1 :]) & fresh[k - 1 :])
        found.append((k, first, mix(running[first] + salt + np.uint64(k))))
    return begin, end, found


def _second(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of each word of a part."""
    for k, base in enumerate((_ROOT, pow(_ROOT, -1, _PRIME))):
        while len(_residues[k]) <= len(data):
            _residues[k] = np.concatenate((_residues[k], _residues[k] * np.uint64(pow(base, len(_residues[k]), _PRIME)) % np.uint64(_PRIME)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.frombuffer(data, np.uint8) * _residues[0][: len(data)], out=total[1:])
    return (total[end] - total[begin]) % np.uint64(_PRIME) * _residues[1][begin] % np.uint64(_PRIME)


def _cells(k: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)) + np.uint64((k - 1) << bits)


def cell_bits(docs: DataFrame) -> int:
    """Bits of a cell, from the bytes of all texts: several cells for each word that there is room for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(20, (4 * size).bit_length() - 1)


def heavy_cells(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """(block, n, cells): the cells whose phrases occur least times or more together, as little-endian 64-bit numbers."""
    # 2^10 to 2^12 blocks for each length of phrases; more only where one would be for over 16 MB of text.
    shift = np.uint64(bits - max(10, min(12, bits - 20), bits - 26))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = cells >> shift
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            n = np.minimum(n, 255).astype(np.uint8)  # least is no more than that, so a cell stays heavy
            gaps = np.diff(cells, prepend=np.uint64(0))
            gaps[starts] = cells[starts] - (block[starts] << shift)
            gaps = gaps.astype(np.uint32)
            ends = [*starts[1:].tolist(), len(cells)]
            # Sorted cells as gaps, byte by byte, so that the high bytes, which are 0, cost nothing once compressed.
            packed = [gaps[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(starts.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int64)), pa.array(packed, pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary())], ["block", "gaps", "counts"])

        size = 0
        for batch in batches:
            for lang, data in _together(batch):
                for k, _, hashes in _phrases(lang, data)[2]:
                    held.append(_cells(k, hashes, bits))
                    size += len(hashes)
                if size > CELLS:
                    yield out()
                    size = 0
        if size:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of one block after the other; blocks come in order."""
        at, held = -1, []

        def out() -> pa.RecordBatch:
            both = np.sort(np.concatenate(held))  # a cell and, in the low byte, a count of it
            cells, n = both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            heavy = cells[starts][np.add.reduceat(n, starts) >= least] + (np.uint64(at) << shift)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(heavy)], pa.int64()), pa.array([heavy.tobytes()], pa.binary())], ["block", "n", "cells"])

        for batch in batches:
            for block, gaps, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at and held:
                    yield out()
                    held = []
                at = block
                cells = np.cumsum(np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64)
                held.append(cells << np.uint64(8) | np.frombuffer(counts, np.uint8))
        if held:
            yield out()

    parts = docs.mapInArrow(count, "block long, gaps binary, counts binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, n long, cells binary").where("n > 0")


def _places(cells: np.ndarray, turn: np.uint64, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bits of cells in a filter of 2^room bits."""
    at = (cells * turn) >> np.uint64(64 - room)
    return at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def heavy_filter(heavy: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the heavy cells, in bytes, and the bits of a place in it: at most 2^30 of them, 128 MB."""
    size = heavy.agg(F.sum("n")).first()[0] or 0
    room = max(16, (ROOM * min(size, HEAVY) - 1).bit_length())
    marks = np.zeros(1 << (room - 3), np.uint8)
    for r in heavy.select("cells").toLocalIterator():
        for turn in _TURNS:
            np.bitwise_or.at(marks, *_places(np.frombuffer(r["cells"], np.uint64), turn, room))
    return marks, room


def counted(docs: DataFrame, bits: int, heavy: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): how often each phrase of 1 to 4 words occurs inside pieces of its language's texts, overlaps included,
    and the empty phrase as often as there are words; only what occurs least times or more.

    Texts are passed once. A task counts the phrases in heavy cells, told apart by 64 bits of hashes and 32 of others, and
    passes them on as they are spelled, in buckets, a row each, where they are summed; what only shares a cell or a place in
    the filter with others goes by its sum.
    """
    marks, room = heavy_filter(heavy)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def spelled(places: list[tuple[bytes, list[np.ndarray]]]) -> tuple[list[int], list[bytes], list[bytes]]:
        """Buckets, the phrases of each by line, and their counts; places: of parts, the phrases' hashes and first and last bytes."""
        data, starts = b"".join(x for x, _ in places), np.cumsum([0, *(len(x) for x, _ in places[:-1])])
        first, second = (np.concatenate([x[j] for _, x in places]) for j in range(2))
        begin, end = (np.concatenate([x[j] + at for (_, x), at in zip(places, starts)]) for j in range(2, 4))
        order = np.argsort(first)
        one, two = first[order], second[order]
        if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
            order = np.lexsort((second, first))
            one, two = first[order], second[order]
        new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        n = np.diff(new, append=len(one))
        names = [b" ".join(data[a:b].split()) for a, b in zip(begin[order[new]].tolist(), end[order[new]].tolist())]
        bucket = (one[new] >> np.uint64(64 - BUCKETS)).astype(np.int64)
        turns = [*np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist(), len(bucket)]
        each = list(zip(turns[:-1], turns[1:]))
        return bucket[turns[:-1]].tolist(), [b"\n".join(names[a:b]) for a, b in each], [n[a:b].astype(np.int64).tobytes() for a, b in each]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held: dict[str, list[tuple[bytes, list[np.ndarray]]]] = {}
        total: Counter = Counter()
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, places in held.items():
                buckets, phrases, counts = spelled(places) if sum(len(x[0]) for _, x in places) else ([], [], [])
                buckets, phrases, counts = [*buckets, 0], [*phrases, b""], [*counts, np.int64(total[lang]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets, pa.int64()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], ["lang", "bucket", "phrases", "counts"])
            held.clear()
            total.clear()

        for batch in batches:
            for lang, data in _together(batch):
                begin, end, found = _phrases(lang, data)
                total[lang] += len(found[0][1])
                words, met = _second(data, begin, end), []
                for k, first, hashes in found:
                    cells = _cells(k, hashes, bits)
                    for turn in _TURNS:
                        place, bit = _places(cells, turn, room)
                        at = np.flatnonzero(own[place] & bit)
                        cells, first, hashes = cells[at], first[at], hashes[at]
                    second = words[first]
                    for j in range(1, k):
                        second = second * np.uint64(_BASE) + words[first + j]
                    met.append((hashes, second, begin[first], end[first + k - 1]))
                    size += len(first)
                held.setdefault(lang, []).append((data, [np.concatenate(x) for x in zip(*met)]))
                size += len(data) // 16
                if size > PHRASES:
                    yield from out()
                    size = 0
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of one bucket after the other; buckets come in order."""
        at, held = None, {}

        def out() -> pa.RecordBatch:
            kept = {phrase: n for phrase, n in held.items() if n >= least}
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(kept), pa.string()), pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array(list(kept.values()), pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            for lang, bucket, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, bucket) != at and held:
                    yield out()
                    held = {}
                at = lang, bucket
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    held[phrase] = held.get(phrase, 0) + n
        if held:
            yield out()

    parts = docs.mapInArrow(count, "lang string, bucket long, phrases binary, counts binary").repartition("lang", "bucket")
    return parts.sortWithinPartitions("lang", "bucket").mapInArrow(add, "lang string, phrase string, a long")


def ranked(phrases: DataFrame, words: DataFrame, total: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from phrases (lang, phrase, a), frequent words (lang, term, n) and total (lang, n)."""
    of = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).union(words.select("lang", "term", "n"))
    known = small(counts, 64 + F.octet_length("part") + F.octet_length("lang"))
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", of.alias("words")).select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, size - F.col("k")).alias("tail"))
    both = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    score = F.when(F.col("a") < (1 << 62) // SCALE, F.expr(f"{SCALE}L * a div (l + r)")).otherwise(wide)
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    # Every shorter run of words of a longer candidate, with the largest count of those.
    runs = phrases.select("lang", "a", of.alias("words")).where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    runs = runs.select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("i")).select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "a")
    longer = runs.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {INSIDE} * a")
    kept = cut(kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score"), "collocations")
    bounds = thresholds(kept.select("lang", F.col("score").alias("value")), ["lang"], ranks)
    top = kept.join(F.broadcast(bounds.select("lang", "bound")), "lang", "left").where("bound is null or score >= bound").drop("bound")  # a row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return top.withColumn("rank", place).where(F.col("rank") <= ranks).join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """The best-scoring phrases of each language of docs (text, lang): lang, rank, phrase, a, l, r, n, score.

    Null text is empty, null lang und; repeated rows count each time; ties go by count, then phrase; languages without a
    candidate, and no rows, give no rows; long texts are hashed in parts and counted whole. Other columns are not read.
    least is 255 at most.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    bits = cell_bits(own)
    counts = cut(counted(own, bits, cut(heavy_cells(own, bits, least), "heavy-cells"), least), "frequent-phrases")
    long = F.contains("phrase", F.lit(" "))
    words = counts.where(~long & (F.col("phrase") != "")).select("lang", F.col("phrase").alias("term"), F.col("a").alias("n"))
    return ranked(counts.where(long), words, counts.where("phrase = ''").select("lang", F.col("a").alias("n")), ranks)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))

"""An interpolated modified Kneser-Ney bigram model of a corpus, and scores by it (operator 5).

Training counts in Spark tasks: each task sorts and sums what it has read and sends every shard its part, as
one compressed row. A shard becomes sorted arrays in files of the shared folder, which scoring workers map
into memory and search; only pages that are touched are loaded, and all workers of a machine share them.
Words are 64-bit hashes; a word's place among the sorted hashes is its number, and a bigram's key is its two
numbers, so bigrams don't collide. Nothing but a few numbers a shard comes to the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.common import mounted, shared_dir, table
from tracewright.llm.hashing import word_hashes_of
from tracewright.llm.language_id import remainder

#: Tokens sorted together in a task, and about the bigrams of a shard.
CHUNK = 1_500_000
SHARD = 4_000_000
#: For bytes.translate: A-Z to a-z; the blanks that part words to one blank.
SPACE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: The end of a text, not the hash of any word that is likely. It also stands before the first word.
END = np.int64(0x5851F42D4C957F2D)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and END."""
    data = text.encode("utf-8", "surrogatepass").translate(SPACE_BYTES) if text else b""
    return np.append(word_hashes_of(data).view(np.int64), END)


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows in lots of about CHUNK tokens: (their batches, all tokens, tokens of each row)."""
    held, found, sizes, total = [], [], [], 0
    for b in batches:
        start = 0
        for i, t in enumerate(b.column(text)):
            own = tokens(t.as_py())
            found.append(own)
            sizes.append(len(own))
            total += len(own)
            if total >= CHUNK:
                held.append(b.slice(start, i + 1 - start))
                yield held, np.concatenate(found), np.array(sizes)
                held, found, sizes, total, start = [], [], [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if found:
        yield held, np.concatenate(found), np.array(sizes)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns as differences, their bytes dealt into planes, compressed."""
    whole = np.stack([np.diff(c.astype(np.int64), prepend=np.int64(0)) for c in columns])
    return zstandard.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _spread(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return list(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).reshape(columns, -1), axis=1))


def _rows(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row (shard, part) for each run of equal shards, ascending."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    parts = [_squeeze(*p) for p in zip(*(np.split(c, cuts) for c in columns))] if len(shard) else []
    return pa.RecordBatch.from_arrays([pa.array(shard[np.concatenate([[0], cuts])] if len(shard) else [], pa.int32()), pa.array(parts, pa.binary())], ["shard", "part"])


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[begin], *(np.add.reduceat(c[order], begin) for c in counts))


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Files that appear whole, so that a task can be run again at any time."""
    for kind, a in arrays.items():
        path = f"{folder}/{name}.{kind}.npy"
        with open(own := f"{path}.{os.getpid()}", "wb") as f:
            np.save(f, a)
        os.replace(own, path)


@lru_cache(4096)
def _map(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


@dataclass(frozen=True)
class Words:
    """The vocabulary: hashes in shards by range, of which starts has the first numbers; counts summed up to each word."""

    folder: str
    starts: np.ndarray
    before: np.ndarray

    @property
    def shards(self) -> int:
        return len(self.starts) - 1

    @property
    def n_tokens(self) -> int:
        return int(self.before[-1])

    @property
    def n_words(self) -> int:
        return int(self.starts[-1])

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> np.int64(32)) + np.int64(1 << 31)) * np.int64(self.shards) >> np.int64(32)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending hashes: their numbers (-1: unknown) and counts."""
        number, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        of = self.shard(hashes)
        for s in np.unique(of):
            own = slice(*np.searchsorted(of, [s, s + 1]))
            known = _map(f"{self.folder}/words-{s}.key.npy")
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
                hit = known[at] == hashes[own]
                number[own] = np.where(hit, at + self.starts[s], -1)
                count[own] = np.where(hit, _map(f"{self.folder}/words-{s}.count.npy")[at], 0)
        return number, count

    def before_each(self, number: np.ndarray) -> np.ndarray:
        """For ascending numbers: the training tokens of all words before each."""
        out = np.zeros(len(number), np.int64)
        of = np.searchsorted(self.starts, number, "right") - 1
        for s in np.unique(of):
            own = slice(*np.searchsorted(of, [s, s + 1]))
            out[own] = _map(f"{self.folder}/words-{s}.before.npy")[number[own] - self.starts[s]] + self.before[s]
        return out

    def gather(self, kind: str, number: np.ndarray) -> np.ndarray:
        """For ascending numbers: a column of the words' statistics."""
        out = np.zeros(len(number), np.int64)
        of = np.searchsorted(self.starts, number, "right") - 1
        for s in np.unique(of):
            own = slice(*np.searchsorted(of, [s, s + 1]))
            out[own] = _map(f"{self.folder}/stats-{s}.{kind}.npy")[number[own] - self.starts[s]]
        return out


@dataclass(frozen=True)
class Model:
    words: Words
    first_keys: np.ndarray
    discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    kinds: int
    word_rest: float

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """For ascending bigram keys: their training counts."""
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.first_keys, keys, "right") - 1
        for s in np.unique(of[of >= 0]):
            own = slice(*np.searchsorted(of, [s, s + 1]))
            known = _map(f"{self.words.folder}/pairs-{s}.key.npy")
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], _map(f"{self.words.folder}/pairs-{s}.count.npy")[at], 0)
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of things seen 1, 2, 3 and 4 times.

    Where one of these is 0, or a discount would leave 0..its count, all are n1 / (n1 + 2 n2), or 0.5 without n1.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    if min(n) > 0:
        found = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return y, y, y


def _count_words(words_shards: int):
    of = Words("", np.zeros(words_shards + 1, np.int64), np.zeros(1, np.int64))

    def run(batches):
        for _, found, _ in _chunks(batches, 0):
            keys, counts = np.unique(found, return_counts=True)
            yield _rows(of.shard(keys), keys, counts)

    return run


def _collect(batches: Iterator[pa.RecordBatch], columns: int) -> tuple[int, list[np.ndarray]]:
    """The one shard of this task, if any, and its columns put together."""
    from pyspark import TaskContext

    parts = [_spread(p.as_py(), columns) for b in batches for p in b.column(1)]
    return TaskContext.get().partitionId(), [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * columns


def _write_words(folder: str, shards: int):
    def run(batches):
        shard, (keys, counts) = _collect(batches, 2)
        if shard >= shards:
            return
        keys, counts = _summed(keys, counts)
        _save(folder, f"words-{shard}", key=keys, count=counts, before=np.cumsum(counts) - counts)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


def _numbered(words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes' numbers and counts, each token's place among them, and END's place."""
    keys, place = np.unique(np.append(found, END), return_inverse=True)
    number, count = words.find(keys)
    return number, count, place[:-1], place[-1]


def _pairs(place: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The place of what stands before each token; END before a text's first."""
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = end
    return before


def _count_pairs(words: Words, shards: int):
    def run(batches):
        for _, found, sizes in _chunks(batches, 0):
            number, count, place, end = _numbered(words, found)
            keys, counts = np.unique(number[_pairs(place, sizes, end)] << 32 | number[place], return_counts=True)
            # Were words independent, this would be the share of all tokens up to the pair: even shards, in key order,
            # and a frequent word's pairs fall into several.
            ahead = words.before_each(number[number >= 0])
            total = np.zeros(len(number)), np.zeros(len(number))
            total[0][number >= 0], total[1][number >= 0] = ahead, count[number >= 0]
            known = number[number >= 0]
            at = np.flatnonzero(number >= 0)
            a, b = at[np.searchsorted(known, keys >> 32)], at[np.searchsorted(known, keys & 0xFFFFFFFF)]
            share = (total[0][a] + total[1][a] * (total[0][b] / words.n_tokens)) / words.n_tokens
            yield _rows(np.minimum((share * shards).astype(np.int32), shards - 1), keys, counts)

    return run


def _write_pairs(words: Words, shards: int):
    def run(batches):
        shard, (keys, counts) = _collect(batches, 2)
        if shard >= shards:
            return
        keys, counts = _summed(keys, counts)
        _save(words.folder, f"pairs-{shard}", key=keys, count=counts)
        ones = [(counts == k).astype(np.int64) for k in (1, 2)] + [(counts > 2).astype(np.int64)]
        nothing = np.zeros(len(keys), np.int64)
        left = _summed(keys >> 32, *ones, nothing)
        right = _summed(keys & 0xFFFFFFFF, nothing, nothing, nothing, nothing + 1)
        both = _summed(*(np.concatenate(c) for c in zip(left, right)))
        rows = _rows(np.searchsorted(words.starts, both[0], "right") - 1, *both)
        n, seen = rows.num_rows, np.bincount(np.minimum(counts, 5), minlength=6)
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32())], ["shard", "part", "low", "seen", "pairs"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([int(keys[0]) if len(keys) else None], pa.int64()), pa.array([seen[1:5].tolist()], pa.list_(pa.int64())), pa.array([shard], pa.int32())],
            ["shard", "part", "low", "seen", "pairs"],
        )

    return run


def _write_stats(words: Words):
    def run(batches):
        shard, columns = _collect(batches, 5)
        if shard >= words.shards:
            return
        number, *columns = _summed(*columns)
        dense = {}
        for kind, c in zip(("one", "two", "more", "kinds"), columns):
            dense[kind] = np.zeros(int(words.starts[shard + 1] - words.starts[shard]), np.int64)
            dense[kind][number - words.starts[shard]] = c
        _save(words.folder, f"stats-{shard}", **dense)
        seen = np.bincount(np.minimum(dense["kinds"], 5), minlength=6)
        yield pa.RecordBatch.from_pydict({"total": pa.array([int(dense["kinds"].sum())], pa.int64()), "seen": pa.array([seen[1:].tolist()], pa.list_(pa.int64()))})

    return run


def train(texts: DataFrame, folder: str) -> Model:
    """A model of a DataFrame of one text column, in files under a folder that all workers can open."""
    spark = texts.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(4096, shuffled)
    counted = texts.mapInArrow(_count_words(shards), "shard int, part binary").repartitionById(shards, F.col("shard"))
    got = {r["shard"]: r for r in counted.mapInArrow(_write_words(folder, shards), "shard int, n long, tokens long").collect()}
    total = lambda key: np.concatenate([[0], np.cumsum([got[s][key] for s in range(shards)])]).astype(np.int64)
    words = Words(folder, total("n"), total("tokens"))
    pair_shards = max(shuffled, -(-words.n_tokens // SHARD))
    paired = texts.mapInArrow(_count_pairs(words, pair_shards), "shard int, part binary").repartitionById(pair_shards, F.col("shard"))
    at = shared_dir(spark, "pair-statistics")
    paired.mapInArrow(_write_pairs(words, pair_shards), "shard int, part binary, low long, seen array<long>, pairs int").write.parquet(at)
    found = spark.read.parquet(at)
    # A few numbers a shard.
    heads = {r["pairs"]: r for r in found.where("pairs is not null").select("pairs", "low", "seen").collect()}
    low, first_keys = np.iinfo(np.int64).max, np.zeros(pair_shards, np.int64)
    for s in range(pair_shards - 1, -1, -1):
        low = heads[s]["low"] if heads[s]["low"] is not None else low
        first_keys[s] = low
    placed = found.where("shard is not null").select("shard", "part").repartitionById(words.shards, F.col("shard"))
    stats = placed.mapInArrow(_write_stats(words), "total long, seen array<long>").collect()
    kinds = sum(r["total"] for r in stats)
    seen = np.sum([r["seen"] for r in stats], axis=0) if stats else np.zeros(5, np.int64)
    word_discount = discounts(seen[:4].tolist())
    rest = (word_discount[0] * seen[0] + word_discount[1] * seen[1] + word_discount[2] * seen[2:].sum()) / kinds if kinds else 1.0
    return Model(words, first_keys, discounts(np.sum([r["seen"] for r in heads.values()], axis=0).tolist()), word_discount, kinds, float(rest))


def _less(count: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    """Counts less the discount of their size."""
    return np.maximum(count - np.array([0.0, *discount])[np.minimum(count, 3)], 0.0)


def token_scores(model: Model, found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: whether training has it, its base score and its log10 probability by the model.

    p(w | v) = (c(vw) - D) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v) * p(w), where Nk(v) is the number of
    words seen k times after v; p(w) = (k(w) - D') / K + rest / (V + 1), where k(w) is the number of words seen
    before w and K the sum of these; after an unknown word, p(w). An unknown word has rest / (V + 1).
    """
    words = model.words
    number, count, place, end = _numbered(words, found)
    known = number >= 0
    stat = {}
    for kind in ("one", "two", "more", "kinds"):
        stat[kind] = np.zeros(len(number), np.int64)
        if known.any():
            stat[kind][known] = words.gather(kind, number[known])
    single = _less(stat["kinds"], model.word_discount) / max(model.kinds, 1) + model.word_rest / (words.n_words + 1)
    d = model.discount
    back = (d[0] * stat["one"] + d[1] * stat["two"] + d[2] * stat["more"]) / np.maximum(count, 1)
    before = _pairs(place, sizes, end)
    keys, at = np.unique(number[before] << 32 | number[place], return_inverse=True)
    both = np.where(known[before] & known[place], model.counts(keys)[at], 0)
    p = np.where(known[before], _less(both, d) / np.maximum(count[before], 1) + back[before] * single[place], single[place])
    base = np.log10((count + 1) / (words.n_tokens + words.n_words + 1))
    return known[place], base[place], np.log10(p)


def _score(model: Model):
    def run(batches):
        for rows, found, sizes in _chunks(batches, 1):
            hit, base, own = token_scores(model, found, sizes)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            whole = pa.Table.from_batches([b.select(["doc_id", "held_out"]) for b in rows]).combine_chunks()
            for b in whole.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat(hit.astype(np.int64), begin)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(own, begin))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score and perplexity of docs (doc_id, text, held_out).

    A null or empty text has the end token alone. Rows are scored each on their own; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "held_out")
    found = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(by=7) == 2)
    model = train(docs.where(~F.col("held_out")).select("text"), mounted(shared_dir(spark, "language-model")))
    found = score(docs, model).withColumn("train_tokens", F.lit(model.words.n_tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

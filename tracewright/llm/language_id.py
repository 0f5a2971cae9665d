"""Language identification by sparse multinomial logistic regression on character n-grams (operator 8)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.common import fresh, small, table

UNDETERMINED = "und"
#: Hash buckets of n-grams of 1 to ORDER characters.
BUCKETS_LOG2, ORDER = 15, 3
BUCKETS = 1 << BUCKETS_LOG2
#: The classifier is fitted on about this many labelled rows of each label, fewer where all together would exceed
#: ROWS, but never under LEAST_ROWS: the rows of a label are bounded, the labels are not.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 1200, 64 * 1200, 20
#: The pipeline's stage rejects documents that get less than this, beside those without a letter.
MIN_SCORE = 0.35
_WORDS = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 20


def letter_runs(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) of a text."""
    runs = _WORDS.findall(text) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    # Fractions, raised digits and the like are word characters, but no letters.
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's character n-grams and their counts; none if it has no letter.

    Lower case; anything but letters counts as one blank. Long texts are counted piece by piece.
    """
    runs = letter_runs(text)
    if not runs:
        return np.empty(0, np.int64), np.empty(0)
    points = np.frombuffer((" " + " ".join(runs).lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(points), _CHUNK):
        part = points[start : start + _CHUNK + ORDER - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(ORDER):
            if len(part) <= n:
                break
            code = code[: len(part) - n] * np.uint32(0x01000193) + part[n:] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((mixed >> np.uint32(32 - BUCKETS_LOG2))[:_CHUNK], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[found]
        return (x / max(np.linalg.norm(x), 1e-12)) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; und and 1 for a text without a letter."""
        found, counts = grams(text)
        if not len(found) or not self.languages:
            return UNDETERMINED, 1.0
        p = softmax(self.logits(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> Model:
    """Follow-the-regularised-leader with an elastic net, then a temperature from rows left out of it.

    rows: (language, buckets, counts). Per coordinate the weight is 0 while its gradient sum is within l1, else
    it follows from that sum, l2 and the root of its squared gradients; the bias has no penalty. A fifth of the
    rows only calibrates.
    """
    languages = sorted({r[0] for r in rows})
    known = {x: k for k, x in enumerate(languages)}
    df = np.zeros(BUCKETS)
    for _, found, _ in rows:
        df[found] += 1
    idf = np.log((1.0 + len(rows)) / (1.0 + df)) + 1.0
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    bias = np.zeros(len(languages))
    model = Model(languages, np.zeros((BUCKETS, len(languages))), idf, bias, 1.0)
    train, rest = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    order = np.random.default_rng(7)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(train)):
            language, found, counts = train[i]
            x = (1.0 + np.log(counts)) * idf[found]
            x /= max(np.linalg.norm(x), 1e-12)
            zs, ns = z[found], n[found]
            w = weights(zs, ns)
            wrong = softmax(x @ w + bias)
            wrong[known[language]] -= 1.0
            g = x[:, None] * wrong[None, :]
            more = ns + g * g
            z[found] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[found] = more
            bias -= 0.02 * wrong
    model.weights = weights(z, n)
    if rest and len(languages) > 1:
        logits = [(model.logits(f, c), known[x]) for x, f, c in rest]
        loss = lambda t: -sum(math.log(max(softmax(v / t)[k], 1e-300)) for v, k in logits)
        low, high = math.log(0.02), math.log(20.0)
        for _ in range(40):  # golden-section search over log temperature
            a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
            low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
        model.temperature = math.exp((low + high) / 2)
    model.weights = model.weights.astype(np.float32)
    return model


def remainder(doc_id: str = "doc_id", by: int = 5) -> Column:
    """crc32 of a doc_id as text, modulo by; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [grams(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.astype(np.int32) for f, _ in made], pa.list_(pa.int32())), pa.array([c for _, c in made], pa.list_(pa.float64()))], ["lang", "found", "counts"])


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as views into their common values."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def learn(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from labelled rows (doc_id, text, lang) whose doc_id is not held out.

    Per label about per_language rows are taken, by a hash of doc_id against a share from the label's count over
    all documents; with so many labels that this exceeds ROWS, an equal part of ROWS. A label with no more rows than
    that is taken whole, and every label is learned. Without labelled rows the model knows no language and answers und.
    """
    rows = docs.select("doc_id", "text", "lang").where((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    per_language = min(per_language, max(LEAST_ROWS, ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(small(shares, F.octet_length("lang") + 24), "lang").where(chance < F.col("share"))
    made = sample.select("lang", "text").mapInArrow(_features, "lang string, found array<int>, counts array<double>").toArrow()
    # Views into the batches, 12 bytes a gram, so the driver holds them once and lets go of them whole.
    found = [r for b in made.to_batches() for r in zip(b.column(0).to_pylist(), _parts(b.column(1)), _parts(b.column(2)))]
    # The order of arrival depends on the tasks; that of the fit must not.
    return fit(sorted((r for r in found if len(r[1])), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def _predictor(model: Model, kept: list[str], language: str = "lang_pred", score: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [model.predict(t.as_py()) for t in b.column("text")]
            columns = [*(b.column(c) for c in kept), pa.array([x for x, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, language, score])

    return run


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([bool(letter_runs(t.as_py())) for t in b.column("text")], pa.bool_()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row, from its text alone.

    A null text or one without a letter gets und with score 1. Of languages that score the same the first by name is
    taken. Equal texts get equal answers; a repeated row is answered again; no rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predictor(model, ["doc_id"]), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those whose language cannot be told: no letter, or a score under min_score.

    A model that has learned no language rejects no text with a letter.
    """
    if not model.languages:
        return docs.mapInArrow(_lettered, docs.schema)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    made = docs.mapInArrow(_predictor(model, names, pred, score), f"{schema}, `{pred}` string, `{score}` double")
    return made.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= min_score)).select(*names)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score")

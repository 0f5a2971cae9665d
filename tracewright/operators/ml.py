"""Comparison models: logistic regression on six features, a small convolution, and a language model's opinion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.ids import parse_probability
from tracewright.operators.features import PAYLOAD, TIMING

FEATURES = (*TIMING, *PAYLOAD)


def vectors(timing: DataFrame, payload: DataFrame) -> DataFrame:
    """(window_id, six raw checks in order)."""
    return timing.join(payload.select("window_id", *PAYLOAD), "window_id").select("window_id", *FEATURES)


def fit_logistic(labelled: DataFrame, c: float = 1.0, names: tuple[str, ...] = FEATURES):
    """An L2 logistic regression with balanced class weights on standardised features: (means, deviations, weights, bias).

    regParam is 1 / (C sum of weights), as the loss here is a mean over weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = labelled.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("a")).first()
    if not 0 < stats["a"] < stats["n"]:
        raise ValueError("both classes are needed")
    mean, dev = [stats[f"m_{n}"] for n in names], [stats[f"s_{n}"] or 1.0 for n in names]
    scaled = labelled.select(*[((F.col(n) - m) / s).alias(n) for n, m, s in zip(names, mean, dev)], F.col("is_attack").cast("double").alias("label"), F.when(F.col("is_attack"), stats["n"] / (2 * stats["a"])).otherwise(stats["n"] / (2 * (stats["n"] - stats["a"]))).alias("weight"))
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform(scaled)
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (c * stats["n"]), standardization=False, maxIter=200, tol=1e-9).fit(data)
    return mean, dev, list(model.coefficients), model.intercept


def logistic(features: DataFrame, model, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """features with attack_score and the feature that says most."""
    mean, dev, weights, bias = model
    terms = [((F.col(n) - m) / s * w).alias(n) for n, m, s, w in zip(names, mean, dev, weights)]
    total: Column = F.lit(float(bias))
    for t in terms:
        total = total + t
    most = F.greatest(*[F.abs(t) for t in terms])
    top = F.coalesce(*[F.when(F.abs(t) == most, F.lit(n)) for t, n in zip(terms, names)])
    return features.withColumns({"attack_score": 1.0 / (1.0 + F.exp(-total)), "evidence": F.concat(F.lit("largest contribution: "), top)})


def fit_folds(rows: DataFrame, c: float = 1.0, names: tuple[str, ...] = FEATURES, rounds: int = 60, tolerance: float = 1e-9) -> dict[str, np.ndarray]:
    """The logistic regressions of all models together: weights by model, the last one the bias.

    rows: model, is_attack and the features, a table. Each round sums every model's gradient and Hessian in one job, of which
    some 40 numbers a model come to the driver for Newton's step, halved where the loss has risen. Features are as they
    are; classes weigh alike; the penalty is half the squared weights against c times the summed loss, the bias is free.
    """
    sizes = {r["model"]: (r["n"], r["a"]) for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("a")).collect()}
    if bad := [m for m, (n, a) in sizes.items() if not 0 < a < n]:
        raise ValueError(f"both classes are needed: {sorted(bad)}")
    k = len(names) + 1
    x = [*[F.col(n).cast("double") for n in names], F.lit(1.0)]
    at = {m: np.zeros(k) for m in sizes}
    step = {m: np.zeros(k) for m in sizes}
    best, done = dict.fromkeys(sizes, math.inf), set()
    penalty = np.array([1.0] * len(names) + [0.0])
    schema = "model string, beta array<double>, up double, down double"
    for _ in range(rounds):
        trial = {m: at[m] + step[m] for m in sizes if m not in done}
        if not trial:
            break
        now = rows.sparkSession.createDataFrame([(m, b.tolist(), sizes[m][0] / (2 * sizes[m][1]), sizes[m][0] / (2 * (sizes[m][0] - sizes[m][1]))) for m, b in trial.items()], schema)
        z = sum((x[i] * F.get("beta", F.lit(i)) for i in range(k)), F.lit(0.0))
        own = rows.join(F.broadcast(now), "model").withColumn("z", z)  # a row a model
        y, weight = F.col("is_attack").cast("double"), F.when(F.col("is_attack"), F.col("up")).otherwise(F.col("down"))
        p = 1.0 / (1.0 + F.exp(-F.col("z")))
        loss = F.greatest("z", F.lit(0.0)) - F.col("z") * y + F.log1p(F.exp(-F.abs("z")))
        parts = [F.sum(weight * loss).alias("loss"), *[F.sum(weight * (p - y) * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(weight * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]]
        for r in own.groupBy("model").agg(*parts).collect():
            m, b = r["model"], trial[r["model"]]
            value = c * r["loss"] + (penalty * b * b).sum() / 2
            if value > best[m]:
                step[m] = step[m] / 2
                if np.abs(step[m]).max() < tolerance:
                    done.add(m)
                continue
            at[m], best[m] = b, value
            slope = c * np.array([r[f"g{i}"] for i in range(k)]) + penalty * b
            curve = np.array([[c * r[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(penalty)
            scale = 1 / np.sqrt(np.maximum(np.diag(curve), 1e-300))  # features differ by many powers of ten
            step[m] = -scale * np.linalg.lstsq(curve * np.outer(scale, scale), scale * slope, rcond=None)[0]
            if np.abs(step[m] / scale).max() < tolerance * max(1.0, np.abs(b / scale).max()):
                done.add(m)
    return at


def fold_scores(rows: DataFrame, weights: dict[str, np.ndarray], names: tuple[str, ...] = FEATURES) -> DataFrame:
    """rows with attack_score by the weights of their model."""
    now = rows.sparkSession.createDataFrame([(m, w.tolist()) for m, w in weights.items()], "model string, beta array<double>")
    z = sum((F.col(n).cast("double") * F.get("beta", F.lit(i)) for i, n in enumerate(names)), F.get("beta", F.lit(len(names))))
    return rows.join(F.broadcast(now), "model").withColumn("attack_score", 1.0 / (1.0 + F.exp(-z))).drop("beta")  # a row a model


def logistic_cv(vectors_: DataFrame, labels: DataFrame, captures: DataFrame, far: float) -> DataFrame:
    """Logistic regression over the folds of the development captures: (fold, boundary, capture_id, family, condition,
    attacked, detected, normal, false_alarms).

    Each fold's model learns from the train captures, all of them normal, and the other folds' labelled windows; its
    threshold comes from the validation captures. A masquerade recording's normal windows are its twin's and are left out.
    captures: capture_id, group, fold, family, kind. An error with fewer than two folds, or if a normal drive has an attack.
    """
    from tracewright.operators import calibrate, crossval
    from tracewright.operators.store import written

    own = vectors_.join(labels.select("window_id", "capture_id", "is_attack"), "window_id").join(captures.select("capture_id", "group", "fold", "kind", F.col("family").alias("recording_family")), "capture_id")
    own = written(own.where(~((F.col("group") == "development") & (F.col("kind") == "masquerade") & ~F.col("is_attack"))), "logistic")
    names = own.where("`group` = 'development'").select(F.col("fold").alias("model_fold")).distinct().withColumn("model", F.col("model_fold").cast("string"))
    if names.count() < 2:
        raise ValueError("cross-validation needs two folds or more")
    if own.where("`group` <> 'development' and is_attack").limit(1).count():
        raise ValueError("train and validation captures must be normal")
    every = own.join(F.broadcast(names))  # folds, of which there are a few
    train = every.where((F.col("group") == "train") | ((F.col("group") == "development") & (F.col("fold") != F.col("model_fold"))))
    weights = fit_folds(written(train.select("model", "is_attack", *FEATURES), "logistic-train"))
    scored = written(fold_scores(every.where((F.col("group") == "validation") | ((F.col("group") == "development") & (F.col("fold") == F.col("model_fold")))), weights), "logistic-scores")
    boundary = calibrate.thresholds(scored.where("`group` = 'validation'"), ["model"], far)
    held = scored.where("`group` = 'development'").join(boundary, "model").withColumn("alarm", crossval.alarm())
    return crossval.attack_folds(held, "boundary")


def convolve(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(windows, channels, bins) through a symmetric zero-padded convolution and a rectifier."""
    pad = weight.shape[2] // 2
    wide = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    parts = np.stack([wide[:, :, k : k + x.shape[2]] for k in range(weight.shape[2])], axis=-1)
    return np.maximum(np.einsum("ncbk,ock->nob", parts, weight) + bias[None, :, None], 0)


def forward(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    """Two convolutions, the mean over bins, a weighted sum and a sigmoid."""
    h = convolve(convolve(x, net["w1"], net["b1"]), net["w2"], net["b2"]).mean(axis=2)
    return 1 / (1 + np.exp(-(h @ net["w3"] + net["b3"])))


def timing_net(bins: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """(window_id, attack_score) of windows' bins by a net of given weights; windows go through it in batches."""
    one = F.array_sort(F.collect_list(F.struct("bin", "log_frames", "log_ids", "log_watched")))
    rows = bins.groupBy("window_id").agg(one.alias("b")).select("window_id", *[F.col(f"b.{c}").alias(c) for c in ("log_frames", "log_ids", "log_watched")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.stack([np.stack(p[c].to_list()) for c in ("log_frames", "log_ids", "log_watched")], axis=1)
                yield pd.DataFrame({"window_id": p["window_id"], "attack_score": forward(x, net)})

    return rows.mapInPandas(run, "window_id string, attack_score double")


def prompts(features: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(window_id, prompt): the six numbers (4 digits) and, if given, the latest value of each signal (2 digits) by name."""
    lines = [F.concat(F.lit(f"  {n}: "), F.round(n, 4).cast("string")) for n in FEATURES]
    text = F.concat_ws("\n", F.lit("One second of vehicle bus traffic, against what was learned from normal driving:"), *lines)
    own = features
    if signals is not None:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("signal", "value"))), lambda x: F.concat(F.lit("  "), x["signal"], F.lit(": "), F.round(x["value"], 2).cast("string"))), "\n")
        own = features.join(signals.groupBy("window_id").agg(listed.alias("_signals")), "window_id", "left")
        text = F.concat_ws("\n", text, F.when(F.col("_signals").isNotNull(), F.concat(F.lit("Latest signal values:\n"), F.col("_signals"))))
    ask = F.lit('Answer with JSON: {"attack_probability": 0 to 1, "reason": "..."}')
    return own.select("window_id", F.concat_ws("\n", text, ask).alias("prompt"))


def opinions(prompts_: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """(window_id, attack_score, evidence) from a text generator, which gets the prompts of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"window_id": p["window_id"], "answer": generate(p["prompt"].to_list())})

    got = parse_probability(F.col("answer"))
    return prompts_.mapInPandas(run, "window_id string, answer string").withColumn("p", got).select("window_id", F.col("p.probability").alias("attack_score"), F.col("p.reason").alias("evidence"))

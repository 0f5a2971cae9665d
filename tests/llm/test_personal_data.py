"""What operator 7 learns, against plain Python, and how its cost grows."""

import itertools
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tests_support import DATA, rows_of
from tracewright.llm import personal_data as pd7
from tracewright.llm.spans import matches, sums_before

SECRET = [k[0] for k in pd7.KINDS].index("secret")


def patterns(seed, n=120, kinds=(0, 1, 4, 7)):
    r = random.Random(seed)
    rows = {}
    for _ in range(n):
        kind, real = r.choice(kinds), r.random() < 0.5
        vote = lambda: r.choices([-1, 0, 1], [1, 3, 6] if real else [5, 3, 2])[0]
        key = (kind, int(real) if kind < pd7.BASE else 1, *(vote() for _ in range(4)), *(r.randint(0, 3) for _ in range(4)))
        rows[key] = rows.get(key, 0) + r.randint(1, 40)
    return sorted((*k, w) for k, w in rows.items())


def plain_em(rows, rounds):
    """Row by row, in plain numbers."""
    kinds = sorted({r[0] for r in rows})
    vote = lambda r, j: r[2 + j] + 1
    p = [float(r[1]) if r[0] < pd7.BASE else 1 / (1 + math.exp(-1.5 * sum(r[2:6]))) for r in rows]
    for _ in range(rounds):
        share, chance = {}, {}
        for k in kinds:
            own = [i for i, r in enumerate(rows) if r[0] == k]
            share[k] = (2 + sum(rows[i][-1] * p[i] for i in own)) / (4 + sum(rows[i][-1] for i in own))
            for j, c in itertools.product(range(4), (0, 1)):
                seen = [10 * pd7.EXPECTED[c][v] + sum(rows[i][-1] * (p[i] if c else 1 - p[i]) for i in own if vote(rows[i], j) == v) for v in range(3)]
                chance[k, j, c] = [s / sum(seen) for s in seen]
        for i, r in enumerate(rows):
            if r[0] < pd7.BASE:
                continue
            odds = math.log(share[r[0]] / (1 - share[r[0]]))
            for j in range(4):
                no, silent, yes = (math.log(chance[r[0], j, 1][v] / chance[r[0], j, 0][v]) for v in range(3))
                no, yes = min(no, 0), max(yes, 0)
                odds += (no, min(max(silent, no), yes), yes)[vote(r, j)]
            p[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return chance, p


def test_reliabilities_are_those_of_plain_loops():
    rows = patterns(1)
    a = np.array(rows)
    chances, p = pd7.reliabilities(a[:, 0], a[:, 1], a[:, 2:6] + 1, a[:, -1].astype(float), 12)
    want, want_p = plain_em(rows, 12)
    assert np.allclose(p, want_p, atol=1e-9)
    for (k, j, c), v in want.items():
        assert np.allclose(chances[k, j, c], v, atol=1e-9)


def chance_of(model, kind, votes, traits):
    z = model.kinds[kind] + sum(model.votes[kind, j, v + 1] for j, v in enumerate(votes)) + sum(model.traits[kind, j, t] for j, t in enumerate(traits))
    return 1 / (1 + math.exp(-z))


def test_more_votes_for_a_span_never_lower_its_probability():
    for seed in range(4):
        model = pd7.learn(patterns(seed), steps=400)
        for kind, votes in itertools.product(range(len(pd7.KINDS)), itertools.product((-1, 0, 1), repeat=4)):
            for j in range(4):
                if votes[j] < 1:
                    more = [v + (i == j) for i, v in enumerate(votes)]
                    assert chance_of(model, kind, more, (1, 1, 1, 1)) >= chance_of(model, kind, votes, (1, 1, 1, 1))


def test_classifier_is_at_its_optimum():
    """No single weight can be moved, within its bound, to lower the penalised loss."""
    rows = patterns(5)
    a = np.array(rows)
    _, p = pd7.reliabilities(a[:, 0], a[:, 1], a[:, 2:6] + 1, a[:, -1].astype(float))
    model = pd7.learn(rows)
    total = np.bincount(a[:, 0], a[:, -1], len(pd7.KINDS))
    weight = a[:, -1] * np.minimum(1, 1000 / np.maximum(total, 1))[a[:, 0]]

    def loss(kinds, rises, traits):
        z = kinds[a[:, 0]].copy()
        by = np.concatenate([np.zeros((*rises.shape[:2], 1)), np.cumsum(rises, 2)], 2)
        for j in range(4):
            z += by[a[:, 0], j, a[:, 2 + j] + 1] + traits[a[:, 0], j, a[:, 6 + j]]
        return float((weight * (np.logaddexp(0, z) - p * z)).sum() + pd7.RIDGE / 2 * ((kinds**2).sum() + (rises**2).sum()) + pd7.TRAIT_RIDGE / 2 * (traits**2).sum())

    parts = [model.kinds, np.diff(model.votes, axis=2), model.traits]
    best = loss(*parts)
    for k, part in enumerate(parts):
        for at in np.ndindex(part.shape):
            for step in (-1e-3, 1e-3):
                moved = [x.copy() for x in parts]
                moved[k][at] += step
                if k != 1 or moved[k][at] >= 0:
                    assert loss(*moved) >= best - 1e-4


def test_few_secrets_among_long_words_are_found_at_every_size():
    """13 keys that all labelers vote for, against words that two vote against; the base kinds are a thousand times as many."""
    for times in (1, 10, 1000):
        rows = [(0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 900 * times), (1, 0, 1, 0, 0, 1, 0, 2, 1, 1, 40), (SECRET, 1, 1, 1, 1, 1, 2, 2, 2, 2, 13), (SECRET, 1, -1, -1, 0, 1, 1, 0, 1, 1, 3 * times)]
        model = pd7.learn(rows)
        assert chance_of(model, SECRET, (1, 1, 1, 1), (2, 2, 2, 2)) > 0.9 and chance_of(model, SECRET, (-1, -1, 0, 1), (1, 0, 1, 1)) < 0.2


def test_planted_secrets(spark):
    """Recall and precision over documents in which keys are planted."""
    r = random.Random(11)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null")
    keys = {i: "".join(r.choice("0123456789abcdef") for _ in range(40)) for i in range(0, 200, 9)}
    plant = spark.createDataFrame(list(keys.items()), "doc_id long, key string")
    own = docs.join(plant, "doc_id", "left").withColumn("text", F.when(F.col("key").isNotNull(), F.concat("text", F.lit('\ntoken = "'), "key", F.lit('" it'))).otherwise(F.col("text")))
    real = {d: t for d, t in rows_of(own.select("doc_id", "text"))}
    found = [(x["doc_id"], real[x["doc_id"]][x["first"] : x["last"]]) for x in rows_of(pd7.find(own).select("doc_id", F.inline("spans"))) if x["kind"] == SECRET]
    planted = {(d, k) for d, k in keys.items() if d in real}
    hex_ = {(d, v) for d, v in found if re.fullmatch("[0-9a-f]{40}", v)}
    assert planted <= set(found) and len(found) == len(hex_)


def test_sums_before(spark):
    for n in (0, 1, 255, 256, 257, 70_000):
        a = [i * 7 % 13 for i in range(n)]
        got = spark.createDataFrame([(a,)], "a array<int>").select(sums_before(F.col("a")).alias("s")).first()["s"]
        assert got == [0, *itertools.accumulate(a)][:-1] if a else got == []


def test_cost_follows_the_length(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"a{i}@b.com 10.0.0.{i % 300} é" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pd7.extract(docs).select(F.size("candidates")).first()[0] >= 2 * n - 10
        return time.time() - began

    seconds(100)
    assert seconds(20_000) <= 12 * max(seconds(2000), 0.5)


def test_matches_are_pythons(spark):
    texts = ["", "a", "aa bb", "é👍 aa 中 aaa", "b" * 300, "a b " * 700]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), F.lit("a+|b")).alias("m")).collect()
    for r in got:
        assert [(m["first"], m["last"], m["value"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("a+|b", r["t"])]

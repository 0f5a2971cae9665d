"""Operators 3, 6, 7 and 9 against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests_support import DATA, rows_of
from tracewright.llm import decontamination, licenses, line_dedup, personal_data

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return WORD.findall(low(s))


@pytest.fixture(scope="module")
def both(spark, odd):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    return odd.union(real.withColumn("doc_id", F.col("doc_id") + 1000).select(*odd.columns))


def test_licenses(both):
    want = Counter()
    for r in rows_of(both):
        w = words(r["text"])
        at = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        want[(r["doc_id"], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))] += 1
    got = rows_of(licenses.scan(both))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert len(licenses.LICENSES) + len(licenses.NOTICES) > 200 and all(re.compile(x[1]) for x in licenses.rules())


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
        ("GNU Lesser General Public License", "gpl,lgpl"),
        ("Nothing of the kind, but a permit.", ""),
        (None, ""),
    ],
)
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


def test_names_without_the_word_license_pass_the_gate(spark):
    samples = [
        "cc0", "creative commons zero", "creative commons attribution", "cc by-nc", "cc by-nd 4.0", "attribution-noncommercial-sharealike", "gnu gpl", "gplv2", "agplv3", "lgplv2.1", "internet systems consortium",
        "mit no attribution", "in the public domain", "the unlicense", "all rights  reserved", "(c) 2020", "© 1999", "proprietary and confidential", "gnu.org/licenses/gpl", "spdx-license-identifier: mit",
        "permission is hereby granted, free of charge, to any person obtaining a copy", "redistribution and use in source and binary forms, with or without modification",
    ]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "doc_id long, text string")
    assert not [samples[r["doc_id"]] for r in rows_of(licenses.scan(frame)) if not r["labels"]]


def sample(parts):
    """A text that a parsed regex matches: the first of its alternatives, and what is optional once."""
    out = ""
    for kind, x in parts:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(x)
        elif kind == "NOT_LITERAL":
            out += "1"
        elif kind == "BRANCH":
            out += sample(x[1][0])
        elif kind == "SUBPATTERN":
            out += sample(x[3])
        elif kind.endswith("REPEAT"):
            out += sample(x[2]) * max(x[0], 1)
        elif kind == "IN":
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0])}.get(str(x[0][0]), lambda v: "1")(x[0][1])
    return out


def branches(regex):
    """A text for each alternative of a regex of licenses, whose blanks are still blanks."""
    parts = re._parser.parse(regex)
    first, rest = (list(parts)[0], list(parts)[1:]) if len(parts) else (None, [])
    return [sample(b) for b in first[1][1]] if first and str(first[0]) == "BRANCH" and not rest else [sample(parts)]


def test_rules_find_names_however_they_are_wrapped(spark):
    found = [(label, t) for label, _, names, _ in licenses.LICENSES for t in branches(names)]
    found += [(label, t) for label, regex, _, _ in licenses.NOTICES for t in branches(regex.replace("\\s+", " "))]
    found += [("public-domain", "released into the public domain"), ("cc-by-sa", "creative commons attribution-sharealike"), ("apache-2", "licensed under the apache license, version 2.0")]
    found += [("proprietary", "unauthorized use of this by any other party, whoever it is, is prohibited")]
    breaks = [" ", "\n", "\r\n", "\n        ", "  ", "\t"]
    rows = [(i * len(breaks) + k, f"x {t} y".replace(" ", gap)) for i, (_, t) in enumerate(found) for k, gap in enumerate(breaks)]
    got = {r["doc_id"]: r for r in rows_of(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    texts = dict(rows)
    for i, (label, t) in enumerate(found):
        plain = got[i * len(breaks)]
        assert label in plain["labels"].split(","), t
        for k in range(1, len(breaks)):
            one = got[i * len(breaks) + k]
            assert (one["labels"], one["score"]) == (plain["labels"], plain["score"]), (t, breaks[k])
            inside = [" ".join(texts[one["doc_id"]][d["first"] : d["last"]].split()) for d in one["detections"]]
            assert inside == [" ".join(texts[plain["doc_id"]][d["first"] : d["last"]].split()) for d in plain["detections"]]


def brute_outermost(raw):
    def inside(x, y):
        return y[0] <= x[0] and y[1] >= x[1] and (y[3] > x[3] or (y[3] == x[3] and y[1] - y[0] > x[1] - x[0]))

    return sorted(x for x in raw if not any(inside(x, y) for y in raw))


def brute_licenses(text):
    """The detections of a text by Python's regular expressions, all pairs compared."""
    lower, raw = low(text), []
    if re.search(licenses.spaced(licenses.GATE), lower, re.ASCII):
        for label, regex, keyword, priority in licenses.rules():
            raw += [(m.start(), m.end(), label, priority) for m in re.finditer(regex, lower, re.ASCII)]
    return brute_outermost(raw)


def test_license_detections_against_all_pairs(spark, both):
    signed = [" and ".join(sample(re._parser.parse(r)) for _, r, _, _ in licenses.NOTICES[k : k + 4]) for k in range(len(licenses.NOTICES))]
    signed += ["Copyright (c) 2020 X Consortium. All rights reserved. Licensed under the MIT License, SPDX-License-Identifier: MIT", "mit license, gnu gpl, " * 300]
    docs = both.select("doc_id", "text").union(spark.createDataFrame([(70_000 + i, t) for i, t in enumerate(signed)], "doc_id long, text string"))
    want, texts = Counter(), rows_of(docs)
    for r in texts:
        found, base = brute_licenses(r["text"]), {x for p, x in licenses.PHRASES if f" {p} " in f" {' '.join(words(r['text']))} "}
        score = max([x[3] for x in found] + [60 if base else 0]) / 100
        want[(r["doc_id"], tuple(found), ",".join(sorted(base | {x[2] for x in found})), score)] += 1
    got = rows_of(licenses.scan(docs))
    assert Counter((r["doc_id"], tuple(sorted((d["first"], d["last"], d["label"], d["priority"]) for d in r["detections"])), r["labels"], r["score"]) for r in got) == want


def test_outermost_of_random_spans(spark):
    r = random.Random(3)
    rows = [[(a, a + r.randint(1, 12), r.choice("xyz"), r.choice([40, 60, 90])) for a in (r.randint(0, 25) for _ in range(n))] for n in [0, 1, 2, 3, 5, 8, 20, 40] * 5]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw array<struct<first:int,last:int,label:string,priority:int>>")
    for x in rows_of(frame.select("i", licenses.outermost(F.col("raw")).alias("kept"))):
        assert sorted(map(tuple, x["kept"])) == brute_outermost(rows[x["i"]])


def brute_pii(text):
    text = text or ""
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark, both):
    more = ["a@b.c_d@e.f x@y a..b@c.d.e.@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4", "+1+2(333) 444-5555 6", "4111-1111 1111-1111-", "👍 é a@b.co", "9" * 40, "@" * 50]
    docs = both.union(spark.createDataFrame([(9000 + i, t, "en", "a", 1) for i, t in enumerate(more)], both.schema))
    want = Counter((r["doc_id"], tuple(brute_pii(r["text"]))) for r in rows_of(docs))
    got = rows_of(personal_data.find(docs))
    assert Counter((r["doc_id"], tuple((s["kind"], s["first"], s["last"]) for s in r["spans"] if s["kind"] < 4)) for r in got) == want
    assert any(s["kind"] > 3 and s["probability"] >= 0.5 for r in got for s in r["spans"])


def test_personal_data_query(spark):
    docs = {r["doc_id"]: r["text"] for r in rows_of(spark.read.parquet(f"{DATA}/documents.parquet"))}
    names = ["email", "ip", "card", "phone"]
    for r in rows_of(personal_data.op7_personal_data(spark, DATA)):
        want = brute_pii(docs[r["doc_id"]])
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for k, _, _ in want) for i in range(4)]
        joined = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def brute_hits(docs, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    out = Counter()
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    ids |= found
                    hit |= set(range(i, i + k))
        out[(doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_decontamination(spark, both):
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{DATA}/benchmark.parquet"))]
    items += [(901, "one"), (902, "Two, words"), (903, None), (904, "..."), (905, "1 2 3 4 1 2 3 4 1 2 3 4 1 2 3 4"), (905, "another text of"), (901, "one")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontamination.contamination(both, frame).drop("h"))
    assert Counter(tuple(r.asDict()[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == brute_hits([(r["doc_id"], r["text"]) for r in rows_of(both)], items)
    assert not any(r["contaminated"] for r in rows_of(decontamination.contamination(both, frame.limit(0))))
    kept = decontamination.keep_clean(both.withColumn("n_hit", F.lit("mine")), frame)
    assert kept.count() == sum(not r["contaminated"] for r in got) and kept.columns[-1] == "n_hit"


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark, odd):
    line = "a line of text that is long enough to compare"
    variants = [line, line + "x", line[:20] + line[21:], line.replace("long", "lung"), line.replace("that is", "thatis"), line.replace("that is", "thatxis"), line[::-1], "x" + line[1:], line.upper() + "  ", " ".join(line.split("t")), "aa " + line, "b" + line]
    texts = ["\n".join(variants[i:] + variants[:i]) for i in (0, 5, 3)] + variants + ["short\nshort", "shorts", "\n\n"]
    docs = odd.union(spark.createDataFrame([(500 + i, t, "en", "a", 1) for i, t in enumerate(texts)], odd.schema))
    hashed = rows_of(docs.select("doc_id", "text", F.xxhash64("text", F.length("text")).alias("h")).distinct())
    every = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], i, re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")) for r in hashed for i, x in enumerate((r["text"] or "").split("\n"))), key=lambda x: x[:4])
    gone, near, seen = set(), set(), {}
    for known, doc, h, i, s in every:
        if not s:
            continue
        if s in seen:
            gone.add((doc if known else None, h, i))
        elif len(s) >= 20 and any(len(t) >= 20 and edits(s, t) <= 1 for t in seen):
            gone.add((doc if known else None, h, i))
            near.add((doc if known else None, h, i))
            seen[s] = 1
        else:
            seen[s] = 1
    got = rows_of(line_dedup.repeats(docs.select("doc_id", "text")).distinct())
    mine = {(r["doc_id"], r["h"], r["line_no"]) for r in got}
    # Every repeat of a near line's own text goes as well.
    assert mine == gone
    assert {(r["doc_id"], r["h"], r["line_no"]) for r in got if r["near"]} == near
    done = rows_of(line_dedup.dedup(docs))
    assert len(done) == docs.count()
    lost = Counter((d, h) for d, h, _ in mine)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in hashed}
    del hashes
    assert sum(r["n_lines"] - r["n_kept"] for r in done) >= sum(lost.values())


def test_no_rows(nothing, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert licenses.scan(nothing).count() == 0
    assert personal_data.find(nothing).count() == 0
    assert decontamination.contamination(nothing, items).count() == 0
    assert line_dedup.dedup(nothing).count() == 0

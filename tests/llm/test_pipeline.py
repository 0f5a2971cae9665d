"""The pipeline, each stage against plain Python on what the one before it kept."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests_support import rows_of
from tracewright.llm import line_dedup


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_lines(docs):
    """Each text without the lines that an earlier one makes superfluous; None where no word is left."""
    seen, out = [], {}
    for i, text in sorted(docs.items()):
        kept, lines = [], text.split("\n")
        for line in lines:
            s = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if s and any(s == t or (len(s) >= line_dedup.NEAR_CHARS and len(t) >= line_dedup.NEAR_CHARS and edits_one(s, t)) for t in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            kept.append(line)
        out[i] = text if len(kept) == len(lines) else ("\n".join(kept) if any(x.strip() for x in kept) else None)
    return {i: t for i, t in out.items() if t is not None}


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    r = random.Random(21)
    item = sentence(r, 40)
    base, other = sentence(r, 200), sentence(r, 150)
    near = base.split()
    near[100] = "altered"
    line = sentence(r, 9)
    docs = {i: sentence(r, r.randint(20, 60)) for i in range(10, 24)}
    docs |= {1: base, 2: base + "\n" + sentence(r, 6), 3: " ".join(near), 4: other, 5: "... 123 !!", 6: sentence(r, 30) + " " + item + " " + sentence(r, 5), 7: line + "\n" + sentence(r, 20), 8: sentence(r, 20) + "\n" + line, 9: line[:-1], 24: sentence(r, 5)}
    return docs, item


def test_line_stage_is_that_of_plain_lines(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([(i, t, len(t), "x") for i, t in docs.items()], "doc_id long, text string, n_chars long, near string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows_of(line_dedup.keep_lines(df))}
    assert got == {i: (t, len(t)) for i, t in plain_lines(docs).items()}


def test_pipeline(spark, tmp_path):
    docs, item = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = plain_lines({i: t for i, t in docs.items() if re.search("[a-z]", t)})
    left = {}
    for i, t in sorted(kept.items()):
        s = shingles(t)
        if not any(len(s & u) >= 0.8 * len(s | u) for u in (shingles(x) for x in left.values())):
            left[i] = t
    words = item.split()
    windows = {tuple(words[k : k + 13]) for k in range(len(words) - 12)}

    def contaminated(text):
        w = text.split()
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    left = {i: t for i, t in left.items() if not contaminated(t)}
    assert 5 not in left and 6 not in left and 3 not in left and 4 in left
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    lengths = {r["doc_id"]: r["n"] for r in rows_of(got.groupBy("doc_id").agg(F.sum("length").alias("n")))}
    assert lengths == want
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0

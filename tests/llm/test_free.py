"""Operators 1, 2, 4, 5, 8 and 10 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests_support import DATA, rows_of
from tracewright.llm import fingerprints, id_coder, language_id, language_model, near_duplicates, packing, token_files
from tracewright.llm.common import Scratch, mounted, shared_dir
from tracewright.llm.hashing import word_hashes
from tracewright.llm.tokens import Ids

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both(spark, odd):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    return odd.union(real.withColumn("doc_id", F.col("doc_id") + 1000).select(*odd.columns))


def plain_ids(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaced", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_ids_are_the_librarys(path, spaced):
    r, library = random.Random(3), Tokenizer.from_file(path)
    parts = ["a", "b ", "  ", " ", "\n", " \n", "\t", "'s", "'S", "É", "ß", "1", "²", "…", ",", "don't", " ", "\x1c", "́", "İ", "Σ", "ας", "中文", "👍🏽", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|endof", "\x85", "\x00", "-", " .", "word", " "]
    mine = Ids(path, spaced)
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path,spaced", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_every_added_token_keeps_its_id(path, spaced):
    library, mine = Tokenizer.from_file(path), Ids(path, spaced)
    added = library.get_added_tokens_decoder()
    assert added
    for number, token in added.items():
        for text in (token.content, f"some {token.content} text", f"a{token.content}{token.content}b ", f" {token.content.upper()} {token.content[:-1]}", f"e\u0301{token.content}\u0301"):
            ids = np.frombuffer(mine.encode(text), "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert (number in ids) == (token.content in text)


def test_best_fit_is_best_fit():
    r = np.random.default_rng(1)
    for n in (0, 1, 60, 700):
        lengths = r.integers(1, 101, n)
        bins, offsets = packing.best_fit(lengths, 100)
        free = []
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [(v, i) for i, v in enumerate(free) if v >= x]
            if fits:
                free[min(fits)[1]] -= x
            else:
                free.append(100 - x)
        assert len(set(bins.tolist())) == len(free)
        for b in set(bins.tolist()):
            at = 0
            for o, size in sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist())):
                assert o == at
                at += size
            assert at <= 100


def test_packing(spark, both, nothing):
    got = rows_of(packing.pack(both.withColumn("piece", F.lit("mine")), WORD_BPE, length=64, group_docs=50))
    want = Counter()
    for r in rows_of(both):
        ids = plain_ids(WORD_BPE, r["text"]) + [0]
        want.update((r["doc_id"], k, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in sequences.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 64
    assert len(sequences) <= 1.03 * sum(r["length"] for r in got) / 64 + 3
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_id_coder():
    r = np.random.default_rng(2)
    blocks = [r.integers(0, 50000, n).astype("<u4") for n in (0, 1, 5, 700)] + [np.full(id_coder.BLOCK, 7, "<u4"), np.tile(np.arange(50, dtype="<u4"), 80), np.array([id_coder.ID_LIMIT - 1, 0] * 90, "<u4"), (r.zipf(1.3, 4000) % 50000).astype("<u4")]
    coded = id_coder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, id_coder.decode(coded, [len(b) for b in blocks])))
    assert len(coded[4]) < 100 and len(coded[5]) < 150
    assert id_coder.encode([]) == [] == id_coder.decode([], [])
    # A block is coded on its own: the same words beside other blocks or alone.
    assert (id_coder.encode([blocks[7]])[0] == coded[7]).all()
    for wrong in (np.array([id_coder.ID_LIMIT], "<u4"), np.zeros(id_coder.BLOCK + 1, "<u4")):
        with pytest.raises(ValueError):
            id_coder.encode([wrong])


def test_id_coder_beats_a_general_compressor():
    mine = Ids(BYTE_BPE, True)
    texts = pa.parquet.read_table(f"{DATA}/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.concatenate([np.frombuffer(mine.encode(t), "<u4") for t in texts])
    blocks = [ids[i : i + id_coder.BLOCK] for i in range(0, len(ids), id_coder.BLOCK)]
    bits = 32 * sum(map(len, id_coder.encode(blocks))) / len(ids)
    general = 8 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks) / len(ids)
    assert bits < 0.95 * general


def test_ranks_are_those_of_the_ids_before():
    r = np.random.default_rng(4)
    ids = (r.zipf(1.2, 3000) % 5000).astype("<u4")
    steps, want = id_coder._rankings(), []
    for i, x in enumerate(ids.tolist()):
        begin = max((n for n in steps if n <= i), default=0)
        counts = Counter(ids[:begin].tolist())
        ranks = {v: n for n, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v)))}
        want.append(ranks.get(x, id_coder.RANKED + x) + 1)
    assert id_coder._names(ids).tolist() == want


def test_token_files(spark, both, nothing):
    path = shared_dir(spark, "test")
    token_files.write(both.withColumn("file", F.lit(1)), path, BYTE_BPE)
    got = rows_of(token_files.starts(token_files.read(spark, path)))
    want = {id_: [] for id_ in ()}
    want, start = [], 0
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "") for r in rows_of(both.withColumn("h", F.xxhash64("text")))))
    for known, doc, _, text in rows:
        ids = plain_ids(BYTE_BPE, text) + [0]
        want.append((start, doc if known else None, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in got) == sorted(want, key=lambda x: x[0])
    record = spark.read.parquet(path).first()["record"]
    broken = bytearray(record)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        sizes, heads, words = token_files.unpack_segment(bytes(broken))
        ids = id_coder.decode(list(words), heads[:, 0].tolist())
        if any(zlib.crc32(i.tobytes()) != h[2] for i, h in zip(ids, heads)):
            raise ValueError
    empty = shared_dir(spark, "test")
    token_files.write(nothing, empty, BYTE_BPE)
    assert token_files.read(spark, empty).count() == 0


def test_checksums_of_token_files_leave_the_ids_in_one_worker(spark, odd):
    path = shared_dir(spark, "test")
    token_files.write(odd, path, BYTE_BPE)
    found = token_files.checksums(spark, path)
    want = [(r["file"], r["segment"], r["place"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows_of(token_files.read(spark, path))]
    assert sorted(map(str, map(tuple, rows_of(found)))) == sorted(map(str, want)) and len(want) == odd.count()
    assert found._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Each row's class: the smallest doc_id that links lead to."""
    texts = list({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    low = {}
    for d, t in rows:
        if d is not None:
            low[at[t or ""]] = min(low.get(at[t or ""], d), d)
    return Counter((d, low.get(at[t or ""]) if words(t) else d) for d, t in rows)


def near_copies(seed, copies):
    """A text, and copies with few or many words changed, dropped or put in, some of them copies of copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = [[word() for _ in range(130)]]
    for _ in range(copies):
        own = list(r.choice(texts[:1] * 6 + texts))
        for _ in range(r.randint(0, 7)):
            i = r.randrange(len(own))
            kind = r.random()
            own[i : i + 1] = [word()] if kind < 0.6 else [] if kind < 0.9 else [own[i], word()]
        if r.random() < 0.1:
            del own[-r.randint(5, 40) :]
        texts.append(own)
    return [" ".join(t) for t in texts]


def test_near_duplicates(spark, both, nothing):
    docs = both.union(spark.createDataFrame([(20000 + 7 * i % 1009, t, None, None, None) for i, t in enumerate(near_copies(1, 130) + near_copies(2, 60))], both.schema))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").cache()
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    want = brute_classes(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in rows_of(near_duplicates.classes(docs))) == want
    kept = rows_of(near_duplicates.keep_first(docs.withColumn("node", F.lit("mine"))))
    alone = [d for d, t in rows if not words(t)]
    named = {c for d, c in brute_classes([(d, t) for d, t in rows if words(t)]) if c is not None}
    # Of each class with words one row, and every row without any.
    assert Counter(r["doc_id"] for r in kept if r["doc_id"] is not None) == Counter(named) + Counter(d for d in alone if d is not None)
    assert sum(r["doc_id"] is None for r in kept) == sum(d is None for d in alone)
    assert near_duplicates.classes(nothing).count() == 0 and near_duplicates.keep_first(nothing).count() == 0


def test_large_buckets_of_texts_that_are_not_alike_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text with so many words changed that few are alike: what is compared exactly stays in proportion to them."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**9)}"
    base, texts = [word() for _ in range(60)], []
    for _ in range(400):
        own = list(base)
        for i in r.sample(range(60), r.randint(4, 8)):
            own[i] = word()
        texts.append(own)
    texts += [[*t[:-1], word()] for t in texts[::40]]
    asked, compare = [], near_duplicates.with_pivots
    monkeypatch.setattr(near_duplicates, "PAIRED", 4)
    monkeypatch.setattr(near_duplicates, "with_pivots", lambda some, sets: asked.append(some.count()) or compare(some, sets))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = rows_of(near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter((x["doc_id"], x["class_id"]) for x in got) == brute_classes(rows)
    # The first is each text with its hub, the second what the signatures' buckets ask for.
    assert sum(asked[2:]) <= len(texts), asked


def test_buckets_of_texts_just_below_the_threshold_make_no_table_of_pairs(spark, monkeypatch):
    """Groups of texts of similarity 0.7 with a few alike ones among them, dealt to several blocks or none, behind a pivot or not."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**9)}"
    texts = []
    for _ in range(10):
        base = [word() for _ in range(60)]
        own = [[*base[:i], word(), *base[i + 1 :]] for i in r.sample(range(6, 54), 14)]
        texts += own + [[*t[:-1], word()] for t in own[:2]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    asked, compare = [], near_duplicates.with_pivots
    monkeypatch.setattr(near_duplicates, "with_pivots", lambda some, sets: asked.append(some.count()) or compare(some, sets))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_classes(rows)
    for paired, hashes in ((near_duplicates.PAIRED, near_duplicates.BLOCK_HASHES), (near_duplicates.PAIRED, 200), (8, 200)):
        monkeypatch.setattr(near_duplicates, "PAIRED", paired)
        monkeypatch.setattr(near_duplicates, "BLOCK_HASHES", hashes)
        asked.clear()
        assert Counter((x["doc_id"], x["class_id"]) for x in rows_of(near_duplicates.classes(docs))) == want
        if paired > 16:
            # Each text with its hub.
            assert sum(asked) <= len(texts), asked


def test_linked_roots_join_what_alike_sets_lead_to():
    r = np.random.default_rng(8)
    base = np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, 51), False), r.integers(0, 1 << 62, r.integers(0, 6)).astype(np.uint64)])) for _ in range(80)]
    roots = [b"%02d" % (i - i % 3) for i in range(80)]

    def top(links):
        of = {x: x for x in roots}
        for a, b in links:
            of = {x: of[b] if y == of[a] else y for x, y in of.items()} if of[a] != of[b] else of
        return sorted(sorted(x for x in of if of[x] == y) for y in {*of.values()})

    for first in (0, 30):
        alike = []
        for i in range(first or 80):
            for j in range(max(first, i + 1), 80):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    alike.append((roots[i], roots[j]))
        found = list(near_duplicates.linked_roots(roots, sets, first))
        assert top(found) == top(alike) and len(found) < len({*roots}) < len(alike)


def test_rarest_hashes_bring_all_alike_pairs_together(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, (3, 60))
    sets = [np.unique(np.concatenate([r.choice(base[i % 3], r.integers(40, 60), False), r.integers(0, 1 << 62, r.integers(0, 14)), r.choice(base[0], 3)])) for i in range(90)]
    key = lambda i: b"%03d" % i
    nodes = spark.createDataFrame([(key(i), key(i - i % 2)) for i in range(90)], "node binary, root binary")
    own = spark.createDataFrame([(key(i), s.astype(np.uint64).tobytes()) for i, s in enumerate(sets)], "node binary, shingles binary")
    scratch = Scratch(spark)
    met = {}
    for x in rows_of(near_duplicates.rarest(nodes, own, scratch)):
        met.setdefault(int(bytes(x["node"])), {})[x["band"]] = x["place"]
    scratch.drop()
    alike = 0
    for i in range(90):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i // 2 != j // 2 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                alike += 1
                some = met[i].keys() & met[j].keys()
                # At the first they share, what is left of both is no less than what they share.
                assert max(min(len(sets[i]) - met[i][b], len(sets[j]) - met[j][b]) for b in some) >= both
    assert alike > 10


def test_keep_first_tells_classes_with_the_same_or_no_doc_id_apart(spark):
    texts = [(None, "apples and pears in a bowl"), (None, "apples and pears in a bowl"), (None, "seven ships on a grey sea"), (None, None), (7, "   "), (7, "another text of the same id"), (7, "quite a different one under it"), (9, "Another text, of the same id!")]
    kept = rows_of(near_duplicates.keep_first(spark.createDataFrame(texts, "doc_id long, text string")))
    assert Counter(tuple(r) for r in kept) == Counter([texts[0], *texts[2:7]])


def test_pairs_that_repeat_different_passages_share_a_band():
    r = random.Random(6)
    passage = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(20))
    parted = 0
    for _ in range(60):
        one, two = passage(), passage()
        texts = [" ".join([one] * 20 + [two]), " ".join([one] + [two] * 20)]
        both, either = shingles(texts[0]) & shingles(texts[1]), shingles(texts[0]) | shingles(texts[1])
        assert 0.8 <= len(both) / len(either) < 0.83
        (found,) = near_duplicates._bands(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"a", b"b"]), pa.array(texts)], ["doc_id", "node", "text"])]))
        a, b = found.column("bands").to_pylist()
        parted += not set(a) & set(b)
    assert parted == 0


def test_probminhash_estimates_probability_jaccard():
    r = np.random.default_rng(4)
    x, w = r.integers(0, 1 << 62, 300).astype(np.uint64), 1 + r.random(300) * 3
    v = w * np.where(r.random(300) < 0.3, 2.0, 1.0)
    v[:60] = 0
    true = sum(1 / np.maximum(w / w[i], v / v[i]).sum() for i in range(300) if v[i])
    a, b = near_duplicates.signatures([(x, w), (x[60:], v[60:])], 4096)
    assert abs((a == b).mean() - true) < 0.03


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_language_model(spark, both, nothing):
    docs = both.where("text is not null").withColumn("held_out", F.col("doc_id") % 3 == 0).withColumn("held_out", F.coalesce("held_out", F.lit(False))).cache()
    model = language_model.train(docs.where("not held_out").select("text"), mounted(shared_dir(spark, "test")))
    rows = rows_of(docs)
    train = [tokens(r["text"]) for r in rows if not r["held_out"]]
    c = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(c.values()), len(c)

    def discounts(counts):
        return language_model.discounts([sum(x == k for x in counts) for k in (1, 2, 3, 4)])

    d2, kinds = discounts(pair.values()), Counter(b for _, b in pair)
    d1, total = discounts(kinds.values()), len(pair)
    rest = sum(d1[min(x, 3) - 1] for x in kinds.values()) / total
    follow = defaultdict(lambda: [0, 0, 0])
    for (a, _), x in pair.items():
        follow[a][min(x, 3) - 1] += 1
    less = lambda x, d: max(x - d[min(x, 3) - 1], 0) if x else 0

    def p(a, b):
        one = less(kinds.get(b, 0), d1) / total + rest / (v + 1)
        return less(pair.get((a, b), 0), d2) / c[a] + sum(x * y for x, y in zip(d2, follow[a])) / c[a] * one if a in c else one

    assert abs(sum(p(None, b) for b in c) + (sum(x * y for x, y in zip(d2, follow[None])) / c[None]) * rest / (v + 1) - 1) < 1e-9
    want = Counter()
    for r in rows:
        t = tokens(r["text"])
        base, own = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, b)) for a, b in zip([None, *t], t))
        want[(r["doc_id"], len(t), sum(w in c for w in t), round(base, 4), round(own, 4))] += 1
    got = rows_of(language_model.score(docs, model))
    assert model.words.n_tokens == n and model.words.n_words == v
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == want
    empty = language_model.train(nothing.select("text"), mounted(shared_dir(spark, "test")))
    assert {round(r["score"], 9) for r in rows_of(language_model.score(docs, empty))} == {0.0}
    assert language_model.score(nothing.withColumn("held_out", F.lit(True)), model).count() == 0


def test_word_hashes_over_pieces(monkeypatch):
    from tracewright.llm import hashing

    text = " ".join(f"word{i} Üben {'x' * (i % 90)}" for i in range(400))
    whole = word_hashes(text)
    monkeypatch.setattr(hashing, "_PIECE", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == len(words(text)) and len(set(whole.tolist())) == len(set(words(text)))


def test_language_id(spark, both, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    got = rows_of(language_id.predict(docs, model).join(docs, "doc_id").where(language_id.remainder() == 0))
    assert len(got) > 150 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    odd_ = rows_of(language_id.predict(both, model))
    letters = [(r["doc_id"], any(ch.isalpha() for ch in r["text"] or "")) for r in rows_of(both)]
    assert Counter(r["doc_id"] for r in odd_ if r["lang_pred"] == "und") == Counter(d for d, x in letters if not x)
    assert all(0 <= r["score"] <= 1 for r in odd_)
    assert np.count_nonzero(model.weights) < 0.9 * model.weights.size and model.temperature > 0
    kept = language_id.keep_known(both.withColumn("score", F.lit("mine")), model)
    assert kept.columns == [*both.columns, "score"] and kept.count() <= both.count()
    assert language_id.learn(both.withColumn("lang", F.lit(None).cast("string"))).predict("some text")[0] == "und"
    assert language_id.predict(nothing, language_id.learn(nothing)).count() == 0


def test_language_id_learns_every_label(spark):
    made = [(i * 80 + k, " ".join(chr(97 + i % 26) * 2 + chr(97 + i // 26) + x for x in ("on", "er", "as")) + f" {chr(97 + k % 26)}", f"l{i:02}") for i in range(70) for k in range(12)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").coalesce(2)
    model = language_id.learn(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert sum(model.predict(text)[0] == lang for _, text, lang in made) > 0.95 * len(made)


def test_without_labels_lettered_texts_stay(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 ...", None), (3, None, None), (4, "", None), (5, "中文", None)], "doc_id long, text string, lang string")
    kept = language_id.keep_known(docs, language_id.learn(docs))
    assert sorted(r["doc_id"] for r in rows_of(kept)) == [1, 5] and kept.schema == docs.schema


def test_fingerprints(spark, both, nothing):
    got = Counter(tuple(r) for r in rows_of(fingerprints.edited_pairs(both, 5)))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "") for r in rows_of(both.withColumn("h", F.xxhash64("text")))))
    want = Counter()
    for i, (known, doc, _, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = (fingerprints.sketch(x) for x in (text, new, after))
        want[(doc if known else None, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.to_text(a), fingerprints.to_text(b), fingerprints.resemblance(a, b), fingerprints.resemblance(a, c))] += 1
    assert got == want
    assert fingerprints.edited_pairs(nothing).count() == 0 and fingerprints.fingerprints(nothing).count() == 0


def test_sketches_estimate_and_merge():
    r = random.Random(1)
    w = [f"w{r.randrange(10**9)}" for _ in range(6000)]
    a, b = " ".join(w[:4000]), " ".join(w[2000:])
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    assert abs(fingerprints.resemblance(x, y) - 1 / 3) < 0.13 and abs(fingerprints.containment(x, y) - 0.5) < 0.2
    assert abs(fingerprints.distinct(x) / 3996 - 1) < 0.3
    assert (fingerprints.merge(fingerprints.sketch(" ".join(w[:3000])), fingerprints.sketch(" ".join(w[2996:]))) == fingerprints.sketch(" ".join(w))).all()
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()


def test_components_take_one_execution_a_table(spark):
    r = random.Random(8)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 220)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])

    class Counted(Scratch):
        cuts = 0

        def cut(self, df, kind):
            self.cuts += 1
            return super().cut(df, kind)

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsCount()

    key = lambda x: x.to_bytes(2, "big")
    made = spark.createDataFrame([(key(a), key(b)) for a, b in links], "a binary, b binary")
    for some, want in ((made, {key(a): key(b) for a, b in root.items()}), (made.limit(0), {})):
        scratch, before = Counted(spark), executions()
        got = near_duplicates.components(some, scratch)
        assert executions() - before == scratch.cuts
        assert {bytes(x["node"]): bytes(x["root"]) for x in rows_of(got)} == want


def test_language_sample_is_held_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda rows: seen.extend(rows))
    docs = spark.createDataFrame([(i, f"text {'abc' * i} und {i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    language_id.learn(docs)
    want = [(x["lang"], *language_id.grams(x["text"])) for x in rows_of(docs.where(language_id.remainder() != 0))]
    plain = lambda rows: sorted((lang, found.tolist(), counts.tolist()) for lang, found, counts in rows)
    assert plain(seen) == plain(want) and not any(x.flags.owndata for _, *parts in seen for x in parts)

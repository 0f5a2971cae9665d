"""Operators 11 to 13 against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict
from math import ceil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_support import DATA, rows_of
from tracewright.llm import collocations, divergence, radix_select, url_filters


@pytest.fixture(scope="module")
def both(spark, odd):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    return odd.union(real.withColumn("doc_id", F.col("doc_id") + 1000).select(*odd.columns)).withColumns({"term": F.lit(1), "p": F.lit("x"), "rank": F.lit(0)})


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- 11 ---


def plain_audit(rows, ranks=200):
    langs, docs = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for r in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r["text"]))
        lang, source = r["lang"] or "", r["source"] or ""
        langs[lang][source].update(words)
        docs[lang].update(set(words))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        every = shares(sum(sources.values(), Counter()))
        own = {s: shares(c) for s, c in sources.items()}
        for s, p in own.items():
            pair = [(-sum(f(p[t], q[t]) for t in kept), o) for o, q in own.items() if o != s]
            term = [(-f(p[t], every[t]), t) for t in kept if sources[s][t] and p[t] > every[t]]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(items[:most], 1)}
    return out


def test_audit_is_exact(both):
    got = divergence.audit(both, 7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = rows_of(got)
    assert len(rows) == len(set(rows)) and set(map(tuple, rows)) == plain_audit(rows_of(both), 7)


def test_audit_of_nothing(nothing):
    assert rows_of(divergence.audit(nothing)) == []


def test_shares_beyond_64_bits(spark):
    n, total = 10**14, 3 * 10**15 + 7
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // total


def test_radix_select_refines_ties(spark):
    r = random.Random(7)
    rows = [(g, r.choice([0, 3, 3, 1 << 40, (1 << 60) - 1]), "same beginning " * r.randint(0, 2) + r.choice("abé中") * r.randint(0, 3) + str(i % 70)) for g in "xyz" for i in range(90 if g != "z" else 4)]
    rows = list(dict.fromkeys(rows))
    for k in (1, 9, 40):
        got = {(g, i, v, n) for g, v, i, n in rows_of(radix_select.top(spark.createDataFrame(rows, "g string, value long, item string"), ["g"], k).select("g", "value", "item", "rank"))}
        want = {(g, i, v, n) for g in "xyz" for n, (v, i) in enumerate(sorted(((v, i) for h, v, i in rows if h == g), key=lambda x: (-x[0], x[1].encode()))[:k], 1)}
        assert got == want


# --- 12 ---


def plain_phrases(rows, least, ranks):
    counts = defaultdict(Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[r["lang"] or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if " " not in p)
        found = {p: v for p, v in c.items() if " " in p and v >= least}
        covered = {}
        for p, v in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    s = " ".join(w[i : i + k])
                    covered[s] = max(covered.get(s, 0), v)
        best = []
        for p, a in found.items():
            if 100 * covered.get(p, 0) >= 80 * a:
                continue
            w = p.split(" ")
            score, _, l, r_ = min((2_000_000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            best.append((-score, -a, p.encode(), l, r_))
        out |= {(lang, i, p.decode(), -a, l, r_, n, -s) for i, (s, a, p, l, r_) in enumerate(sorted(best)[:ranks], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_collocations_are_exact(both, monkeypatch, small):
    if small:  # many passes, parts and automata
        monkeypatch.setattr(collocations, "HEAVY", 700)
        monkeypatch.setattr(collocations, "PHRASES", 9000)
    got = rows_of(collocations.mine(both, 4, 300))
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_phrases(rows_of(both), 4, 300)


def test_long_pieces_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 64)
    words = [f"w{i % 37}" for i in range(400)]
    data = (" ".join(words[:300]) + "\n" + " ".join(words[300:]) + " " + "x" * 500).encode()
    met = set()
    for part in collocations._chunks(data):
        for line in part.split(b"\n"):
            w = line.split()
            met |= {b" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1)}
    want = set()
    for line in data.split(b"\n"):
        w = line.split()
        want |= {b" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1)}
    assert met == want


def test_collocations_of_nothing(nothing):
    assert rows_of(collocations.mine(nothing)) == []


def test_passes_over_texts_do_not_grow_with_phrases(both, monkeypatch):
    made, cut = [], collocations.cut
    monkeypatch.setattr(collocations, "cut", lambda df, kind: made.append(kind) or cut(df, kind))
    collocations.mine(both, 4, 300)
    monkeypatch.setattr(collocations, "HEAVY", 700)
    monkeypatch.setattr(collocations, "PHRASES", 9000)
    collocations.mine(both, 4, 300)
    assert made[: len(made) // 2] == made[len(made) // 2 :]


def test_parts_of_long_pieces_count_each_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 64)
    r = random.Random(3)
    pieces = [" ".join(r.choice(["a", "bb", "ccc", "d" * 70]) + r.choice(["", "", " ", "\t"]) for _ in range(n)) for n in (0, 1, 2, 3, 90, 5, 200, 1, 60)]
    text = "".join(p + r.choice(".\n,") for p in pieces) + " e" * 100
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "x", "x"], "text": [text, None, "d" * 70 + "\n" + "bb " * 80]})
    got, want = Counter(), Counter()
    for _, data in collocations._together(batch):
        begin, end, found = collocations._phrases("x", data)
        for k, first, _ in found:
            got.update(" ".join(data[begin[i] : end[i + k - 1]].decode().split()) for i in first)
    for x in (text, "d" * 70 + "\n" + "bb " * 80):
        for piece in re.split("[.,\n]", x):
            w = piece.split()
            want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want


def test_words_of_equal_hashes_stay_apart(spark):
    odd = "a"
    for _ in range(12):  # this and its opposite have the same polynomial modulo 2^64
        odd += odd.translate(str.maketrans("ab", "ba"))
    pair = odd, odd.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{pair[i % 5 > 2]} x {pair[i % 2]}.", "en") for i in range(40)], "doc_id long, text string, lang string").coalesce(1)
    rows = rows_of(df)
    assert set(map(tuple, rows_of(collocations.mine(df, 4, 300)))) == plain_phrases(rows, 4, 300)


# --- 13 ---


URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.NET/x", "https://x.example.net/en/1?q=1", "https://example.net/en/", "https://notexample.net/en/1", "https://example.com/de/9#t", "http://m.example.com/en/9?a=1&b=2#f", "HTTP://u:p@Host.org:80/fr/x", "http://b.org/FR/x",
    "http://c.org?x://d.net/", "://net/", "http://net/fr/", "http://a.example.com/de", "x://y://net/z",
]


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url or "")
    return (lowered(m[1]), m[2], m[3]) if m else ("", "", "")


def plain_rule(host, path):
    fits = [(-len(h + p), h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else (None, None)


def plain_tokens(url):
    if "://" not in (url or ""):
        return set()
    host, path, rest = plain_parts(url)
    zero = lambda x: re.sub("[0-9]+", "0", x)
    query = re.match(r"\?([^#]*)", rest)
    out = {"h:" + zero(x) for x in host.split(".") if x} | {"p:" + zero(x) for x in re.split("[/._-]+", lowered(path)) if x}
    out |= {"q:" + zero(x) for x in re.split("[&;]", lowered(query[1])) if x} if query else set()
    return out | ({"f:"} if "#" in rest else set())


def plain_rules(rows, least, confidence):
    """All sets of tokens, counted one by one."""
    n, all_, bad = len(rows), Counter(), Counter()
    for tokens, is_bad in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                all_[s] += 1
                bad[s] += is_bad
    found = {s: bad[s] / all_[s] for s in all_ if bad[s] >= ceil(least * n) and bad[s] / all_[s] >= confidence}
    return {s: c for s, c in found.items() if not any(found.get(tuple(x for x in s if x != t), -1) >= c for t in s)}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(URLS + URLS[:4])] + [(None, "http://q.net/", None, 1)], "page_id long, url string, host string, verdict int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows_of(url_filters.judge(pages, url_filters.learn(pages, labels)))
    assert len(got) == len(URLS) + 5
    for r in got:
        host, path, _ = plain_parts((URLS + URLS[:4])[r["page_id"]] if r["page_id"] is not None else "http://q.net/")
        rule, action = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action or "allow")


def test_rules_are_all_of_the_token_sets(spark):
    r = random.Random(3)
    urls = [f"http://{r.choice(['www', 'm'])}.{r.choice(['ads', 'shop', 'news'])}.test/{r.choice(['en', 'de'])}/{i}" + r.choice(["", "?ref=x", "#top"]) for i in range(300)]
    bad = [int(("ads" in u and "/en/" in u) or ("m.shop" in u and r.random() < 0.8) or r.random() < 0.05) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b if i % 2 else None, b if not i % 2 else 0) for i, b in enumerate(bad)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    mined = rows_of(url_filters.learn(pages, labels, 0.02, 5, 0.7))
    want = plain_rules([(plain_tokens(u), b) for u, b in zip(urls, bad)], 0.02, 0.7)
    assert {tuple(m["antecedent"]): round(m["confidence"], 9) for m in mined} == {s: round(c, 9) for s, c in want.items()} and want
    rules = spark.createDataFrame(mined)
    for row in rows_of(url_filters.judge(pages, rules)):
        own = plain_tokens(urls[row["page_id"]])
        assert row["verdict"] == ("block" if any(set(s) <= own for s in want) else "allow")


def test_all_tokens_of_a_page_take_part_in_mining(spark):
    # 40 bad copies of a page of 70 tokens; a pair of tokens that tells more than each alone stands behind 14 others.
    copies = [("http://long.test/" + "/".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(68)), 1)] * 40
    extra = "/".join(f"k{chr(97 + i)}" for i in range(14))
    rows = copies + [(f"http://h.test/{extra}/{x}", int(x == "p/q")) for x in ("p/q", "p", "q") for _ in range(30)] + [("http://h.test/r", 0)] * 100
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    mined = rows_of(url_filters.learn(pages, labels, 0.02, 5, 0.9))
    own = plain_tokens(copies[0][0]) - {"h:test"}
    assert {tuple(m["antecedent"]) for m in mined} == {(t,) for t in own} | {("p:p", "p:q")} and len(mined) == len(own) + 1
    assert all(m["confidence"] == 1 for m in mined)


def test_query_answers_every_page(spark):
    got = url_filters.op13_url_filters(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()

"""Benchmark decontamination by a prefix-filtered set join (operator 9), in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.common import cut, fresh, small, table, with_rows, words

WINDOW = 13


def _key(docs: DataFrame) -> DataFrame:
    """A row's identity for joins, since doc_ids may repeat or be null: the doc_id and a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.length("text")).alias("h"), words(F.col("text")).alias("w"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (a key of the row, as item_ids may repeat), item_id, iw (its words), n (its windows' length) of items
    (item_id, text) that have words."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    return own.distinct().select(F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", F.least(F.size("iw"), F.lit(window)).alias("n"))


def _anchors(items: DataFrame, rare: DataFrame) -> DataFrame:
    """(word, item_id, place, size): of each window the rarest word's first place in the item. A document that
    holds the window holds that word, so nothing else needs a look."""
    each = items.select("item", "n", F.size("iw").alias("size"), F.posexplode("iw").alias("place", "word")).join(rare, "word", "left")
    # A window of n places begins at each of size - n + 1; a word is in up to n of them.
    begin = F.sequence(F.greatest(F.col("place") - F.col("n") + 1, F.lit(0)), F.least("place", F.col("size") - F.col("n")))
    inside = each.withColumn("begin", F.explode(begin))
    best = inside.groupBy("item", "begin").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "place")).alias("r"), F.first("size").alias("size"))
    return best.select(F.col("r.word").alias("word"), "item", F.col("r.place").alias("place"), "size").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    A window is 13 words in a row of an item (item_id, text), or all words of a shorter one. A document's word
    inside any occurrence of a window is hit; contaminated: at least one word, and 5 % of all, is. n_items: items
    with an occurring window; items_sha256: of their ids, sorted as text, joined by commas; an item_id that repeats counts once.

    Null and empty texts have no words, no hits and no contamination; items without words are left out; equal
    rows count each; no rows give no rows, and no items leave every document clean.

    The items' words are counted in all documents. The rarest word of each window is its necessary prefix; where
    a document has it, the item's and the document's places give one alignment, kept if a window fits there by
    position and length. Alignments, not windows, are joined to the texts, and each is verified word by word.
    """
    items = cut(windows_of(items, window), "items")
    vocabulary = items.select(F.explode("iw").alias("word")).distinct()
    keyed = _key(docs)
    rare = cut(keyed.select(F.explode("w").alias("word")).join(small(vocabulary, F.octet_length("word") + 16), "word").groupBy("word").agg(F.count(F.lit(1)).alias("seen")), "rarity")
    anchors = cut(_anchors(items, rare), "anchors")
    places = keyed.select("doc_id", "h", F.size("w").alias("size_w"), F.posexplode("w").alias("at", "word"))
    met = places.join(small(anchors, F.octet_length("word") + 40), "word").withColumn("shift", F.col("at") - F.col("place"))
    # The window of least words must fit: it has the anchor, so it begins at most window - 1 places before.
    least = F.least("size", F.lit(window))
    fits = (F.least(F.col("shift") + F.col("size"), F.col("size_w")) - F.greatest("shift", F.lit(0))) >= least
    aligned = cut(met.where(fits).select("doc_id", "h", "item", "shift").distinct(), "alignments")
    # Each text once, with all its alignments: those of one document, so at most its words times its items' places.
    wanted = aligned.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item", "shift")).alias("alignments"))
    own = with_rows(keyed, cut(wanted, "wanted"), "inner", width=32 + 24 * F.size("alignments")).dropDuplicates(["doc_id", "h"])
    pairs = own.select("doc_id", "h", "w", F.inline("alignments")).join(small(items, F.octet_length(F.array_join("iw", "")) + 16 * F.size("iw") + 64), "item")
    # From which place of the item to which the document goes along.
    low, high = F.greatest(-F.col("shift"), F.lit(0)), F.least(F.size("iw"), F.size("w") - F.col("shift"))
    begins = F.filter(
        F.sequence(low, high - F.col("n")), lambda b: F.slice("w", b + F.col("shift") + 1, F.col("n")) == F.slice("iw", b + 1, F.col("n"))
    )
    hits = pairs.select("doc_id", "h", "item_id", F.transform(begins, lambda b: F.struct((b + F.col("shift")).alias("first"), (b + F.col("shift") + F.col("n")).alias("last"))).alias("spans"))
    hits = hits.where(F.size("spans") > 0)
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))

    def add(acc: Column, s: Column) -> Column:
        return F.struct((acc["hit"] + F.greatest(s["last"] - F.greatest(s["first"], acc["reach"]), F.lit(0))).alias("hit"), F.greatest(acc["reach"], s["last"]).alias("reach"))

    # A document's own occurrences, so as many as its text is long.
    found = hits.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = found.select("doc_id", "h", F.aggregate(F.array_sort("spans"), start, add)["hit"].cast("long").alias("n_hit"), "ids")
    found = cut(found, "hits")
    sizes = keyed.select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
    joined = with_rows(sizes, found, "left", width=48 + F.octet_length(F.array_join("ids", "        "))).select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return joined.select(
        "doc_id", "h", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (all columns) without contaminated ones."""
    bad = cut(contamination(docs, items).where("contaminated").select("doc_id", "h").distinct(), "contaminated")
    h = fresh(docs, "h")
    return with_rows(docs.withColumn(h, F.xxhash64("text", F.length("text"))), bad, "left_anti", h, 24).drop(h)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")

"""Line deduplication by a deletion-neighbourhood join (operator 3), in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.common import cut, fresh, small, table, with_rows

#: Lines this long (characters, normalised) or longer are also compared within one edit; shorter ones only as they are.
NEAR_CHARS = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal(line: Column) -> Column:
    """A line as it is compared: lower case, white space at the ends dropped, elsewhere one blank."""
    line = F.lower(line)
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd |= F.contains(line, F.lit(c))
    # Most lines have only single blanks, and the search for these is far cheaper than the replacement.
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")).otherwise(line))


def _row_key() -> list[Column]:
    """doc_id and h, a hash of the text, since doc_ids may repeat or be null."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.length("text")).alias("h")]


def _half_keys(s: Column) -> Column:
    """Keys of which two lines within one edit share at least one.

    Take m, the shorter's length. An edit behind the middle of the first m characters leaves the first m div 2
    alike, one before it the last m - m div 2. Each line goes with m its own length and one less.
    """

    def both(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("head"), m, F.substring(s, F.lit(1), half)), F.xxhash64(F.lit("tail"), m, F.substring(s, F.length(s) - (m - half) + 1, m - half))]

    return F.array(*both(F.length(s)), *both(F.length(s) - 1))


def _at(word: Column, place: Column) -> Column:
    return F.xxhash64(word, place)


def _deletions(lines: DataFrame) -> DataFrame:
    """(line, variant, at) for each line (line, s): the hashes of the line without each one of its characters, and
    the character's place. A line's own hash is _whole's of the same words.

    A hash is the exclusive or of its words' hashes, each taken with the word's number. What stands before and
    behind a word is then known from running values, so a deletion costs its own word, however long the line is.
    """
    each = lines.select("line", F.posexplode(F.split("s", " ")).alias("p", "w"))
    each = each.withColumns({"same": _at(F.col("w"), F.col("p")), "less": _at(F.col("w"), F.col("p") - 1)})
    line = Window.partitionBy("line")
    up_to, next_ = line.orderBy("p").rowsBetween(Window.unboundedPreceding, -1), line.orderBy("p")
    zero = F.lit(0).cast("long")
    each = each.withColumns(
        {
            "before": F.coalesce(F.bit_xor("same").over(up_to), zero), "less_before": F.coalesce(F.bit_xor("less").over(up_to), zero), "offset": F.coalesce(F.sum(F.length("w") + 1).over(up_to), zero),
            "next": F.lead("w").over(next_), "less_next": F.lead("less").over(next_), "all": F.bit_xor("same").over(line), "less_all": F.bit_xor("less").over(line),
        }
    )
    # What stands behind a word is the whole without what stands before it and itself.
    each = each.withColumns(
        {
            "after": F.col("all").bitwiseXOR(F.col("before")).bitwiseXOR(F.col("same")),
            "shifted": F.col("less_all").bitwiseXOR(F.col("less_before")).bitwiseXOR(F.col("less")).bitwiseXOR(F.coalesce("less_next", zero)),
        }
    )
    w = F.col("w")
    inside = F.transform(
        F.sequence(F.lit(1), F.length(w)),
        lambda i: F.struct(
            (F.col("before").bitwiseXOR(F.col("after")).bitwiseXOR(_at(F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))), F.col("p")))).alias("variant"), (F.col("offset") + i).alias("at")
        ),
    )
    # The blank behind a word goes: the two words are one.
    merged = F.array(F.struct(F.col("before").bitwiseXOR(F.col("shifted")).bitwiseXOR(_at(F.concat(w, F.col("next")), F.col("p"))).alias("variant"), (F.col("offset") + F.length(w) + 1).alias("at")))
    none = F.array().cast("array<struct<variant:long,at:long>>")
    found = F.concat(F.when(F.length(w) > 0, inside).otherwise(none), F.when(F.col("next").isNotNull(), merged).otherwise(none))
    return each.select("line", F.inline(found))


def _whole(s: Column) -> Column:
    """The hash that a deletion of another line has if it leaves s."""
    hashes = F.transform(F.split(s, " "), _at)
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def repeats(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, h, line_no, near): the lines of docs (doc_id, text) that an earlier line makes superfluous.

    Lines are compared as normal() has them, in the order of doc_id (null first), hash of the text, line number. A
    line goes if an earlier one is equal to it, or if both have near_chars characters or more and an edit distance
    of 1: one character put in, left out or changed. What is compared with is every earlier line, be it kept or
    not. near tells that the line has no equal that comes earlier. Blank lines are never compared.

    Distinct lines are found by sums of hashes. Those that share a half with another one are candidates; only they
    emit their deletions, which meet as hashed keys: the same deletion at the same place is a change, a deletion
    that is another whole line is a character more. Each meeting group sends all members to its earliest line,
    which is enough, as all of a group are within one edit of each other; so a group of n gives n pairs. The pairs'
    edit distance is computed exactly.
    """
    each = docs.select(*_row_key(), F.posexplode(_lines(F.col("text"))).alias("line_no", "s")).withColumn("s", normal(F.col("s"))).where("s <> ''")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h", "line_no")
    hashed = cut(each.select(F.xxhash64("s").alias("line"), F.hash("s", F.length("s")).alias("more"), order.alias("place"), F.when(F.length("s") >= near_chars, _half_keys(F.col("s"))).alias("halves")), "hashed")
    # Of equal lines the earliest; equal lines have equal halves.
    first = cut(hashed.groupBy("line", "more").agg(F.min("place").alias("first"), F.first("halves").alias("halves")), "lines")
    halves = first.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("half")
    candidates = cut(halves.join(shared, "half", "left_semi").select("line").distinct(), "candidates")
    # A candidate's text is read where the line is first; a document's own candidates are no more than its lines.
    places = first.groupBy("line").agg(F.min("first").alias("first")).join(small(candidates, 16), "line", "left_semi")
    row = [F.when(F.col("first.known"), F.col("first.doc_id")).alias("doc_id"), F.col("first.h").alias("h")]
    asked = cut(places.groupBy(*row).agg(F.collect_list(F.struct("line", "first")).alias("asked")), "asked")
    found = with_rows(docs.select(*_row_key(), "text"), asked, "inner", width=32 + 56 * F.size("asked")).select("asked", _lines(F.col("text")).alias("own"))
    texts = found.select(F.inline(F.transform("asked", lambda x: F.struct(x["line"].alias("line"), x["first"].alias("first"), F.get("own", x["first"]["line_no"]).alias("s"))))).withColumn("s", normal(F.col("s"))).dropDuplicates(["line"])
    texts = cut(texts, "texts")
    variants = cut(_deletions(texts.select("line", "s")).join(texts.select("line", "first"), "line"), "deletions")
    group = variants.groupBy("variant", "at").agg(F.min(F.struct("first", "line")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("variant", "at", "head")
    changed = variants.join(group, ["variant", "at"]).select("line", "first", F.col("head.line").alias("other"), F.col("head.first").alias("other_first")).where("first > other_first")
    whole = texts.select(_whole(F.col("s")).alias("variant"), F.col("line").alias("other"), F.col("first").alias("other_first"))
    longer = variants.join(whole, "variant").where("line <> other")
    # The longer line goes for an earlier shorter one, the shorter one for the earliest longer one.
    drop_long = longer.where("first > other_first").select("line", "first", "other", "other_first")
    drop_short = longer.where("first < other_first").groupBy(F.col("other").alias("line"), F.col("other_first").alias("first")).agg(F.min(F.struct("first", "line")).alias("head"))
    drop_short = drop_short.select("line", "first", F.col("head.line").alias("other"), F.col("head.first").alias("other_first"))
    pairs = cut(changed.union(drop_long).union(drop_short).select("line", "other").distinct(), "pairs")
    a, b = texts.select("line", F.col("s").alias("a")), texts.select(F.col("line").alias("other"), F.col("s").alias("b"))
    near = cut(pairs.join(a, "line").join(b, "other").where(F.levenshtein("a", "b", 1).between(0, 1)).select("line").distinct().withColumn("near", F.lit(True)), "near")
    known = cut(first.select("line", "more", "first").join(small(near, 16), "line", "left"), "firsts")
    lines = hashed.select("line", "more", "place").join(known, ["line", "more"]).where("place <> first or near").select("place", (F.col("place") == F.col("first")).alias("near"))
    return lines.select(F.when(F.col("place.known"), F.col("place.doc_id")).alias("doc_id"), F.col("place.h").alias("h"), F.col("place.line_no").alias("line_no"), "near")


def dedup(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with their text cut to the lines that repeats() leaves, and n_lines, n_kept, n_near.

    A text none of whose lines goes stays as it is, null included (which has one, blank line). One all of whose
    lines that aren't blank go becomes empty. Of several equal rows (doc_id and text) none counts as earlier than
    the other, so both keep the same lines. Other columns stay.
    """
    names = {x: fresh(docs, x) for x in ("n_lines", "n_kept", "n_near", "h", "gone", "near", "lines", "left")}
    gone = repeats(docs.select("doc_id", "text"), near_chars).distinct()
    gone = gone.groupBy("doc_id", "h").agg(F.collect_set("line_no").alias(names["gone"]), F.count_if("near").alias(names["near"]))
    gone = cut(gone, "gone")
    joined = with_rows(docs.withColumn(names["h"], F.xxhash64("text", F.length("text"))), gone, "left", names["h"], 32 + 8 * F.size(names["gone"]))
    lines, gone, left = _lines(F.col("text")), F.col(names["gone"]), F.col(names["left"])
    split = names["lines"]
    joined = joined.withColumn(split, F.when(gone.isNotNull(), lines))
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    joined = joined.withColumn(names["left"], F.when(gone.isNotNull(), F.transform(places, lambda i: F.get(split, i))))
    worded = F.exists(left, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    text = F.when(gone.isNull(), F.col("text")).when(worded, F.array_join(left, "\n")).otherwise("")
    breaks = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    n_lines = (breaks + 1).cast("long")
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], n_lines.alias(names["n_lines"]),
        F.when(gone.isNotNull(), F.size(left).cast("long")).otherwise(n_lines).alias(names["n_kept"]), F.coalesce(names["near"], F.lit(0)).cast("long").alias(names["n_near"]),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def keep_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs (all columns) with their repeated lines cut out; those that are left without a word go.

    A text that had no word from the start stays. A column n_chars follows a text that has changed.
    """
    done = dedup(docs, near_chars)
    added = [c for c in done.columns if c not in docs.columns]
    n_lines, n_kept = added[0], added[1]
    changed = F.col(n_kept) < F.col(n_lines)
    kept = done.where(~(changed & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)

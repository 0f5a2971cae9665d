"""How the sources of a language differ in their terms (operator 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.common import cut, small, table
from tracewright.llm.counting import by_text, byte_table, word_counts
from tracewright.llm.radix_select import top

#: Terms are what is left between these once A-Z are lower case.
_TABLE = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LEAST_DOCS, RANKS = 3, 200
SCALE = 1_000_000_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_TABLE).split()


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE (n + 1) / total); products beyond 64 bits go by decimals."""
    wide = F.expr(f"cast({SCALE} as decimal(10,0))") * (n + 1).cast("decimal(20,0)")
    return F.when(n < 9 * SCALE, F.call_function("div", (n + 1) * SCALE, total)).otherwise(F.call_function("div", wide, total.cast("decimal(20,0)"))) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the terms in least_docs rows of their language or more. lang_n is the
    language's count; first marks one row of each term."""
    parts = word_counts(docs.select(by_text("lang"), by_text("source"), "text"), ["lang", "source"], terms)
    # One exchange by (lang, term) serves the sums by source and those over all sources.
    each = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    every = each.withColumns({"lang_docs": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "first": F.min("source").over(of) == F.col("source")})
    return every.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for every occurring (lang, source): total (its kept terms' count and the number of these, together), lang_total,
    n_terms, and zero, the share of a term that is not there (0 where nothing is kept)."""
    lang = kept.groupBy("lang").agg(F.count_if("first").alias("n_terms"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = docs.select(by_text("lang"), by_text("source")).distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0, ["n", "n_terms", "lang_n"])
    made = every.select("lang", "source", "n_terms", (F.col("n") + F.col("n_terms")).alias("total"), (F.col("lang_n") + F.col("n_terms")).alias("lang_total"))
    return made.withColumn("zero", F.when(F.col("n_terms") > 0, share(F.lit(0).cast("long"), F.col("total"))).otherwise(0))


def pairs(shares: DataFrame, groups_: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language.

    A term that neither has adds the same to a pair, so sums run over what is there, corrected for that baseline: over each
    side's terms as if the other lacked them (by counts of equal shares), and over the terms of both by what that got wrong.
    """
    one, two = groups_.select("lang", "source", "zero", "n_terms"), groups_.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    every = one.join(small(two, 64 + F.length("lang") + F.length("item")), "lang").where("source <> item")
    base = distance(F.col("zero"), F.col("item_zero"))
    alike = shares.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("m"))
    lone = alike.join(small(two, 64 + F.length("lang") + F.length("item")), "lang").where("source <> item")
    there = F.col("m") * (distance(F.col("p"), F.col("item_zero")) - base)
    back = F.col("m") * (distance(F.col("item_zero"), F.col("p")) - distance(F.col("item_zero"), F.col("zero")))

    def summed(df: DataFrame, a: Column, b: Column) -> DataFrame:
        got = df.groupBy("lang", "source", "item").agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
        turn = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("v"))
        return got.select("lang", F.inline(F.array(turn("source", "item", "a"), turn("item", "source", "b"))))

    left, right = shares.select("lang", "term", "source", "p", "zero"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("item_zero"))
    met = left.join(right, ["lang", "term"]).where("source < item")
    p, r, zero, item_zero = (F.col(c) for c in ("p", "r", "zero", "item_zero"))
    fix = lambda p, r, p0, r0: distance(p, r) - distance(p, r0) - distance(p0, r) + distance(p0, r0)
    found = summed(lone, there, back).union(summed(met, fix(p, r, zero, item_zero), fix(r, p, item_zero, zero)))
    total = found.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    value = F.when(F.col("n_terms") > 0, F.col("n_terms") * base + F.coalesce("v", F.lit(0)).cast("long")).otherwise(0)
    return every.join(total, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def audit(docs: DataFrame, ranks: int = RANKS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part pair ranks a source's divergence from every other source of its language, part term the terms that it has more of
    than its language, to ranks. Null text, lang and source are empty; each row is a document of its own, repeated ones
    too; equal values rank by item; a group without kept terms has pairs of its baseline, or of 0 where its language keeps
    none; no rows give no rows. Other columns are not read.
    """
    kept = cut(counted(docs, least_docs), "divergence-counts")
    of = cut(groups(docs, kept), "divergence-groups")
    own = kept.join(small(of, 64 + F.length("lang") + F.length("source")), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    shares = cut(own.select("lang", "source", "term", "zero", p.alias("p"), q.alias("q")), "divergence-shares")
    # A source's pairs are as many as its language has sources.
    by_pair = pairs(shares, of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_term = top(more, ["lang", "source"], ranks)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(by_pair, "pair").union(part(by_term, "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))

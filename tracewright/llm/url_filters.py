"""Filtering of pages by their URLs (operator 13): listed rules first, association rules of URL tokens for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.llm.common import cut, lower_ascii, small, table

#: (action, host, path). Fixed by the contract of op13_url_filters.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: What a transaction names its label; tokens begin with a small letter and a colon, so none is equal to it.
BLOCK = "=block"
#: A rule must hold in this share of the labelled pages, and in SUPPORT_ROWS of them; CONFIDENCE of those that have its tokens must be bad.
SUPPORT, SUPPORT_ROWS, CONFIDENCE = 0.005, 20, 0.6


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and what follows the path. Null, or no '://': all empty."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host, path = F.regexp_extract(rest, "^[^/?#]*+", 0), F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)
    return lower_ascii(host), path, F.substring(rest, F.length(host) + F.length(path) + 1, F.length(rest))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The rule that fits, as a struct (rule, action), or null. A rule fits its host and all below it, if the path starts
    with the rule's; of several the longest wins (of equally long ones the first by name). rules is a short list."""
    of = lambda r: F.struct((-F.lit(len(r[1] + r[2]))).alias("length"), F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("action"))
    fits = [F.when(((host == r[1]) | host.endswith(f".{r[1]}")) & path.startswith(r[2]), of(r)) for r in rules]
    best = F.array_min(F.array_compact(F.array(*fits)))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def tokens(url: Column) -> Column:
    """What a URL is made of, each once: h: labels of the host, p: parts of the path, q: parts of the query, f: a fragment.

    Digits are written as one 0, so that numbered pages share tokens. A URL without '://' has none.
    """
    host, path, rest = parts(url)
    query, mark = F.regexp_extract(rest, r"^\?([^#]*+)", 1), F.when(F.instr(rest, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    named = lambda kind, text, at: F.transform(F.filter(F.split(text, at), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]++", "0")))
    return F.array_distinct(F.concat(named("h:", host, r"\."), named("p:", lower_ascii(path), r"[/._-]+"), named("q:", lower_ascii(query), "[&;]"), mark))


def alike(seen: DataFrame) -> DataFrame:
    """(token, name) of frequent tokens (token, n, m, a, b): tokens of the same labelled pages share a name, the first of them.

    a and b are 64-bit sums over a token's pages, so equal counts and sums tell equal sets of pages. A page of many tokens
    with many copies then counts as few items in mining, where it had 2^tokens sets.
    """
    return seen.withColumn("name", F.min("token").over(Window.partitionBy("n", "m", "a", "b"))).select("token", "name")


def spelled(found: DataFrame, named: DataFrame) -> DataFrame:
    """found, rules of names, with a row for every choice of one token of each name."""
    members = named.groupBy("name").agg(F.collect_list("token").alias("tokens"))  # at most tokens a page / support rows in all
    own = found.withColumn("rule", F.array_join("antecedent", " ")).select("rule", "confidence", "support", F.explode("antecedent").alias("name")).join(small(members, F.lit(64)), "name")
    sets = own.groupBy("rule", "confidence", "support").agg(F.collect_list("tokens").alias("sets"))
    none = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("sets", none, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.concat(d, F.array(t))))))
    return sets.select(F.explode(choices).alias("antecedent"), "confidence", "support").withColumn("antecedent", F.array_sort("antecedent"))


def learn(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support): sets of tokens whose pages are mostly bad, mined by Spark's FP-growth.

    labels: doc_id, quality, toxic; a page of that id is bad if any of its labels is toxic or of quality 0. Equal pages
    count once. A rule goes if one with a token less is as confident. Few or no labelled pages give no rules. All frequent
    tokens of all labelled pages take part.
    """
    spark = pages.sparkSession
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").distinct().join(marks, "page_id").select("page_id", "url", "bad", tokens(F.col("url")).alias("tokens"))
    own = cut(own, "url-labelled")
    n, n_bad = own.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(support, support_rows / n) if n else 2.0
    if not n_bad or least > 1:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    each = own.select("page_id", "url", "bad", F.explode("tokens").alias("token"))
    # A rule's tokens stand in enough bad pages, so others can be in none.
    marks = F.bit_xor(F.xxhash64("page_id", "url")).alias("a"), F.bit_xor(F.xxhash64("url", "page_id", F.lit(1))).alias("b")
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("m"), *marks).where(F.col("m") >= least * n)
    named = cut(alike(seen), "url-tokens")  # at most tokens a page / support rows
    told = each.join(small(named, F.length("token") + F.length("name") + 32), "token").groupBy("page_id", "url", "bad").agg(F.collect_set("name").alias("t"))
    sets = told.select(F.concat(F.col("t"), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    # Labelled pages without a frequent token still count as pages.
    short = n - told.count()
    if short:
        sets = sets.union(spark.range(short).select(F.array(F.lit("=none")).alias("items")))
    mined = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(sets)
    found = mined.associationRules.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    found = cut(found, "url-rules")
    less = found.select("antecedent", "confidence", F.explode("antecedent").alias("token")).select(F.col("antecedent").alias("of"), "confidence", F.array_except("antecedent", F.array("token")).alias("antecedent"))
    shorter = less.join(found.select("antecedent", F.col("confidence").alias("as_good")), "antecedent").where("as_good >= confidence").select(F.col("of").alias("antecedent")).distinct()
    return spelled(found.join(shorter, "antecedent", "left_anti"), named)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, tokens_rule, confidence) for those of the distinct urls that have all tokens of a rule, with the most confident
    one (then of most support, then first by name). An inverted index: tokens are joined with the rules they are in, and a
    rule fits where as many of its tokens are met as it has."""
    rule = rules.select(F.array_join("antecedent", " ").alias("tokens_rule"), "confidence", "support", F.size("antecedent").alias("size"), F.explode("antecedent").alias("token"))
    index = small(rule, 128 + F.length("tokens_rule") + F.length("token"))
    hits = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
    whole = hits.groupBy("url", "tokens_rule", "confidence", "support", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("tokens_rule").alias("r"))).alias("b")
    return whole.groupBy("url").agg(best).select("url", F.col("b.r").alias("tokens_rule"), (-F.col("b.c")).alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, tokens_rule, confidence of every row of pages (page_id, url).

    The listed rule decides where one fits; else a page that meets a mined rule (columns of learn()) is blocked, all
    others are allowed. Null and odd URLs are allowed; repeated rows are answered again; other columns are not read.
    """
    host, path, _ = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path")).withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    open_ = own.where("listed is null and url is not null").select("url").distinct()
    hits = matched(open_, mined)
    both = own.join(small(hits, F.length("url") + F.length("tokens_rule") + 64), "url", "left")
    free = F.col("listed").isNull()
    verdict = F.when(~free, F.col("listed.action")).when(F.col("tokens_rule").isNotNull(), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), F.when(free, F.col("tokens_rule")).alias("tokens_rule"), F.when(free, F.col("confidence")).alias("confidence"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, learn(pages, table(spark, sf_dir, "labels")))

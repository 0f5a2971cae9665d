"""Near-duplicate classes by ProbMinHash, banding and exact verification (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from tracewright.llm.common import Scratch, cut, fresh, small, table, with_rows
from tracewright.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Registers of a signature. With equal weights, as here, registers agree with the probability of the Jaccard similarity
#: itself, each on its own, so a pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**32, 6e-5.
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared with its pivot in one run of rows; the pivot's set is sent once for each run.
RUN = 256
#: Members of a bucket that are compared with each other at once; in a larger one of several blocks they are compared with one of them before.
PAIRED = 256
#: Hashes of the sets in a block, about; members of a bucket are dealt to blocks, and two blocks are held in memory at once.
BLOCK_HASHES = 1 << 18
_CHUNK = 200_000
_NEAR_ZERO = 1e-9


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(text), SHINGLE))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, a row a set. An empty set's row is meaningless.

    Each element of weight w arrives at the times of a Poisson process of rate w, seeded by its hash, and each
    arrival hits one register at random; a register keeps the element that hits it first. Two sets agree in a
    register with the probability Jaccard similarity of their weights. An element stops once its next arrival
    is later than the last register's first hit, since it can't change any more.

    All sets go together: a round takes one arrival of every element that has not stopped.
    """
    sizes = np.array([len(h) for h, _ in sets], np.int64)
    hit = np.full(len(sets) * registers, np.inf)
    who = np.zeros(len(sets) * registers, np.uint64)
    live = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate([h for h, _ in sets]) if sets else np.empty(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]) if sets else np.empty(0)
    at = np.zeros(len(x))
    turn = 0
    while len(x):
        turn += 1
        draw = mix(x + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = live * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(at < hit[register])
        # Of several in one register the earliest is written last.
        better = better[np.argsort(-at[better], kind="stable")]
        hit[register[better]] = at[better]
        who[register[better]] = x[better]
        owners = np.unique(live)
        limit = np.zeros(len(sets))
        limit[owners] = hit.reshape(-1, registers)[owners].max(axis=1)
        stay = at < limit[live]
        live, x, rate, at = live[stay], x[stay], rate[stay], at[stay]
    return who.reshape(-1, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, text) to (doc_id, node, n, bands); texts without words have no bands.

    All shingles weigh the same, however often a text repeats them, as in the similarity that links are judged by.
    """

    def flush(ids: list, nodes: list, sets: list) -> pa.RecordBatch:
        keys = band_keys(signatures(sets))
        sizes = np.array([len(h) for h, _ in sets])
        offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), bands], ["doc_id", "node", "n", "bands"])

    ids, nodes, sets, size = [], [], [], 0
    for b in batches:
        for doc, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            found = shingle_set(text.as_py())
            sets.append((found, np.ones(len(found))))
            ids.append(doc)
            nodes.append(node)
            size += len(found)
            if size >= _CHUNK or len(sets) >= 1000:
                yield flush(ids, nodes, sets)
                ids, nodes, sets, size = [], [], [], 0
    if sets:
        yield flush(ids, nodes, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingles): the distinct hashes as bytes."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "shingles"])


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, run, node, shingles), for each pivot and run first the pivot's own, whose node is null, to the (a, b) that are alike."""
    one = np.empty(0, np.uint64)
    for batch in batches:
        rows: tuple[list, ...] = ([], [])
        for pivot, node, own in zip(batch.column(0), batch.column(2), batch.column(3)):
            x = np.frombuffer(own.as_buffer(), np.uint64)
            if not node.is_valid:
                one = x.copy()
                continue
            both = int((one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x).sum())
            if both >= SIMILARITY * (len(x) + len(one) - both) - _NEAR_ZERO:
                rows[0].append(node.as_py())
                rows[1].append(pivot.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in rows], ["a", "b"])


def with_pivots(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of distinct (node, pivot) those that are alike by their exact sets.

    The nodes that go with one pivot are dealt to runs of about RUN rows, so that a pivot with very many is spread over
    tasks; a run's rows are sorted behind the pivot's set and streamed past it.
    """
    runs = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    dealt = asked.join(runs, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("runs")).cast("int").alias("run"), "node")
    members = dealt.join(sets, "node").select("pivot", "run", "node", "shingles")
    pivots = runs.withColumnRenamed("pivot", "node").join(sets, "node")
    pivots = pivots.select(F.col("node").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("binary").alias("node"), "shingles")
    return pivots.union(members).repartition("pivot", "run").sortWithinPartitions("pivot", "run", F.col("node").asc_nulls_first()).mapInArrow(_with_pivots, "a binary, b binary")


def linked_roots(roots: list[bytes], sets: list[np.ndarray], first: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of roots that lead from each root to all those that alike sets link it with; no more than there are roots.

    first: how many of the sets are the first block's, to be compared with the others only; 0: all with each other.
    """
    names, label = np.unique(np.array(roots, object), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)
    at = label.copy()
    for a in range(first or len(sets) - 1):
        rest = max(first, a + 1)
        open_ = (at[rest:] != at[a]) & (np.minimum(sizes[rest:], sizes[a]) >= SIMILARITY * np.maximum(sizes[rest:], sizes[a]) - _NEAR_ZERO)
        if not open_.any():
            continue
        own = place[begin[a] : begin[a + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[place[begin[rest] :]], begin[rest:-1] - begin[rest])
        mark[own] = 0
        for b in rest + np.flatnonzero(open_ & (both >= SIMILARITY * (sizes[a] + sizes[rest:] - both) - _NEAR_ZERO)):
            if at[b] != at[a]:
                yield names[label[a]], names[label[b]]
                at[at == at[b]] = at[a]


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, block, root, shingles), sorted by the first four, to (a, b): linked_roots() of each (band, i, j)."""

    def flush(roots: list, sets: list, blocks: list) -> pa.RecordBatch:
        found = list(linked_roots(roots, sets, blocks.count(blocks[0]) if last[1] != last[2] else 0)) if len({*blocks}) == 1 + (last[1] != last[2]) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    last, roots, sets, blocks = (0, 0, 0), [], [], []
    for batch in batches:
        for *key, block, root, own in zip(*[batch.column(k).to_pylist() for k in range(6)]):
            if sets and last != tuple(key):
                yield flush(roots, sets, blocks)
                roots, sets, blocks = [], [], []
            last = tuple(key)
            roots.append(root)
            sets.append(np.frombuffer(own, np.uint64))
            blocks.append(block)
    if sets:
        yield flush(roots, sets, blocks)


def within_buckets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of roots, by which all roots of alike members (band, node, root, total) of a band are joined.

    total: the hashes of all sets of the band. Members are dealt to blocks of about BLOCK_HASHES of them, and each two blocks
    meet in a group of rows of their own, so a member is sent once for each block of its band, pairs are only counted inside
    a task, and two blocks are all that a task holds.
    """
    blocks = F.ceil(F.col("total") / BLOCK_HASHES).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "node")
    rows = dealt.join(sets, "node").select("band", "i", "j", "block", "root", "shingles")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block").mapInArrow(_within_blocks, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that links (a, b) lead to, for every node that has a link.

    Each round a node takes the smallest root among its own, its neighbours' and that root's own root. A round's
    sums are made per task before they are shuffled, so a node with very many links is no burden; the roots are
    written to the shared folder each time, and only the number of changes comes to the driver.
    """
    both = scratch.cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    roots = scratch.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        # What a root's members have seen, told to the root; and the root's own root, told to its members.
        told = near.join(roots.select("node", F.col("root").alias("own")), "node").select(F.col("own").alias("node"), "root").where("node > root")
        # Each node's root so far goes along, so the write itself counts the changes and no second job joins the tables again.
        best = near.union(told).withColumn("old", F.lit(None).cast(roots.schema["root"].dataType)).union(roots.withColumn("old", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        up = best.join(roots.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.least("root", F.coalesce("higher", "root")).alias("root"), "old")
        seen = Observation()
        new = scratch.cut(up.observe(seen, F.count_if(F.col("root") != F.col("old")).alias("changed")).select("node", "root"), "roots")
        # Without any row there may be no count either.
        changed = seen.get.get("changed")
        scratch.drop(roots)
        roots = new
        if not changed:
            scratch.drop(both)
            return roots


def text_key(text: str = "text") -> F.Column:
    """The key that equal texts share; null and empty are equal."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, shingles) with the hashes as an array."""
    for b in batches:
        own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *own])))], ["node", "root", "hashes"])


def rarest(nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, place): the buckets in which every alike pair of nodes (node, root) of different roots meets; a band is a hash.

    All hashes have one order: first those that a single root's nodes have, then by how many of the nodes have them. If
    a and b are alike, they share 0.8 |a| hashes or more, so the first they share is among the first 0.2 |a| + 1 of a, and
    so of b. place is the number of a node's hashes before the band: two nodes that share none before share no more
    than what either has from there on.
    """
    own = scratch.cut(nodes.join(sets, "node").select("node", "root", "shingles").mapInArrow(_listed, "node binary, root binary, hashes array<long>"), "hashes")
    each = own.select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("band"))
    common = each.groupBy("band").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "df")
    mine = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "band")) - 1
    ranked = each.join(common, "band").select("band", "node", "n", place.cast("int").alias("place"))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - _NEAR_ZERO)).select("band", "node", "place")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, root, worded) for each row of docs (doc_id, text), where node is the text's key, root the
    smallest node of its class and worded whether it has words.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more, and a
    class is what links lead to; class_id is its smallest doc_id. Words are of lower-case A-Z, digits and all
    beyond ASCII; a shorter text has one shingle. Texts without words (null, empty, punctuation) stay alone:
    class_id is their own doc_id, also for several equal ones. Equal doc_ids are rows of their own; a class
    whose doc_ids are all null has a null class_id. No rows give no rows.

    Equal texts are one node from the start. Signatures give each node its band keys; nodes that share one are a bucket,
    and a bucket's members are candidates for each other. First each node is compared, exactly, with one hub, the
    member of its buckets that meets most others: n comparisons join most of what is alike. A bucket whose members
    are all of one class by then is done. The members of one of up to PAIRED, or of one block, are sent together to a task that compares those
    of different classes with each other and tells which classes meet (within_buckets); in a larger one all are compared
    with a pivot, and those left apart then meet by their rarest hashes (rarest), in buckets that are compared block by block.
    So no table has a row for each pair, and no link between candidates is lost.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("node"), "text")
    signed = keyed.mapInArrow(_bands, "doc_id long, node binary, n int, bands array<long>")
    banded = scratch.cut(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "bands")
    each = banded.select("node", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = scratch.cut(each.join(shared, "band").select("band", "node", "n", "m"), "buckets")
    nodes = scratch.cut(met.groupBy("node").agg(F.sum("m").alias("met"), F.first("n").alias("n")), "wanted")
    texts = keyed.select("node", "text").join(small(nodes.select("node"), 16), "node", "left_semi").dropDuplicates(["node"])
    sets = scratch.cut(texts.mapInArrow(_sets, "node binary, shingles binary"), "sets")

    def of_pivots(members: DataFrame) -> DataFrame:
        """members (band, node, ...) but for each band's pivot, with it, p (met, node)."""
        pivots = members.join(nodes, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("p"))
        return members.join(pivots, "band").where("node <> p.node")

    def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
        """The members (band, node, n) whose band has several classes, with root and the band's number of members, m, and of hashes, total."""
        placed = scratch.cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("low <> high").select("band", "m", "total")
        left = scratch.cut(placed.join(split, "band"), "left")
        scratch.drop(placed)
        return left

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """roots with those joined that links (a, b) of roots lead to."""
        higher = components(links, scratch)
        # A node that had no link until now is its own root.
        more = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        new = scratch.cut(more.union(higher.join(roots, "node", "left_anti")), "roots")
        scratch.drop(higher, roots)
        return new

    hubs = scratch.cut(of_pivots(met.select("band", "node")).groupBy("node").agg(F.max("p").alias("p")).select("node", F.col("p.node").alias("pivot")), "hubs")
    links = scratch.cut(with_pivots(hubs, sets), "hub-links")
    roots = components(links, scratch)
    left = apart(met.select("band", "node", "n"), roots)
    scratch.drop(hubs, links, met)
    is_large = (F.col("m") > PAIRED) & (F.col("total") > BLOCK_HASHES)
    links = within_buckets(left.where(~is_large), sets)
    large = left.where(is_large).select("band", "node", "n")
    if large.limit(1).count():
        asked = scratch.cut(of_pivots(large).select("node", F.col("p.node").alias("pivot")).distinct(), "asked")
        alike = with_pivots(asked, sets)
        for side in ("a", "b"):
            alike = alike.join(roots.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        roots = joined(roots, links.union(alike.select("a", "b")))
        still = apart(large, roots)
        rest = rarest(still.select("node", "root").distinct(), sets, scratch).select("band", "node")
        rest = apart(rest.join(nodes.select("node", "n"), "node"), roots)
        links = within_buckets(rest, sets)
    roots = joined(roots, links)
    firsts = banded.select("node", "first", (F.col("n") > 0).alias("worded"))
    # Nodes without a link are classes of their own.
    of_class = roots.join(roots.join(firsts, "node").groupBy("root").agg(F.min("first").alias("class_id")), "root")
    placed = firsts.join(of_class, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "first", "worded", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"))
    place = cut(placed, "classes")
    scratch.drop()
    return keyed.select("doc_id", "node").join(place, "node").select("doc_id", "node", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "root", "worded")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs (all columns) with one row of each class: that of the smallest doc_id, of equal ones any one row.

    Rows without words all stay. A class whose doc_ids are all null keeps the row of the smallest text key. Classes are
    told apart by root: several may have the same class_id, or none, if doc_ids repeat or are null.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(classes(docs.select("doc_id", "text")).where("worded").select("doc_id", "node", "root"), "rows")
    key, node = F.struct(F.col("doc_id").isNull(), "doc_id", "node"), fresh(docs, "node")
    firsts = found.groupBy("root").agg(F.min(key).alias("k")).select("root", F.col("k.doc_id").alias("first_id"), F.col("k.node").alias("first_node"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node"))
    gone = cut(found.join(firsts, "root").where(~is_first).select("doc_id", F.col("node").alias("h")).distinct(), "copies")
    repeated = cut(found.groupBy("doc_id", F.col("node").alias("h")).count().where("count > 1").select("doc_id", "h"), "repeated")
    scratch.drop()
    kept = with_rows(docs.withColumn(node, text_key()), gone, "left_anti", node, 24)
    if repeated.limit(1).count():
        once = with_rows(kept, repeated, "left_semi", node, 24).dropDuplicates(["doc_id", node])
        kept = with_rows(kept, repeated, "left_anti", node, 24).unionByName(once)
    return kept.drop(node)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")

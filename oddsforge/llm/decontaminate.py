"""Operator 2: benchmark decontamination, in DataFrame functions only.

Benchmark items and item-sized windows of documents (as many words as the item) get 64-bit SimHash
fingerprints over their shingles, a shingle weighing as often as it occurs. Fingerprints are cut into
``radius + 1`` blocks: two within ``radius`` bits agree in one block at least, so a join on (item size, block,
value) finds every pair within the radius. Each pair is then verified by the exact weighted similarity of
its shingles, sum of least counts over sum of greatest counts, at 0.8 or more.

Which windows: only those whose first shingle is a shingle of some item of that size. That loses nothing: a
window that starts with another shingle can be moved right to the next shared one without losing a match.
The radius: at a similarity of 0.8 the angle of two shingle vectors is 0.48 rad at most, 9.7 of 64 bits
expected with a deviation of 2.9; the default 21 stands four deviations off.

Words are runs without white space, A-Z lower-cased; shingles take five words, an item of fewer words is one
shingle. Defined results: null or empty texts and items without words match nothing; equal items each match;
repeated rows of a document give one row per item; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.common import SPACES, broadcast_if_small, lower_ascii, partitions, written

K = 5


def words(text: Column) -> Column:
    t = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def shingles(ws: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles, in order of their places."""
    n = F.size(ws)
    return F.when(n < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])))


def simhash(hashes: Column) -> Column:
    """Bit b is set where more shingles have it than not; a repeated shingle counts each time.

    The 64 counters stand four to a long, 16 bits each; an item of more than 65,535 shingles has its bits
    counted one by one."""
    lanes, names = F.lit(0x0001000100010001).cast("long"), [f"s{j}" for j in range(16)]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    counts = F.aggregate(hashes, zero, lambda c, h: F.struct(*[
        (c[n] + F.shiftrightunsigned(h, j).bitwiseAND(lanes)).alias(n) for j, n in enumerate(names)]))
    place = lambda b: F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")

    def majority(c):
        bits = [F.when(F.shiftrightunsigned(c[n], 16 * lane).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.size(hashes), place(16 * lane + j)).otherwise(F.lit(0).cast("long"))
                for j, n in enumerate(names) for lane in range(4)]
        return reduce(Column.bitwiseOR, bits)

    def vote(acc, mask):
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(h.bitwiseAND(mask) != 0, 1).otherwise(-1))
        return acc.bitwiseOR(F.when(votes > 0, mask).otherwise(F.lit(0).cast("long")))

    one_by_one = F.aggregate(F.array(*[place(b) for b in range(64)]), F.lit(0).cast("long"), vote)
    return F.when(F.size(hashes) <= 0xFFFF, F.get(F.transform(F.array(counts), majority), F.lit(0))).otherwise(one_by_one)


def block_edges(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``radius + 1`` blocks of 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def numbered(hashes: Column) -> Column:
    """The shingles with their repetitions told apart: the first occurrence as it is, a later one hashed with its
    number. Set operations on such lists count each shingle as often as it occurs."""
    nth = lambda h, i: F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))
    tagged = F.transform(hashes, lambda h, i: F.when(nth(h, i) == 0, h).otherwise(F.xxhash64(h, nth(h, i))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(tagged)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest counts, of two numbered lists of shingles."""
    return F.get(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n)), F.lit(0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8, radius: int = 21) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the most similar window of each pair that has one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    items = items.withColumn("n_words", F.size("ws")).withColumn("k", F.least("n_words", F.lit(K)))
    items = written(items.withColumn("item_shingles", F.when(F.col("k") == K, shingles(F.col("ws"), K)).otherwise(F.array(F.expr(
        "case size(ws) when 4 then xxhash64(ws[0], ws[1], ws[2], ws[3]) when 3 then xxhash64(ws[0], ws[1], ws[2])"
        " when 2 then xxhash64(ws[0], ws[1]) else xxhash64(ws[0]) end")))).drop("ws").withColumn("item_fp", simhash(F.col("item_shingles"))).withColumn("item_numbered", numbered(F.col("item_shingles"))))
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]  # five values at most
    known = broadcast_if_small(items.select("n_words", F.explode("item_shingles").alias("h")).distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    hits = None
    for k in sizes:
        at = rows.select("doc_id", "text_hash", F.posexplode(shingles(F.col("ws"), k)).alias("start", "h"))
        one = at.join(known.filter(F.least("n_words", F.lit(K)) == k), "h").select("doc_id", "text_hash", "start", "n_words")
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:  # no item has a word
        hits = rows.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("n_words")).filter(F.lit(False))
    starts = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n_words")).alias("at"))
    starts = broadcast_if_small(starts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "at"), 20_000)
    windows = rows.join(starts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    windows = windows.select("doc_id", "ws", F.explode("at").alias("w")).select(
        "doc_id", F.col("w.start").alias("start"), F.col("w.n_words").alias("n_words"),
        F.slice("ws", F.col("w.start") + 1, F.col("w.n_words")).alias("win"))
    hashes = F.lit(None).cast("array<bigint>")
    for k in sizes:
        hashes = F.when(F.least("n_words", F.lit(K)) == k, shingles(F.col("win"), k)).otherwise(hashes)
    # written, so that no filter on a fingerprint is pushed below and computes it again
    windows = written(windows.withColumn("hashes", hashes).drop("win")).repartition(2 * partitions(docs.sparkSession))
    windows = written(windows.select("doc_id", "start", "n_words", numbered(F.col("hashes")).alias("numbered"), simhash(F.col("hashes")).alias("fp")))
    edges = block_edges(radius)
    blocks = lambda fp: F.posexplode(F.array(*[block(F.col(fp), *e) for e in edges])).alias("block", "value")
    probes = windows.select("*", blocks("fp"))
    index = broadcast_if_small(items.select("item_id", "n_words", "item_numbered", "item_fp", blocks("item_fp")))
    pairs = probes.join(index, ["n_words", "block", "value"])
    xor = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that agrees in several blocks is kept where it first does
    first = F.coalesce(*[F.when(block(xor, *e) == 0, F.lit(i)) for i, e in enumerate(edges)])
    pairs = pairs.filter((F.bit_count(xor) <= radius) & (first == F.col("block")))
    scored = pairs.withColumn("similarity", weighted_similarity(F.col("numbered"), F.col("item_numbered")))
    best = scored.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    best = best.filter(F.col("b.similarity") >= min_similarity)
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    bad = broadcast_if_small(leaks.select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")

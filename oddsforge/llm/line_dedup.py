"""Operator 8: line dedup, in DataFrame functions only.

Each line's key (white space stripped at both ends, A-Z lower-cased) becomes a 128-bit hash. The
occurrences (hash, document, position) are range-partitioned by hash and sorted inside each partition
by document, largest id first, and position; one pass of running ranks over that order sees the first
document of a key, whose lines stay, and all later ones. Result: per document the runs of lines to keep,
a run-length-compressed bitmap; texts never travel with the hashes.

A key that is much more frequent than a partition's share (a license line in a third of all documents) is
found from a histogram of 65,536 hash cells and dealt to many salted groups. Each of them can already
drop whatever stands behind two larger documents; only its first two documents go on to a second pass.

Defined results: null text is one empty line; documents of the same doc_id count as one document (a null
id is one too, below all others), and repeated rows get the same runs; an empty table gives no rows.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsforge.llm.common import SPACES, lower_ascii, partitions, written

CELLS = 65_536
LAST = 2**31 - 1


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of every line whose key has ``min_chars`` code points or more."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(lower_ascii(text), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACES))
    return lines.select("doc_id", "text_hash", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``nth``: which document of its key, in descending id order, an occurrence stands in; ``of``: how many there are."""
    w = Window.partitionBy(*keys)
    return (rows.withColumn("nth", F.dense_rank().over(w.orderBy(F.col("doc_id").desc_nulls_last())))
            .withColumn("of", F.max("nth").over(w)))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash, pos of the lines to drop: keys found in ``min_docs`` documents or more stay only in the last."""
    spark = docs.sparkSession
    occ = written(occurrences(docs, min_chars)).withColumn("cell", F.pmod("h1", F.lit(CELLS)))
    cells = occ.groupBy("cell").count()
    share = (cells.agg(F.sum("count")).first()[0] or 0) / max(partitions(spark), 1)
    hot = [r["cell"] for r in cells.filter(F.col("count") > max(share / 8, 256)).orderBy("cell").collect()]  # a few for each partition at most
    salts = max(16, partitions(spark) // 4)
    occ = occ.withColumn("salt", F.when(F.col("cell").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(salts)) + 1).otherwise(F.lit(0))).drop("cell")
    laid = occ.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.col("doc_id").desc_nulls_last(), "pos")
    first = _ranked(laid, ["h1", "h2", "salt"])
    sure = (F.col("of") >= min_docs) & (F.col("nth") >= 2) & ((F.col("salt") == 0) | (F.col("nth") >= min_docs))
    open_ = (F.col("salt") > 0) & (F.col("nth") < min_docs)
    seen = written(first.filter(sure | open_).withColumn("sure", sure & ~open_))
    again = _ranked(seen.filter(~F.col("sure")).withColumnRenamed("of", "of_salt").drop("nth"), ["h1", "h2"])
    again = again.withColumn("of", F.greatest("of", F.max("of_salt").over(Window.partitionBy("h1", "h2"))))
    late = again.filter((F.col("of") >= min_docs) & (F.col("nth") >= 2))
    return seen.filter("sure").select("doc_id", "text_hash", "pos").unionByName(late.select("doc_id", "text_hash", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_hash, n_dropped and keep: the runs [first, last] of line positions that stay (the last run is
    open), for every document that loses a line; a document without a row keeps all of its lines."""
    drops = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    n = F.size("p")
    begins = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == n - 1) | (F.get("p", i + 1) != x + 1))
    runs = drops.select("doc_id", "text_hash", n.cast("long").alias("n_dropped"), begins.alias("begins"), ends.alias("ends"))
    firsts = F.concat(F.array(F.lit(0)), F.transform("ends", lambda x: x + 1))
    lasts = F.concat(F.transform("begins", lambda x: x - 1), F.array(F.lit(LAST)))
    keep = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return runs.select("doc_id", "text_hash", "n_dropped", F.filter(keep, lambda r: r["first"] <= r["last"]).alias("keep"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row of ``docs``: row (the row itself, as a struct), n_lines, n_dropped and kept, its text without the
    dropped lines."""
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), F.col("n_dropped").alias("b_dropped"), "keep")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("hash", F.xxhash64("t")).join(b, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")), "left")
    lines = F.split("t", "\n")
    kept = F.flatten(F.transform("keep", lambda r: F.slice(
        lines, r["first"] + 1, F.least(r["last"], F.size(lines) - 1) - r["first"] + 1)))
    return rows.select("row", (F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                       F.coalesce("b_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("keep").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and kept (its text without the dropped lines)."""
    own = docs.select("doc_id", "text")
    return apply_keep(own, keep_bitmaps(own, min_chars, min_docs)).select("row.doc_id", "n_lines", "n_dropped", "kept")

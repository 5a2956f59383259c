"""Operator 13: how five text filters interact, in every order that they could be applied in.

1. Each document's failures become a five-bit mask: A few words, B repeated words, C capitals, D special characters,
   E a text that a smaller doc_id has too.
2. Documents, good ones and toxic ones are counted per part (source) and mask in Spark: 32 cells a part at most.
3. A part's cells are reshaped into a 2 x 2 x 2 x 2 x 2 tensor, one axis a filter (0 pass, 1 fail). For every order and
   step a selection vector on each axis (pass, fail or all) is contracted with it by one einsum.

Only 32 cells a part leave Spark's aggregation, so the contraction costs the same however many documents there are;
parts are dealt over tasks. Equal texts are found by SHA-256; copies are counted
together before their smallest doc_id is joined to them, so a text of very many copies is a few rows there.

Defined results: null texts are empty, null sources the part ''; a null doc_id neither fails E nor makes another
fail; rows that share a doc_id count each, and none of them is a copy of another; of a document's several labels any 1
counts; unlabelled documents and those of a null doc_id are neither good nor toxic; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.common import UPPER, written

FILTERS = "ABCDE"
BIT = {f: 1 << (len(FILTERS) - 1 - i) for i, f in enumerate(FILTERS)}  # A on the tensor's first axis
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, special: str = "#$%&*|") -> Column:
    """Bits of the filters A to D that a text without nulls fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    marks = F.char_length(text) - F.char_length(F.translate(text, special, ""))
    fails = {"A": n < min_words, "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * n,
             "C": 100 * capitals > capital_percent * F.char_length(text), "D": marks > 0}
    return sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents counted. Copies of a text are counted before the smallest doc_id of
    their text is joined to them, so that join meets a row for each text, part and label."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("source", F.lit("")).alias("part"),
                      text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = own.groupBy("doc", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")
    own = own.join(marked, F.col("doc") == F.col("id"), "left")
    own = own.groupBy("part", "mask", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.isnull("doc").alias("nameless"))
    own = written(own.agg(F.sum("n").alias("n"), F.min(F.struct("doc", "n")).alias("least")))
    first = own.groupBy(F.col("digest").alias("d")).agg(F.min("least.doc").alias("first"))
    own = own.join(first, F.col("digest") == F.col("d"))
    originals = F.when(F.col("nameless"), F.col("n")).when(F.col("least.doc") == F.col("first"), F.col("least.n")).otherwise(0)
    cells = F.explode(F.array(F.struct("mask", originals.alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - originals).alias("n"))))
    return own.select("part", "good", "toxic", cells.alias("c")).select("part", "c.mask", "good", "toxic", "c.n").filter("n > 0")


def selections() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of every row, and for each kind of count a (row, axis, 2) array of selection vectors."""
    rows, chosen = [], {k: [] for k in ("kept", "removed", "failing", "unique")}
    for order in permutations(FILTERS):
        for step, own in enumerate(order):
            rows.append(("".join(order), step + 1))
            before = set(order[:step])
            chosen["kept"].append([PASS if f in before or f == own else ALL for f in FILTERS])
            chosen["removed"].append([FAIL if f == own else PASS if f in before else ALL for f in FILTERS])
            chosen["failing"].append([FAIL if f == own else ALL for f in FILTERS])
            chosen["unique"].append([FAIL if f == own else PASS for f in FILTERS])
    return rows, {k: np.array(v, np.int64) for k, v in chosen.items()}


def contracted(cells: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(row, part, count): the tensors ``cells`` (part, count, A, B, C, D, E) under each row's selection vectors."""
    return np.einsum("pmabcde,za,zb,zc,zd,ze->zpm", cells, *np.moveaxis(chosen, 1, 0))


def audit(masks: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts from rows of part, mask, good, toxic, n."""
    rows, chosen = selections()
    owns = np.array([order[step - 1] for order, step in rows])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                cells = np.zeros((b.num_rows, 3, 32), np.int64)
                for p, part in enumerate(b.column(1).to_pylist()):
                    for c in part:
                        cells[p, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                cells = cells.reshape(b.num_rows, 3, 2, 2, 2, 2, 2)
                removed = contracted(cells, chosen["removed"])
                out = {"kept": contracted(cells[:, :1], chosen["kept"])[..., 0], "removed": removed[..., 0],
                       "unique_fails": contracted(cells[:, :1], chosen["unique"])[..., 0], "good_lost": removed[..., 1], "toxic_lost": removed[..., 2]}
                out["redundant"] = contracted(cells[:, :1], chosen["failing"])[..., 0] - out["removed"]
                out["shapley"] = np.empty_like(out["removed"])
                for f in FILTERS:
                    out["shapley"][owns == f] = out["removed"][owns == f].sum(axis=0)
                for p, part in enumerate(b.column(0).to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows)), pa.array([o for o, _ in rows]), pa.array([s for _, s in rows], pa.int32()), *(pa.array(out[m][:, p]) for m in MEASURES)],
                        names=["part", "filter_order", "step", *MEASURES])

    cells = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("good * n")).alias("good"), F.sum(F.expr("toxic * n")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 a part at most
    return parts.mapInArrow(tables, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction audit of the five filters over ``docs``, per part, order and step."""
    return audit(failure_masks(docs, labels))

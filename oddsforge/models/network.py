"""M7–M9 — a small dense network as content scorer, trained by gradients that Spark sums.

Two towers: relu layers turn a user's profile into a vector u and an item's features into a vector v, and the score is
u·v plus one output of either tower. It learns interactions across dimensions that a linear scorer cannot
have, and because the score is an inner product, every user's list is an exact search (M9), not a pass over all pairs.

Training rows are written once, divided into batches by a hash. A step reads one batch; every task adds up the gradient
of its rows, a tree of groups adds these up, and the driver takes an Adam step on the sum: what travels is one
vector of the parameters' size for each task, whatever the number of rows. Inputs are scaled by their mean and population
deviation (0 -> 1), which the same tree adds up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsforge.config import ModelConfig
from oddsforge.models.inner_product import TopItems, top_inner_products
from oddsforge.models.mf import dot
from oddsforge.session import cut_lineage

FAN = 16                 # vectors that one task of the tree adds up
BATCH_ROWS = 1 << 18     # rows of a step's batch
ROWS = 4096              # rows that a task multiplies at once


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of ``work``'s vectors over the partitions of ``rows``, added up by a tree of fan-in FAN."""
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = work(batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([vector.tobytes()], pa.binary())], names=["part", "vector"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in parts.column("vector")], axis=0)
        return pa.table({"part": pa.array([parts.column("part")[0].as_py()], pa.int32()), "vector": pa.array([total.tobytes()], pa.binary())})

    n = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(leaf, "part int, vector binary")
    while n > FAN:
        n = -(-n // FAN)
        out = out.groupBy(F.pmod("part", F.lit(n)).alias("node")).applyInArrow(add, "part int, vector binary")
    return np.sum([np.frombuffer(r["vector"]) for r in out.select("vector").collect()], axis=0)  # FAN vectors at most


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([x.values.to_numpy(zero_copy_only=False) for x in column]).astype(float)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


@dataclass
class Towers:
    """Shapes of the parameters, which live in one flat vector; ``u`` and ``i`` are the two towers."""

    dims: dict[str, int]
    hidden: int
    width: int

    def shapes(self) -> list[tuple[int, ...]]:
        return [s for t in "ui" for s in ((self.dims[t], self.hidden), (self.hidden,), (self.hidden, self.width + 1), (self.width + 1,))]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes()])

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        shapes = self.shapes()
        return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)]

    @staticmethod
    def tower(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and output of one tower; the output's last column stands alone in the score."""
        h = np.maximum(x @ w[0] + w[1], 0)
        return h, h @ w[2] + w[3]

    def gradient(self, flat: np.ndarray, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient and value of the summed squared error of some rows."""
        w = self.split(flat)
        own = {"u": w[:4], "i": w[4:]}
        h, out = {}, {}
        for t in "ui":
            h[t], out[t] = self.tower(x[t], own[t])
        error = (out["u"][:, :-1] * out["i"][:, :-1]).sum(axis=1) + out["u"][:, -1] + out["i"][:, -1] - y
        grads = []
        for t, other in (("u", "i"), ("i", "u")):
            d = 2 * error[:, None] * np.column_stack([out[other][:, :-1], np.ones(len(y))])
            back = (d @ own[t][2].T) * (h[t] > 0)
            grads += [x[t].T @ back, back.sum(axis=0), h[t].T @ d, d.sum(axis=0)]
        return np.concatenate([g.ravel() for g in grads]), float((error**2).sum())


@dataclass
class NetworkModel:
    towers: Towers
    flat: np.ndarray
    scales: dict[str, tuple[np.ndarray, np.ndarray]]
    offset: float = 0.0
    losses: list[float] = field(default_factory=list)   # mean squared error of each step's batch, before the step

    def vectors(self, df: DataFrame, tower: str, id_col: str, vec_col: str) -> DataFrame:
        """(id, vec): what the tower makes of each row, laid out so that user . item is the score without the offset."""
        w = self.towers.split(self.flat)[:4] if tower == "u" else self.towers.split(self.flat)[4:]
        mean, deviation = self.scales[tower]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                if b.num_rows:
                    out = Towers.tower((matrix(b.column(1)) - mean) / deviation, w)[1]
                    one, alone = np.ones(len(out)), out[:, -1]
                    both = np.column_stack([out[:, :-1], *((alone, one) if tower == "u" else (one, alone))])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(both), pa.list_(pa.float64()))], names=["id", "vec"])

        known = df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
        return known.mapInArrow(rows, "id long, vec array<double>").select(F.col("id").alias(id_col), "vec")


def fit(pairs: DataFrame, hidden: int = ModelConfig.network_hidden, width: int = ModelConfig.network_width, steps: int = ModelConfig.network_steps,
        rate: float = 0.02, l2: float = 1e-4, batch_rows: int = BATCH_ROWS, seed: int = 42) -> NetworkModel:
    """M7: the network fitted on ``pairs`` (profile array, item array, rating) in ``steps`` steps of one batch each."""
    pairs = cut_lineage(pairs.select(F.col("profile").cast("array<double>"), F.col("item").cast("array<double>"), F.col("rating").cast("double"))
                        .filter("profile is not null and item is not null and rating is not null"))
    size = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), F.max(F.size("profile")).alias("u"), F.max(F.size("item")).alias("i")).first()
    if not size["n"]:
        raise ValueError("no rated pairs to learn from")
    dims, offset = {"u": size["u"], "i": size["i"]}, size["mean"]

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * (dims["u"] + dims["i"]))
        for b in chunks(batches):
            if b.num_rows:
                x = np.column_stack([matrix(b.column(0)), matrix(b.column(1))])
                total += np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)])
        return total

    first, second = np.split(summed(pairs, moments) / size["n"], 2)
    deviation = np.sqrt(np.maximum(second - first**2, 0))
    deviation[deviation < 1e-12] = 1.0
    scales = {"u": (first[: dims["u"]], deviation[: dims["u"]]), "i": (first[dims["u"] :], deviation[dims["u"] :])}
    n_batches = -(-size["n"] // batch_rows)
    table = cut_lineage(pairs.withColumn("batch", F.pmod(F.xxhash64("profile", "item", "rating"), F.lit(n_batches)).cast("int")), partition_by=["batch"])
    towers = Towers(dims, hidden, width)
    flat = towers.start(seed)
    model = NetworkModel(towers, flat, scales, offset)
    m = v = np.zeros_like(flat)
    for step in range(steps):
        shared = pairs.sparkSession.sparkContext.broadcast(flat)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            total = np.zeros(len(shared.value) + 2)
            for b in chunks(batches):
                if b.num_rows:
                    x = {t: (matrix(b.column(j)) - scales[t][0]) / scales[t][1] for j, t in enumerate("ui")}
                    g, loss = towers.gradient(shared.value, x, b.column(2).to_numpy() - offset)
                    total += np.concatenate([g, [loss, b.num_rows]])
            return total

        total = summed(table.filter(F.col("batch") == step % n_batches).select("profile", "item", "rating"), work)
        shared.destroy()
        n = max(total[-1], 1)
        model.losses.append(total[-2] / n)
        g = total[:-2] / n + l2 * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        flat = flat - rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    model.flat = flat
    return model


def score_pairs(model: NetworkModel, pairs: DataFrame, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """M8: ``pairs`` (user_id, item_id) with ``prediction``; 0.0 where user or item is unknown. Each tower runs once
    for a user or item; a pair costs one inner product."""
    u = model.vectors(profiles, "u", "user_id", "profile").select(F.col("user_id").alias("_u"), F.col("vec").alias("_uv"))
    i = model.vectors(items, "i", "item_id", "item").select(F.col("item_id").alias("_i"), F.col("vec").alias("_iv"))
    both = pairs.join(u, F.col("user_id") == F.col("_u"), "left").join(i, F.col("item_id") == F.col("_i"), "left")
    known = F.col("_uv").isNotNull() & F.col("_iv").isNotNull()
    return both.withColumn("prediction", F.when(known, dot("_uv", "_iv") + F.lit(model.offset)).otherwise(F.lit(0.0))).drop("_u", "_uv", "_i", "_iv")


def recommend_all(model: NetworkModel, profiles: DataFrame, items: DataFrame, n: int = 10) -> TopItems:
    """M9: every user's n best items under the network, exactly."""
    top = top_inner_products(model.vectors(profiles, "u", "user_id", "profile"), model.vectors(items, "i", "item_id", "item"), n)
    return TopItems(top.table.withColumn("score", F.col("score") + F.lit(model.offset)), top.compared, top.pairs, top.rounds)

"""Operator 10: MinHash near-dedup with odd sketches.

1. Each text's set of word shingles gives 128 MinHash samples. Bands of four samples make 32 bucket keys; all
   samples folded into a 512-bit parity bitmap make its odd sketch.
2. Documents of equal sets form classes; only a class's smallest doc_id goes on.
3. Documents in one bucket are candidates. XOR population counts of their sketches estimate the similarity;
   pairs estimated under 0.6, five deviations below 0.8, or whose set sizes rule out 0.8, go no further.
4. The rest is verified on the full sets: 100 * intersection >= 80 * union.
5. Connected components over the links give every document the smallest doc_id it reaches.

No bucket is expanded into all its pairs at once. Each member is first compared with its bucket's smallest
document; components are merged. Then only members of buckets that still hold different components are
compared: pair by pair in buckets of 32 members at most, and block by block (1024 x 1024) in larger ones, where a
task verifies what the sketches let through on the full sets by a matrix product and returns no more links than
join its components. So all links that the bands find (at similarity 0.8 all but 5 in 10^8) decide the
components, and links inside one component need no test.

Words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle.
Defined results: null and empty texts have no shingles and stand alone; rows that share a doc_id are one
document, linked with whatever any of them is linked with; a null doc_id stands alone with a null component and is
kept; an empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.common import written

SAMPLES, ROWS, BITS = 128, 4, 512
BANDS = SAMPLES // ROWS
SMALL = 32         # members of a bucket whose pairs are joined as they are
BLOCK = 1024       # members of a larger bucket that one task compares with as many others,
BLOCK_SHINGLES = 1 << 19  # or as many as have so many shingles together
COLUMNS = 4096     # shingles in one product of the blocks' 0/1 matrices
SLACK = 0.2        # how far under the asked similarity an estimate may lie: five deviations
U = np.uint64
ROW_BATCH = 256  # rows that a task turns into output at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (``bytes`` lower-cases and splits ASCII only)."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U, len(ws))
    n = min(k, len(h))
    out = h[: len(h) - n + 1] + U(n)
    for j in range(1, n):
        out = mixed(out) + h[j : len(h) - n + 1 + j]
    return np.unique(mixed(out))


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20).integers(0, 2**63, (2, SAMPLES, 1), dtype=np.int64).astype(U)
    return draw[0] * U(2) + U(1), draw[1] * U(2)


FAMILY = _hash_family()


def minhashes(s: np.ndarray) -> np.ndarray:
    a, b = FAMILY
    out = np.full(SAMPLES, np.iinfo(U).max, U)
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[None, i : i + 4096] * a + b).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mixed(key + rows[:, j])
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> bytes:
    """Parity bitmap: each sample, tagged with its number, flips one of the bits."""
    place = mixed(m + np.arange(SAMPLES, dtype=U) * U(0xD6E8FEB86659FD93)) >> U(64 - int(math.log2(BITS)))
    return np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def estimated(flipped: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    left = np.maximum(1 - 2 * np.asarray(flipped, float) / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(left)


def most_flipped(similarity: float) -> int:
    """Flipped bits up to which ``estimated`` is ``similarity`` or more."""
    return int(np.count_nonzero(estimated(np.arange(BITS // 2)) >= similarity) - 1)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp (128 bits of the whole set; null without shingles), bands, sketch."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROW_BATCH):
                b = whole.slice(i, ROW_BATCH)
                n, fp, bands, sketch = [], [], [], []
                for text in b.column(2).to_pylist():
                    s = shingle_set(text, k)
                    n.append(len(s))
                    if len(s):
                        m = minhashes(s)
                        fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                        bands.append(band_keys(m))
                        sketch.append(odd_sketch(m))
                    else:
                        fp.append(None), bands.append(None), sketch.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "fp", "bands", "sketch"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(rows, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of the (a, b) edges: turns of large star and small
    star, each written, until nothing changes. A star's minimum is pre-aggregated; hot stars join with skew splitting."""
    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, F.col("a") == F.col("u"))

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = star(large)
        e = written(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return (e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose full shingle sets are similar enough."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, U))
        for whole in batches:
            for i in range(0, whole.num_rows, ROW_BATCH):
                t = whole.slice(i, ROW_BATCH)
                a, b = t.column(0).to_pylist(), t.column(1).to_pylist()
                good = []
                for x, y, tx, ty in zip(a, b, t.column(2), t.column(3), strict=True):
                    if last[0] != x:
                        last = x, shingle_set(tx.as_py(), k)
                    s = shingle_set(ty.as_py(), k)
                    both = len(np.intersect1d(last[1], s, assume_unique=True))
                    if 100 * both >= percent * (len(last[1]) + len(s) - both):
                        good.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in good], pa.int64()), pa.array([p[1] for p in good], pa.int64())], names=["a", "b"])

    t = lambda c: texts.select(F.col("id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text"))
    full = pairs.join(t("b"), F.col("b") == F.col("b_id")).join(t("a"), F.col("a") == F.col("a_id"))
    return written(full.select("a", "b", "a_text", "b_text").mapInArrow(rows, "a long, b long"))


def unresolved(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, band, n, id, label of the members of buckets that still hold several components."""
    labels = components(links)
    m = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "band", "n", "id", F.coalesce("component", "id").alias("label"))
    m = written(m)
    several = m.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "band")
    return written(m.join(several, ["key", "band"]))


def small_bucket_pairs(open_members: DataFrame) -> DataFrame:
    """Every (a, b) of different components in buckets of SMALL members at most."""
    a = open_members.filter(F.col("n") <= SMALL)
    b = a.select("key", "band", F.col("id").alias("id_b"), F.col("label").alias("label_b"))
    return a.join(b, ["key", "band"]).filter("id < id_b and label <> label_b").select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set: only hashes on both sides count, and each run of
    COLUMNS of them is one product of two 0/1 matrices."""
    here = [np.concatenate(x) for x in (left, right)]
    shared = np.intersect1d(*here)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    at = [np.searchsorted(shared, h) for h in here]
    ok = [(np.append(shared, U(0))[i] == h) & (i < len(shared)) for i, h in zip(at, here, strict=True)]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), COLUMNS):
        m = []
        for side, x in enumerate((left, right)):
            mine = ok[side] & (at[side] >= c) & (at[side] < c + COLUMNS)
            one = np.zeros((len(x), COLUMNS), np.float32)
            one[rows[side][mine], at[side][mine] - c] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def large_bucket_links(open_members: DataFrame, shape: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different components in the other buckets. Members meet block by block: sketches let pairs
    through, these are verified on the full sets, and each task returns no more links than join its components. Members
    of a bucket's largest component meet the other members only; a pair is tested in the first band that it shares."""
    flips = most_flipped(percent / 100 - SLACK)

    def links(key, rows: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key[1], key[2], key[3]
        sides = [rows[rows["block"] == x].sort_values("id") for x in (i, j)]
        (ia, la, na), (ib, lb, nb) = [(x["id"].to_numpy(), x["label"].to_numpy(), x["n_shingles"].to_numpy()) for x in sides]
        bits = [np.frombuffer(b"".join(x["sketch"]), U).reshape(len(x), -1) for x in sides]
        bands = [np.array(x["bands"].to_list(), np.int64).reshape(len(x), -1) for x in sides]
        flipped = np.zeros((len(ia), len(ib)), np.int32)
        for w in range(BITS // 64):
            flipped += np.bitwise_count(bits[0][:, w, None] ^ bits[1][None, :, w])
        fits = (flipped <= flips) & (la[:, None] != lb[None])
        fits &= 100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None])
        if i == j:
            fits &= ia[:, None] < ib[None]
        for w in range(band):
            fits &= bands[0][:, w, None] != bands[1][None, :, w]
        out: list[tuple[int, int]] = []
        x, y = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if len(x):
            sets = [[shingle_set(t, k) for t in side["text"].iloc[keep]] for side, keep in zip(sides, (x, y), strict=True)]
            both = common_counts(*sets)
            linked = fits[np.ix_(x, y)] & (100 * both >= percent * (na[x][:, None] + nb[y][None] - both))
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for r in np.flatnonzero(linked.any(axis=1)):
                partner = y[linked[r]]
                for c in partner[np.unique(lb[partner], return_index=True)[1]]:
                    p, q = find(int(la[x[r]])), find(int(lb[c]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((int(ia[x[r]]), int(ib[c])))
        return pd.DataFrame({"a": [min(e) for e in out], "b": [max(e) for e in out]}, dtype="int64")

    m = open_members.filter(F.col("n") > SMALL).join(shape, "id")
    counts = m.groupBy("key", "band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(F.col(c) / BLOCK, F.col(s) / BLOCK_SHINGLES)).cast("int")
    main = counts.groupBy("key", "band").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "label")).alias("top"))
    main = main.select("key", "band", F.col("top.label").alias("top"), F.col("top.c").alias("tc"), F.col("top.s").alias("ts"),
                       (F.col("c") - F.col("top.c")).alias("rc"), (F.col("s") - F.col("top.s")).alias("rs"))
    main = main.select("key", "band", "top", blocks("tc", "ts").alias("n_top"), blocks("rc", "rs").alias("n_rest"))
    m = m.join(main, ["key", "band"])
    h, in_top = F.xxhash64("id"), F.col("label") == F.col("top")
    block = F.when(in_top, F.col("n_rest") + F.pmod(h, F.col("n_top"))).otherwise(F.pmod(h, F.col("n_rest"))).cast("int")
    others = F.sequence(F.lit(0), F.col("n_rest") - 1 + F.when(in_top, 0).otherwise(F.col("n_top")))
    m = m.withColumn("block", block).withColumn("other", F.explode(others))
    m = m.join(texts.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"))
    m = m.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "n_shingles", "sketch", "bands", "text")
    return written(m.groupBy("key", "band", "i", "j").applyInPandas(links, "a long, b long"))


def likely(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that sketches and set sizes let through."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            bits = [np.frombuffer(b"".join(t.column(c).to_pylist()), U).reshape(t.num_rows, -1) for c in (4, 5)]
            est = estimated(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1))
            na, nb = t.column(2).to_numpy(), t.column(3).to_numpy()
            good = (est >= percent / 100 - SLACK) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(good)), t.column(1).filter(pa.array(good))], names=["a", "b"])

    of = lambda c: shape.select(F.col("id").alias(f"{c}_id"), F.col("n_shingles").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    full = pairs.join(of("b"), F.col("b") == F.col("b_id")).join(of("a"), F.col("a") == F.col("a_id"))
    return written(full.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(rows, "a long, b long"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept."""
    sig = written(signatures(docs, k))
    reps = (sig.filter("fp is not null and doc_id is not null").groupBy("fp")
            .agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch")).alias("r"))
            .select("fp", F.col("r.doc_id").alias("id"), "r.text_hash", "r.n_shingles", "r.bands", "r.sketch"))
    reps = written(reps)
    keyed = reps.select("id", "text_hash", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).filter("n > 1")
    members = written(keyed.join(buckets, ["key", "band"]))
    ids = members.select("id", "text_hash").distinct()
    mine = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text")
    texts = written(mine.join(ids, (F.col("doc") == F.col("id")) & (F.col("hash") == F.col("text_hash"))).select("id", "text").dropDuplicates(["id", "text"]))
    shape = reps.select("id", "n_shingles", "sketch", "bands")

    # rows of one doc_id that stand in several classes tie these together
    row_class = sig.filter("doc_id is not null").join(reps.select("fp", "id"), "fp").select("doc_id", "id")
    tied = row_class.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z")
    ties = row_class.join(tied.select(F.col("doc_id").alias("_d"), "a"), F.col("doc_id") == F.col("_d")).select("a", F.col("id").alias("b")).filter("a <> b")
    stars = members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(likely(stars, shape, percent), texts, k, percent).unionByName(ties.distinct()))
    left = unresolved(members, links)
    links = written(links.unionByName(verified(likely(small_bucket_pairs(left), shape, percent), texts, k, percent)))
    links = written(links.unionByName(large_bucket_links(unresolved(members, links), shape, texts, k, percent)))
    labels = components(links)
    out = sig.join(reps.select(F.col("fp").alias("_fp"), "id"), F.col("fp") == F.col("_fp"), "left")
    out = out.join(labels, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, one for each id and text."""
    kept = groups.filter("kept").groupBy(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).agg(F.count(F.lit(1)).alias("g_rows"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_hash")))
    single = (F.col("g_rows") == 1) | F.col("id").isNull()
    return rows.filter(single).unionByName(rows.filter(~single).dropDuplicates(["id", "hash"])).select("row.*")

"""Operator 11: n-gram Jaccard join by T-occurrence search.

1. Each text's set is its distinct word shingles. Documents of equal sets form classes; a class's smallest doc_id goes on.
2. Sets that may meet are dealt to the same tasks by exact keys, not by chance: sets of similar size are cut by a hash
   of the shingle into more parts than the shingles in which two linked sets can differ, so at least one part is
   equal; the hash of each part's shingles is a key. (Where too many parts are empty for that argument, a set gives the keys
   of further hash functions until one has enough, and so does any set it could be linked with.)
3. In a task the sets form inverted lists. For a query set of n shingles a partner stands in at least T = ceil(0.85 n) of its
   lists, in more where all sets at hand are larger. The L longest lists are put aside; the short rest is merged by a heap;
   what occurs T - L times is looked for in the long lists by binary search, until the overlap that its own size asks for
   (100 * intersection >= 85 * union) is reached or out of reach (DivideSkip).
4. Connected components over the links give every document the smallest doc_id it reaches.

Each key's smallest member is searched against the key's other members, in blocks of BLOCK sets at most; components are
merged. Only members of keys that still hold several components are compared further: pair by pair in keys of
SMALL members at most, block by block in larger ones, where members of the largest component meet the others only; what
these links join is merged once more. So every link between different sets decides the components, and links inside one component need no search.

Words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle.
Defined results: null and empty texts have no shingles and stand alone; rows that share a doc_id are one document, linked
with whatever any of them is linked with; a null doc_id stands alone with a null component; an empty table gives no
rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.common import written
from oddsforge.llm.near_dedup import common_counts, components, mixed, shingle_set
from oddsforge.session import release

SMALL = 32                # members of a key that are compared pair by pair
BLOCK = 1024              # sets of one block,
BLOCK_SHINGLES = 1 << 19  # or as many as have so many shingles together
LIST_COST = 0.01          # share of a list's logarithmic probing cost in the choice of L
SHORT = 2048              # entries that are merged one by one
PROBES = 1 << 20          # binary searches done at once
SCAN = 16                 # entries read through in the time of one binary search
MAP_BITS = 26             # of the map of ids that go on to the search
ROW_BATCH = 256
U = np.uint64


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """Number of the class of sets of n shingles, its largest size, and that of the class below (0: none). A
    linked set is in the same class or in a neighbouring one."""
    c, low, below = 0, 1, 0
    while n > 100 * low // percent:
        below = 100 * low // percent
        c, low = c + 1, below + 1
    return c, 100 * low // percent, below


def tag_of(scheme: int, seed: int) -> np.uint64:
    return U(((scheme << 8 | seed) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def part_keys(s: np.ndarray, scheme: int, largest: int, percent: int) -> list[np.ndarray]:
    """Keys of a set under the scheme of the pairs whose smaller set has ``largest`` shingles at most."""
    differ = (100 - percent) * largest // percent  # shingles that stand in one of two linked sets
    if not differ:
        return []  # only equal sets
    parts = differ + 2 + differ // 16
    out: list[np.ndarray] = []
    for seed in range(64):
        tag = tag_of(scheme, seed)
        x = np.sort(mixed(s + tag))  # in order of their parts
        at = (x >> U(32)) * U(parts) >> U(32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append(mixed(mixed(np.add.reduceat(mixed(x), first) + tag) + at[first]))
        if len(first) > differ:  # of these parts one at least is equal in any linked set
            return out
    raise ValueError("no hash function spreads the set over enough parts")


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """All keys of a set: as the smaller or equal one of a pair, and as the larger one."""
    c, largest, below = size_class(len(s), percent)
    keys = part_keys(s, c, largest, percent) + (part_keys(s, c - 1, below, percent) if below else [])
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, U)


def keys_of_all(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``keys_of`` of many sets: number of the set and key. The first hash function of either scheme is computed over all
    shingles at once; the few sets that it spreads badly are done one by one."""
    classes = [size_class(len(s), percent) for s in sets]
    out = []
    for schemes in ([(c, largest) for c, largest, _ in classes], [(c - 1, below) for c, _, below in classes]):
        differ = np.array([(100 - percent) * largest // percent for _, largest in schemes], np.int64)
        some = np.flatnonzero((differ > 0) & np.array([len(s) > 0 for s in sets], bool))
        if not len(some):
            continue
        tags = np.array([tag_of(c, 0) if c >= 0 else U(0) for c, _ in schemes], U)
        own = np.repeat(some, [len(sets[i]) for i in some])
        x = mixed(np.concatenate([sets[i] for i in some]) + tags[own])
        parts = differ + 2 + differ // 16
        at = ((x >> U(32)) * parts[own].astype(U) >> U(32)).astype(np.int64)
        place = own * int(parts.max()) + at
        order = np.argsort(place)
        first = np.flatnonzero(np.append(True, place[order[1:]] != place[order[:-1]]))
        doc, part = own[order[first]], at[order[first]].astype(U)
        key = mixed(mixed(np.add.reduceat(mixed(x)[order], first) + tags[doc]) + part)
        badly = np.bincount(doc, minlength=len(sets)) <= differ
        good = ~badly[doc]
        out.append((doc[good], key[good]))
        for i in some[badly[some]]:
            more = np.concatenate(part_keys(sets[i], *schemes[i], percent))
            out.append((np.full(len(more), i), more))
    if not out:
        return np.empty(0, np.int64), np.empty(0, U)
    doc, key = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order]


def keys_column(sets: list[np.ndarray], percent: int) -> pa.Array:
    doc, key = keys_of_all(sets, percent)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(sets) + 1)), pa.int32()), pa.array(key.view(np.int64)))


def shingle_rows(docs: DataFrame, k: int, field: str, more: Callable[[list[np.ndarray]], pa.Array], wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id, size, fp (128 bits of the set; null without shingles) and the ``field`` that ``more`` makes of some sets;
    with a map ``wanted`` only of ids whose bit is set there."""
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROW_BATCH):
                b = whole.slice(i, ROW_BATCH)
                if shared is not None:
                    b = b.filter(pa.array(set_in(shared.value, b.column(2).to_numpy())))
                sets = [shingle_set(text.as_py(), k) for text in b.column(1)]
                fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), more(sets)],
                                                 names=["doc_id", "size", "fp", field.split()[0]])

    doc = F.col("doc_id").cast("long")
    return docs.select(doc, "text", F.xxhash64(doc)).mapInArrow(rows, f"doc_id long, size long, fp binary, {field}")


def map_of(hashes: DataFrame) -> np.ndarray:
    """A map of fixed size (8 MB) with the bits of the column ``h`` set: it keeps most other rows out of a join."""
    place = F.col("h").bitwiseAND((1 << MAP_BITS) - 1)
    cells = hashes.groupBy(F.shiftright(place, 15).alias("cell")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in cells.toLocalIterator():  # 2**(MAP_BITS - 15) rows of 4 KB at most, whatever the corpus
        out[r["cell"] << 12 : (r["cell"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & ((1 << MAP_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def mapped_keys(classes: DataFrame, bits: np.ndarray) -> DataFrame:
    """id, size, fp, key of the classes' keys whose bit is set."""
    shared = classes.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            some = np.flatnonzero(set_in(shared.value, keys))
            own = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([b.column(i).take(own) for i in range(3)] + [pa.array(keys[some])], names=["id", "size", "fp", "key"])

    return classes.select("id", "size", "fp", "keys").mapInArrow(rows, "id long, size long, fp binary, key long")


class InvertedLists:
    """The inverted lists of a block of sets: ``lists`` holds (shingle number, set number) in order, as one number."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(every, kind="stable")
        self.shingles, first = np.unique(every[order], return_index=True)
        self.begin = np.append(first, len(every))
        self.owners = owner[order]
        self.lists = np.repeat(np.arange(len(self.shingles)), np.diff(self.begin)) * self.n + self.owners

    def search(self, query: np.ndarray, percent: int, label: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the sets that are similar enough to the query, by DivideSkip. With ``label`` one set of each label is
        enough, and a negative label keeps a set out."""
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        least = max(int(self.sizes.min()), -(-percent * len(query) // 100))  # size of the smallest possible partner
        need = self._needed(len(query), least, percent)  # T
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.begin[at + 1] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        n_long = min(need - 1, int(need / (LIST_COST * math.log2(max(2, int(length.max()))) + 1)))  # L
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found, count = self._merged(short, need - n_long)
        if label is None:
            return self._probed(long, found, count, len(query), percent)
        known = label[found] >= 0
        found, count = found[known], count[known]
        out, some = [np.empty(0, np.int64)], 2
        while len(found):  # the likeliest first; what is linked already needs no further set of its label
            order = np.argsort(-count, kind="stable")
            now = order[:some]
            hit = self._probed(long, found[now], count[now], len(query), percent)
            hit = hit[np.unique(label[hit], return_index=True)[1]]
            out.append(hit)
            rest = order[some:]
            rest = rest[~np.isin(label[found[rest]], label[hit])]
            found, count, some = found[rest], count[rest], 4 * some
        return np.concatenate(out)

    @staticmethod
    def _needed(size: int, other, percent: int):
        """Least overlap of linked sets of these sizes."""
        return -(-percent * (size + other) // (100 + percent))

    def _probed(self, long: np.ndarray, found: np.ndarray, count: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Those of the found sets that reach their needed overlap with the long lists: looked for in these by binary search, or
        where that is more work than reading the lists through, counted from them."""
        need = self._needed(size, self.sizes[found], percent)
        found, count, need = (x[count + len(long) >= need] for x in (found, count, need))
        if len(found) * len(long) * SCAN > (self.begin[long + 1] - self.begin[long]).sum():
            runs = [self.owners[self.begin[t] : self.begin[t + 1]] for t in long.tolist()]
            count = count + np.bincount(np.concatenate(runs), minlength=self.n)[found] if runs else count
            return found[count >= need]
        for i in range(0, len(long), step := max(1, min(len(long) // 8 + 1, PROBES // max(1, len(found))))):
            found, count, need = (x[count + len(long) - i >= need] for x in (found, count, need))
            if not len(found):
                return found
            some = long[i : i + step]
            want = (some[:, None] * self.n + found).ravel()
            place = np.minimum(np.searchsorted(self.lists, want), len(self.lists) - 1)
            count = count + (self.lists[place] == want).reshape(len(some), -1).sum(axis=0)
        return found[count >= need]

    def _merged(self, short: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that stand in ``least`` of the short lists, and in how many. A heap merges a few entries one by one; of more
        it hands out the two shortest runs, whose merge goes back, until one run is left."""
        if (self.begin[short + 1] - self.begin[short]).sum() <= SHORT:
            run = np.array(list(heapq.merge(*(self.owners[self.begin[t] : self.begin[t + 1]].tolist() for t in short.tolist()))), np.int64)
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            n = np.diff(np.append(first, len(run)))
            return run[first][n >= least], n[n >= least]
        heap = [(int(self.begin[t + 1] - self.begin[t]), i, self.owners[self.begin[t] : self.begin[t + 1]], None) for i, t in enumerate(short.tolist())]
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            (_, _, a, na), (_, _, b, nb) = heapq.heappop(heap), heapq.heappop(heap)
            na, nb = (np.ones(len(x), np.int64) if n is None else n for x, n in ((a, na), (b, nb)))
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")  # merges the two runs
            both, n = both[order], np.concatenate([na, nb])[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            both, n = both[first], np.add.reduceat(n, first)
            heapq.heappush(heap, (len(both), serial, both, n))
            serial += 1
        _, _, run, n = heap[0]
        n = np.ones(len(run), np.int64) if n is None else n
        return run[n >= least], n[n >= least]


def links_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})


def sets_in(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles")]


def blocks(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def searched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among the pairs of query a and candidate b: each query is searched in the inverted lists of its
    candidates, block by block; small blocks share a task."""
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("query", "ascending"), ("block", "ascending"), ("asks", "ascending")])
        asks, ids, every = np.array(rows.column("asks")), np.array(rows.column("id")), sets_in(rows)
        whose = np.array(rows.column("query")), np.array(rows.column("block"))
        cut = np.flatnonzero(np.append(True, (whose[0][1:] != whose[0][:-1]) | (whose[1][1:] != whose[1][:-1])))
        out = []
        for i, j in zip(cut, np.append(cut[1:], len(ids)), strict=True):
            held = [x for x in range(i, j) if not asks[x]]
            if held:
                lists = InvertedLists([every[x] for x in held])
                for q in (x for x in range(i, j) if asks[x]):
                    out += [(int(ids[q]), int(ids[held[x]])) for x in lists.search(every[q], percent)]
        return links_table(out)

    size = sets.groupBy(F.col("id").alias("s_id")).agg(F.max("size").alias("s"))
    per = pairs.join(size, F.col("b") == F.col("s_id")).groupBy(F.col("a").alias("q")).agg(blocks(F.count(F.lit(1)), F.sum("s")).alias("n"), F.count(F.lit(1)).alias("c"), F.sum("s").alias("s"))
    per = written(per)
    weight = per.agg(F.sum("c"), F.sum("s")).first()
    bins = 1 + max((weight[0] or 0) // BLOCK, (weight[1] or 0) // BLOCK_SHINGLES)
    own = sets.select("id", "shingles")
    held = pairs.join(per, F.col("a") == F.col("q")).select(F.col("a").alias("query"), F.pmod(F.xxhash64("b"), "n").alias("block"), F.col("b").alias("who"), F.lit(False).alias("asks"))
    asks = per.select(F.col("q").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), F.col("q").alias("who"), F.lit(True).alias("asks"))
    rows = held.unionByName(asks).join(own, F.col("who") == F.col("id")).withColumn("bin", F.pmod(F.xxhash64("query", "block"), F.lit(bins)))
    return written(rows.groupBy("bin").applyInArrow(search, "a long, b long"))


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, n, id, label of the members of keys that still hold several components."""
    m = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "n", "id", F.coalesce("component", "id").alias("label"))
    m = written(m)
    several = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return written(m.join(several, "key"))


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links: components of the components that these join."""
    of = lambda c: labels.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_label"))
    edges = links.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    edges = written(edges.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b").distinct())
    if edges.isEmpty():
        return labels
    joined = written(components(edges))
    old = labels.join(joined.select(F.col("node").alias("j_node"), F.col("component").alias("j_label")), F.col("component") == F.col("j_node"), "left")
    alone = joined.join(labels.select(F.col("node").alias("l_node")), F.col("node") == F.col("l_node"), "left_anti")
    return old.select("node", F.coalesce("j_label", "component").alias("component")).unionByName(alone.select("node", "component"))


def small_pairs(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) of different components and similar sizes in keys of SMALL members at most."""
    a = members.filter(F.col("n") <= SMALL).join(sizes, "id")
    b = a.select("key", F.col("id").alias("b"), F.col("label").alias("b_label"), F.col("size").alias("b_size"))
    both = a.join(b, "key").filter((F.col("id") < F.col("b")) & (F.col("label") != F.col("b_label")) & similar_sizes("size", "b_size", percent))
    return both.select(F.col("id").alias("a"), "b").distinct()


def large_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in the other keys: blocks of a key's largest component meet the blocks of the
    rest, which also meet each other. A pair is searched under the smallest key it shares, and a task returns no
    more links than join its components."""
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        here = key[0].as_py()
        sides = [rows.filter(pc.equal(rows.column("block"), x)) for x in (key[1], key[2])]
        ids, label, size = ([np.array(x.column(c)) for x in sides] for c in ("id", "label", "size"))
        if not len(ids[0]) or not len(ids[1]):
            return links_table([])
        every = [sets_in(x) for x in sides]
        keys = [[(own := keys_of(s, percent))[own.view(np.int64) < here] for s in x] for x in every]
        fits = (label[0][:, None] != label[1][None]) & (100 * np.minimum(size[0][:, None], size[1][None]) >= percent * np.maximum(size[0][:, None], size[1][None]))
        if key[1] == key[2]:
            fits &= ids[0][:, None] < ids[1][None]
        fits &= common_counts(*keys) == 0
        queries = np.flatnonzero(fits.any(axis=1))
        if not len(queries):
            return links_table([])
        lists = InvertedLists(every[1])
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        names, number = np.unique(label[1], return_inverse=True)
        for q in queries:
            mine = find(int(label[0][q]))
            joined = np.array([find(int(v)) == mine for v in names])
            open_labels = np.where(fits[q] & ~joined[number], number, -1)
            if (open_labels < 0).all():
                continue
            for x in lists.search(every[0][q], percent, open_labels):
                p, r = find(int(label[0][q])), find(int(label[1][x]))
                if p != r:
                    root[max(p, r)] = min(p, r)
                    out.append((int(ids[0][q]), int(ids[1][x])))
        return links_table(out)

    m = members.filter(F.col("n") > SMALL).join(sets, "id")
    counts = m.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    main = counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "label")).alias("top"))
    main = main.select("key", F.col("top.label").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("n_top"),
                       blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("n_rest"))
    m = m.join(main, "key")
    h, in_top = F.xxhash64("id"), F.col("label") == F.col("top")
    block = F.when(in_top, F.col("n_rest") + F.pmod(h, F.col("n_top"))).otherwise(F.pmod(h, F.col("n_rest"))).cast("int")
    others = F.sequence(F.lit(0), F.col("n_rest") - 1 + F.when(in_top, 0).otherwise(F.col("n_top")))
    m = m.withColumn("block", block).withColumn("other", F.explode(others))
    m = m.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "size", "shingles")
    return written(m.groupBy("key", "i", "j").applyInArrow(search, "a long, b long"))


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    every = written(shingle_rows(docs, k, "keys array<long>", lambda sets: keys_column(sets, percent)))
    real = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    classes = every.filter(real).groupBy("fp").agg(F.min(F.struct("doc_id", "size", "keys")).alias("r"))
    wide = written(classes.select("fp", F.col("r.doc_id").alias("id"), "r.size", "r.keys"))
    keyed, every = every, written(every.drop("keys"))
    release(keyed)  # the keys are the widest column; the classes hold those that are asked for
    classes = written(wide.select("fp", "id"))
    shared = written(wide.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = written(mapped_keys(wide, map_of(shared.select(F.col("key").alias("h")))).join(shared, "key"))
    release(wide, shared)
    centre = members.groupBy(F.col("key").alias("c_key")).agg(F.min(F.struct("id", "size")).alias("centre"))
    stars = members.join(centre, F.col("key") == F.col("c_key")).filter((F.col("id") != F.col("centre.id")) & similar_sizes("size", "centre.size", percent))
    stars = written(stars.select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct())
    ids = written(members.select("id", "fp", "size").distinct())
    sets = shingle_rows(docs, k, "shingles binary", lambda sets: pa.array([s.tobytes() for s in sets], pa.binary()), map_of(ids.select(F.xxhash64("id").alias("h")))).filter(real).dropDuplicates(["doc_id", "fp"])
    sets = written(sets.join(ids.select("id", F.col("fp").alias("i_fp")), (F.col("doc_id") == F.col("id")) & (F.col("fp") == F.col("i_fp"))).select("id", "size", "shingles"))
    sizes = ids.groupBy("id").agg(F.max("size").alias("size"))
    members = members.select("key", "n", "id")

    # rows of one doc_id that stand in several classes tie these together
    row_class = every.filter(real).select("doc_id", "fp").join(classes.select("fp", "id"), "fp").select("doc_id", "id")
    tied = row_class.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z")
    ties = row_class.join(tied.select(F.col("doc_id").alias("d"), "a"), F.col("doc_id") == F.col("d")).select("a", F.col("id").alias("b")).filter("a <> b")

    links = written(searched(stars, sets, percent).unionByName(ties.distinct()))
    labels = written(components(links))
    still = unresolved(members, labels)
    more = searched(written(small_pairs(still, sizes, percent)), sets, percent).unionByName(large_links(still, sets, percent))
    out = every.join(classes.select(F.col("fp").alias("c_fp"), "id"), F.col("fp") == F.col("c_fp"), "left")
    out = out.join(merged_labels(labels, more), F.col("id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))

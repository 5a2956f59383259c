"""Operator 12: phrase collocations from weighted acyclic automata.

1. A first pass counts words and neighbouring pairs by 64-bit keys; those that reach ``min_count`` set the bits of a map
   of fixed size. A phrase can be frequent only if all its words and pairs are, and a false bit costs time alone.
2. A second pass cuts each task's texts into shards, sorts a shard's surviving phrases of one to five words and
   builds a count transducer from them: paths share their beginnings and, through a register of states, equal endings;
   a path's weight is its phrase's count. The transducers are dealt by language and prefix range, that is a range of
   the hash order of a phrase's first three words.
3. Of each range the transducers are united and their weights summed; paths under ``min_count`` go.
4. Every candidate is cut in two after each word. The parts asked for are dealt to the ranges that hold them and composed
   with the range's transducer, which answers with their counts. Scores are exact decimals; rows whose phrase stands
   in a longer one as often go, and each language's best are ranked.

Memory: a task holds a shard of ``SHARD`` bytes (or one longer text's tokens), a group the transducers of one
range, whose number grows with the corpus; a hot phrase is one path a shard wherever it stands.

Words are runs without space and tab inside pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z lower-cased. Defined results: null
texts are empty, a null lang is ``und``; repeated rows count again; ties are ranked by the phrase's bytes; texts without
words and empty tables give no rows. Columns besides lang and text are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsforge.llm.common import written

LONGEST = 5         # words of a phrase
PREFIX = 3          # words that decide on a phrase's range
MAP_BITS = 26       # 8 MB of bits
SHARD = 8 << 20     # bytes of text of which a task builds one transducer a language
CHUNK = 2 << 20     # bytes tokenised at once
RANGE = 16 << 20    # characters of the corpus for each prefix range
U = np.uint64
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
KIND = np.array([2 if i in BREAKS else 1 if i in BLANKS else 0 for i in range(256)], np.uint8)
GAP = re.compile(b"[" + re.escape(BREAKS + BLANKS) + b"]")
BASE = 0x9E3779B97F4A7C15
STEP = U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * STEP
    x = (x ^ (x >> U(32))) * STEP
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.ones(n, U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U(pow(base, have, 1 << 64))
        have += more
    return out


class Tokens:
    """The words of a lower-cased byte string: hash, number of its piece, start and end."""

    def __init__(self, text: bytes):
        parts, at, piece = [], 0, 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            if end < len(text):
                gap = GAP.search(text, end)
                end = gap.start() if gap else len(text)
            h, p, s, e, breaks = self._chunk(text[at:end])
            parts.append((h, p + piece, s + at, e + at))
            piece, at = piece + breaks, end
        self.hash, self.piece, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U), *[np.empty(0, np.int64)] * 3)

    @staticmethod
    def _chunk(text: bytes) -> tuple:
        raw = np.frombuffer(text, np.uint8)
        kind = KIND[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kind == 0, [0]]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        breaks = np.flatnonzero(kind == 2)
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * powers(BASE, len(raw)), out=sums[1:])
        h = (sums[e] - sums[s]) * powers(pow(BASE, -1, 1 << 64), len(raw) + 1)[s]
        return mixed(h + (e - s).astype(U)), np.searchsorted(breaks, s), s, e, len(breaks)


def keys_of(t: Tokens, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words and of the pairs from each word on, and which of these lie in one piece."""
    word = mixed(t.hash + U(xxhash.xxh3_64_intdigest(lang)))
    return word, mixed(word[:-1] * STEP + word[1:]), t.piece[:-1] == t.piece[1:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, lower-cased text) of whole shards, from batches of lang and text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass").translate(LOWER)
            held.setdefault(lang.as_py(), []).append(raw)
            size += len(raw) + 64
            if size >= SHARD:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


class Transducer:
    """An acyclic automaton whose paths are phrases and whose weights are counts, minimal at each depth.

    ``arcs[d]`` has, for the states at depth d in order: where each state's arcs begin, and the arcs' labels (numbers of
    ``words``, which are sorted), weights (the count of the path that ends there, or 0) and targets at depth d + 1."""

    def __init__(self, words: list[bytes], arcs: list[tuple[np.ndarray, ...]]):
        self.words, self.arcs = words, arcs

    @classmethod
    def build(cls, words: list[bytes], paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """From sorted, distinct phrases (rows of word numbers, -1 behind the end) over sorted words."""
        used = np.unique(paths[paths >= 0])
        paths = np.where(paths >= 0, np.searchsorted(used, paths), -1)
        size = (paths >= 0).sum(axis=1)
        same = np.zeros(paths.shape, bool)
        same[1:] = paths[1:] == paths[:-1]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        nodes = []  # per depth: label, weight and parent of its nodes
        above = np.zeros(len(paths), np.int64)
        for d in range(1, paths.shape[1] + 1):
            new = (size >= d) & (shared < d)
            at = np.cumsum(new) - 1
            weight = np.zeros(new.sum(), np.int64)
            weight[at[size == d]] = weights[size == d]
            nodes.append((paths[new, d - 1], weight, above[new]))
            above = at
        arcs: list[tuple[np.ndarray, ...]] = []
        future, state = np.zeros(len(nodes[-1][0]), U), np.zeros(len(nodes[-1][0]), np.int64)
        for d in range(len(nodes) - 1, -1, -1):
            label, weight, parent = nodes[d]
            n = len(nodes[d - 1][0]) if d else 1
            token = mixed(mixed(label.astype(U) * STEP + weight.astype(U) + U(1)) + future)
            begin = np.searchsorted(parent, np.arange(n + 1))
            sums = np.concatenate([np.zeros(1, U), np.cumsum(token)])
            future = sums[begin[1:]] - sums[begin[:-1]]  # equal for equal sets of arcs; 0 without any
            register, first, number = np.unique(future, return_index=True, return_inverse=True)
            count = begin[first + 1] - begin[first]
            own = np.repeat(begin[first] - np.cumsum(count) + count, count) + np.arange(count.sum())
            arcs.append((np.concatenate([[0], np.cumsum(count)]), label[own], weight[own], state[own]))
            state = number
        return cls([words[i] for i in used], arcs[::-1])

    def dumps(self) -> bytes:
        small = [tuple(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in a) for a in self.arcs]
        return pickle.dumps((self.words, small), protocol=5)

    @classmethod
    def loads(cls, raw: bytes) -> Transducer:
        words, arcs = pickle.loads(raw)
        return cls(words, [tuple(x.astype(np.int64) for x in a) for a in arcs])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All weighted paths and their weights."""
        at, rows = np.zeros(1, np.int64), np.empty((1, 0), np.int64)
        out, weights = [], []
        for d, (begin, label, weight, target) in enumerate(self.arcs):
            n = begin[at + 1] - begin[at]
            arc = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = np.column_stack([np.repeat(rows, n, axis=0), label[arc]])
            some = weight[arc] > 0
            out.append(np.pad(rows[some], ((0, 0), (0, len(self.arcs) - d - 1)), constant_values=-1))
            weights.append(weight[arc][some])
            at = target[arc]
        return np.concatenate(out), np.concatenate(weights)

    @classmethod
    def union(cls, many: Iterator[Transducer], least: int) -> Transducer | None:
        """Their union with summed weights, without paths under ``least``."""
        number: dict[bytes, int] = {}
        rows, weights = [], []
        for t in many:
            ids = np.array([number.setdefault(w, len(number)) for w in t.words], np.int64)
            p, w = t.paths()
            rows.append(np.where(p >= 0, ids[p], -1))
            weights.append(w)
        words = sorted(number)
        rank = np.empty(len(words), np.int64)
        rank[[number[w] for w in words]] = np.arange(len(words))
        p, w = np.concatenate(rows), np.concatenate(weights)
        p = np.where(p >= 0, rank[p], -1)
        order = np.lexsort(p.T[::-1])
        p, w = p[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)]))
        p, w = p[first], np.add.reduceat(w, first)
        keep = w >= least
        return cls.build(words, p[keep], w[keep]) if keep.any() else None

    def compose(self, phrases: list[bytes]) -> np.ndarray:
        """Counts of the phrases (0 where no path spells one): they and the automaton are walked word by word together."""
        number = {w: i for i, w in enumerate(self.words)}
        asked = [p.split(b" ") for p in phrases]
        out, at = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        alive = np.arange(len(asked))
        for d, (begin, label, weight, target) in enumerate(self.arcs):
            alive = alive[[len(asked[i]) > d for i in alive]]
            if not len(alive) or not len(label):
                break
            step = len(self.words) + 1
            key = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * step + label
            want = at[alive] * step + np.array([number.get(asked[i][d], len(self.words)) for i in alive], np.int64)
            arc = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[arc] == want
            alive, arc = alive[hit], arc[hit]
            at[alive] = target[arc]
            last = np.array([len(asked[i]) == d + 1 for i in alive], bool)
            out[alive[last]] = weight[arc[last]]
        return out


def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & U((1 << MAP_BITS) - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def in_range(key: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the prefix range of a prefix's key."""
    return ((key >> U(32)) * U(ranges) >> U(32)).astype(np.int32)


def shard_phrases(t: Tokens, text: bytes, lang: str, bits: np.ndarray, ranges: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words, and the shard's distinct phrases that may be frequent: paths, counts and ranges."""
    word, pair, inside = keys_of(t, lang)
    ok = has(bits, word)
    link = np.append(inside & ok[:-1] & ok[1:], False)
    link[np.flatnonzero(link)] = has(bits, pair[np.flatnonzero(link)])
    at = np.flatnonzero(ok)
    seen, first, inverse = np.unique(t.hash[at], return_index=True, return_inverse=True)
    words = [text[s:e] for s, e in zip(t.start[at[first]].tolist(), t.end[at[first]].tolist(), strict=True)]
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ids = np.full(len(word), -1, np.int64)
    ids[at] = rank[inverse]
    node, key = ids[at], word[at]
    paths, counts, spans = [], [], []
    above = np.empty((1, 0), np.int64)
    width = len(words) + 1
    parent = np.zeros(len(at), np.int64)
    for d in range(LONGEST):
        number, first, inverse, count = np.unique(parent * width + node, return_index=True, return_inverse=True, return_counts=True)
        rows = np.column_stack([above[number // width], number % width])
        paths.append(np.pad(rows, ((0, 0), (0, LONGEST - d - 1)), constant_values=-1))
        counts.append(count)
        spans.append(in_range(key[first], ranges))
        go = link[at + d]  # on to the next word
        at, above, parent, key = at[go], rows, inverse[go], key[go]
        node = ids[at + d + 1]
        if d + 1 < PREFIX:
            key = mixed(key * STEP + word[at + d + 1])
    return [words[i] for i in order], np.concatenate(paths), np.concatenate(counts), np.concatenate(spans)


def prefix_ranges(phrases: list[bytes], lang: str, ranges: int) -> np.ndarray:
    """The ranges of phrases, as ``shard_phrases`` has them; the phrases are tokenised as the lines of one text."""
    t = Tokens(b"\n".join(phrases))
    word = keys_of(t, lang)[0]
    first = np.searchsorted(t.piece, np.arange(len(phrases)))
    size = np.searchsorted(t.piece, np.arange(len(phrases)), side="right") - first
    key = word[first]
    for d in range(1, PREFIX):
        more = np.flatnonzero(size > d)
        key[more] = mixed(key[more] * STEP + word[first[more] + d])
    return in_range(key, ranges)


def frequent_map(own: DataFrame, min_count: int) -> np.ndarray:
    """The map of the keys of words and pairs that may occur ``min_count`` times."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches):
            word, pair, inside = keys_of(Tokens(text), lang)
            key, count = np.unique(np.concatenate([word, pair[inside]]), return_counts=True)
            for i in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 17)].view(np.int64)), pa.array(count[i : i + (1 << 17)].astype(np.int32))], names=["key", "n"])

    often = own.mapInArrow(rows, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    place = F.col("key").bitwiseAND((1 << MAP_BITS) - 1)
    cells = often.groupBy(F.shiftright(place, 15).alias("cell")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in cells.toLocalIterator():  # 2**(MAP_BITS - 15) rows of 4 KB at most, whatever the corpus
        out[r["cell"] << 12 : (r["cell"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def transducers(own: DataFrame, bits: np.ndarray, ranges: int) -> DataFrame:
    """lang, part (range, or -1 with the shard's number n of words), n, automaton."""
    shared = own.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches):
            t = Tokens(text)
            part, n, blob = [-1], [len(t.hash)], [None]
            if len(t.hash):
                words, paths, counts, spans = shard_phrases(t, text, lang, shared.value, ranges)
                order = np.lexsort((*paths.T[::-1], spans))
                paths, counts, spans = paths[order], counts[order], spans[order]
                cut = np.flatnonzero(np.diff(spans)) + 1
                for p, c, s in zip(np.split(paths, cut), np.split(counts, cut), np.split(spans, cut), strict=True):
                    if len(s):
                        part.append(int(s[0])), n.append(0), blob.append(Transducer.build(words, p, c).dumps())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], names=["lang", "part", "n", "automaton"])

    return own.mapInArrow(rows, "lang string, part int, n long, automaton binary")


def united(pieces: DataFrame, min_count: int) -> DataFrame:
    """lang, part, automaton: each range's union, of paths that reach ``min_count``."""
    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        t = Transducer.union((Transducer.loads(x.as_py()) for x in rows.column("automaton")), min_count)
        own = [] if t is None else [t.dumps()]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(own), pa.string()), "part": pa.array([key[1].as_py()] * len(own), pa.int32()), "automaton": pa.array(own, pa.binary())})

    return pieces.filter("part >= 0").groupBy("lang", "part").applyInArrow(one, "lang string, part int, automaton binary")


def candidates(ranges_table: DataFrame) -> DataFrame:
    """lang, phrase, size, a of the phrases of two words and more."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = Transducer.loads(blob)
                p, w = t.paths()
                size = (p >= 0).sum(axis=1)
                p, w, size = p[size > 1], w[size > 1], size[size > 1]
                text = [b" ".join(t.words[i] for i in row[:k]).decode("utf-8", "surrogatepass") for row, k in zip(p.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(w, pa.int64())], names=["lang", "phrase", "size", "a"])

    return ranges_table.select("lang", "automaton").mapInArrow(rows, "lang string, phrase string, size int, a long")


def part_counts(parts: DataFrame, ranges_table: DataFrame, ranges: int) -> DataFrame:
    """lang, p, f: counts of the distinct phrases ``p`` asked for, from the ranges that hold them."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [p.encode("utf-8", "surrogatepass") for p in b.column(1).to_pylist()]
            lang, part = np.array(b.column(0).to_pylist(), object), np.zeros(b.num_rows, np.int32)
            for x in set(lang):
                own = np.flatnonzero(lang == x)
                part[own] = prefix_ranges([raw[i] for i in own], x, ranges)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part), b.column(1)], names=["lang", "part", "p"])

    def lookup(asked: pa.Table, held: pa.Table) -> pa.Table:
        p = asked.column("p").to_pylist()
        f = np.zeros(len(p), np.int64)
        for blob in held.column("automaton"):
            f += Transducer.loads(blob.as_py()).compose([x.encode("utf-8", "surrogatepass") for x in p])
        return pa.table({"lang": asked.column("lang"), "p": asked.column("p"), "f": pa.array(f)})

    asked = parts.distinct().mapInArrow(placed, "lang string, part int, p string")
    return asked.groupBy("lang", "part").cogroup(ranges_table.groupBy("lang", "part")).applyInArrow(lookup, "lang string, p string, f long")


def part(first: str, n: str) -> str:
    """SQL of n words of a phrase from the word at ``first`` (from 1)."""
    return f"array_join(slice(split(phrase, ' '), {first}, {n}), ' ')"


def scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score at each candidate's lowest-scoring cut (ties to the smallest)."""
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr(part("1", "k"))).withColumn("right", F.expr(part("k + 1", "size - k")))
    of = lambda side, name: counts.select(F.col("lang").alias(f"{name}_lang"), F.col("p").alias(f"{name}_p"), F.col("f").alias(name))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(of(side, name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(side) == F.col(f"{name}_p")))
    cuts = cuts.join(totals, "lang")
    product = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))"  # 38 digits hold them
    score = F.expr(f"({product}) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    low = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return low.select("lang", "phrase", "size", "a", "n", "c.l", "c.r", "c.score")


def not_covered(found: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of candidates that no longer candidate holds ``percent`` of the time."""
    inner = found.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", F.expr(part("i", "m")).alias("phrase"), F.lit(None).cast("long").alias("own"), F.col("a").alias("longer"))
    both = inner.unionByName(found.select("lang", "phrase", F.col("a").alias("own"), F.lit(None).cast("long").alias("longer")))
    most = both.groupBy("lang", "phrase").agg(F.max("own").alias("own"), F.max("longer").alias("longer"))
    return most.filter(f"own is not null and not coalesce(100 * longer >= {percent} * own, false)").select("lang", "phrase")


def collocations(docs: DataFrame, min_count: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` by score and a descending, then phrase."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = 8 + size // RANGE
    pieces = written(transducers(own, frequent_map(own, min_count), ranges))
    totals = pieces.filter("part < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    held = written(united(pieces, min_count))
    found = written(candidates(held))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    asked = cuts.select("lang", F.explode(F.array(F.expr(part("1", "k")), F.expr(part("k + 1", "size - k")))).alias("p"))
    rows = scored(found, part_counts(asked, held, ranges), totals).join(not_covered(found, percent), ["lang", "phrase"])
    return ranked(rows, top)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; the planner cuts every task's rows to as many before they meet."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")

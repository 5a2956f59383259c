"""Operators 3 and 10 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsforge.llm import near_dedup, nearest

from .conftest import sentence

SF = "/root/testdata/sf0.01"


def brute_near(vectors, every, k):
    out = {}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    for i in ids:
        if i % every == 0:
            d = np.sqrt(((x - np.array(vectors[i], float)) ** 2).sum(axis=1))
            out[i] = sorted((float(d[j]), c) for j, c in enumerate(ids) if c != i)[:k]
    return out


def test_nearest_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: [float(np.float32(v)) for v in r["embedding"]] for r in df.collect() if r["embedding"] is not None and any(r["embedding"])}
    want = brute_near(rows, 10, 10)
    got = {}
    for r in nearest.neighbours(df, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hit = np.mean([len({c for _, c in got[q]} & {c for _, c in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    for q in want:
        exact = dict((c, s) for s, c in brute_near(rows, 10, len(rows))[q]) if q < 30 else None
        if exact:
            assert all(abs(exact[c] - s) < 1e-9 for s, c in got[q])


@pytest.mark.parametrize("shape", ["group", "outlier"])
def test_nearest_recall_on_uneven_vectors(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "group":  # a third of the rows are near copies of one
        x[::3] = x[0] + rng.normal(size=(1000, 32)) * 1e-5
    else:
        x[5] *= 1e6
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.neighbours(df, every=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_near(dict(enumerate(x.tolist())), 10, 10)
    hit = {q: len(got[q] & {c for _, c in want[q]}) / 10 for q in want}
    assert np.mean(list(hit.values())) >= 0.9
    assert np.mean([h for q, h in hit.items() if q % 3 == 0]) >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0, 2.0]) for i in range(0, 40)] + [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [1.0, float("nan"), 1.0]),
            (500, [float("inf"), 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [9.0, 9.0, 9.0]), (0, [0.0, 1.0, 2.0]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("block", F.lit(1))
    got = nearest.neighbours(df, every=100, k=10, window=2.0).orderBy("rank").collect()
    want = brute_near({i: [float(i % 7), 1.0, 2.0] for i in range(40)}, 100, 10)[0]
    assert [(r["score"], r["vec_id"]) for r in got] == want and {r["query_id"] for r in got} == {0}


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.neighbours(df).collect()] == [(0, 1, 1, 1.0)]
    assert nearest.neighbours(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.neighbours(alone).count() == 0


def brute_groups(rows, k, percent=80):
    def cut(t):
        ws = (t or "").encode().lower().split()
        n = min(k, len(ws))
        return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else frozenset()

    sets = [cut(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, _), (j, _) = rows[a], rows[b]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def copies(rng, n_groups, per_group, words, edits):
    rows, i = [], 0
    for _ in range(n_groups):
        base = sentence(rng, words, "the ing er tion wh ou and la").split()
        for _ in range(per_group):
            ws = list(base)
            for _ in range(rng.randint(0, edits)):
                ws[rng.randrange(len(ws))] = f"e{rng.randint(0, 99)}"
            rows.append((i, " ".join(ws)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shape", [(30, 6, 60, 5), (2, 90, 80, 8)])
def test_near_dedup(make_docs, shape, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    rows = copies(rng, *shape)
    odd = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "Two words"), (5004, "two  WORDS\n"), (5005, "one"), (5006, rows[0][1].upper()), (None, rows[0][1]),
           (None, None), (5007, "ÉÉ a b c d e"), (5008, "éé a b c d e"), (5009, "long " * 30000)]
    got = near_dedup.near_groups(make_docs(rows + odd), k=4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows + odd, 4)


def test_near_dedup_repeated_ids(make_docs):
    rng = random.Random(9)
    a, b, c = (sentence(rng, 50, "the ing er tion wh ou and la") for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, b), (4, c), (5, c + " more")]
    got = near_dedup.near_groups(make_docs(rows), k=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    docs = make_docs(rows)
    kept = near_dedup.keep_one(docs, near_dedup.near_groups(docs, k=4))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_near_dedup_empty(make_docs):
    assert near_dedup.near_groups(make_docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (150, 300)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 100}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.95, 0.8, 0.6):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.int64).astype(np.uint64)
            own = rng.integers(0, 2**63, 1000 - len(both), dtype=np.int64).astype(np.uint64)
            half = len(own) // 2
            m = [near_dedup.minhashes(np.concatenate([both, o])) for o in (own[:half], own[half:])]
            s = [np.frombuffer(near_dedup.odd_sketch(x), np.uint64) for x in m]
            errors.append(near_dedup.estimated(np.bitwise_count(s[0] ^ s[1]).sum()) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08

"""Operators 11, 12 and 13 against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from oddsforge.llm import collocations, filter_audit, ngram_join

from .conftest import sentence
from .test_search import brute_groups, copies

U = np.uint64


# --- operator 11


def hashes(rng, n):
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(U)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    linked = 0
    for trial in range(1500):
        n = int(rng.integers(1, 60)) if trial % 3 else int(rng.integers(60, 900))
        a = np.unique(hashes(rng, n))
        b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, int(0.17 * n) + 1):], hashes(rng, rng.integers(0, int(0.17 * n) + 1))]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and len(a) + len(b) != 2 * both:
            linked += 1
            assert len(np.intersect1d(ngram_join.keys_of(a, 85), ngram_join.keys_of(b, 85)))
    assert linked > 300


def test_search_equals_all_comparisons():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        base = np.unique(hashes(rng, n))
        sets = [np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, n // 4 + 1):], hashes(rng, rng.integers(1, n // 5 + 2))])) for _ in range(int(rng.integers(1, 60)))]
        lists = ngram_join.InvertedLists(sets)
        for q in [*sets[:5], base, np.unique(hashes(rng, 3))]:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
            assert sorted(lists.search(q, 85).tolist()) == want


@pytest.mark.parametrize("shape", [(30, 6, 60, 4), (2, 90, 80, 6)])
def test_join(make_docs, shape, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = copies(random.Random(8), *shape)
    odd = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "Two words"), (5004, "two  WORDS\n"), (5005, "one"), (5006, rows[0][1].upper()), (None, rows[0][1]),
           (None, None), (5007, "ÉÉ a b c d e"), (5008, "éé a b c d e"), (5009, "long " * 30000), (5010, " ".join(f"w{i}" for i in range(30000))),
           (5011, " ".join(f"w{i}" for i in range(28000)))]
    got = ngram_join.similar_documents(make_docs(rows + odd)).collect()
    want = [(i, n, c) for i, n, c, _ in brute_groups(rows + odd, 4, 85)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_join_repeated_ids_and_nothing(make_docs):
    rng = random.Random(9)
    a, b, c = (sentence(rng, 50, "the ing er tion wh ou and la") for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, b), (4, c), (5, c + " more")]
    got = ngram_join.similar_documents(make_docs(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and len(got) == len(rows)
    assert ngram_join.similar_documents(make_docs([])).count() == 0


# --- operator 12


def brute_collocations(rows, least, percent=100, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items())
            if not inside:
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def mined_rows():
    rng = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(rng.choice(["a", "bb", "Ñu", "的", "x1", "y"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0c"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([0, 1, 1]), text + " New York city hall" * rng.randint(0, 2), rng.choice(["en", "en", None, "日"])))
    return rows + [(5, None, "en"), (6, "", None), (7, ". ,;", "fr"), (8, "new york " * 3000, "en"), (9, "solo" * 30000, "en"), (9, "solo" * 30000, "en")]


@pytest.mark.parametrize("least,top", [(4, 2000), (30, 5)])
def test_collocations(make_docs, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "SHARD", 2000)
    monkeypatch.setattr(collocations, "CHUNK", 300)
    rows = mined_rows()
    got = collocations.collocations(make_docs(rows).repartition(5), least, 100, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations([(r[2], r[1]) for r in rows], least, 100, top)


def test_collocations_of_nothing(make_docs):
    assert collocations.collocations(make_docs([]), 1).count() == 0
    assert collocations.collocations(make_docs([(1, None), (2, " . ")]), 1).count() == 0


def test_scores_past_64_bits(spark):
    big = 10**12
    found = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, a long")
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 9)], "lang string, p string, f long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    row = collocations.scored(found, counts, totals).collect()[0]
    assert row["score"] == 1000 * big * 10**16 // ((big + 7) * (big + 9))


def test_transducer_round_trip():
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    counts = {tuple(rng.randrange(len(words)) for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(400)}
    paths = np.array(sorted(p + (-1,) * (5 - len(p)) for p in counts))
    t = collocations.Transducer.build(words, paths, np.array([counts[tuple(x for x in p if x >= 0)] for p in paths.tolist()]))
    t = collocations.Transducer.loads(t.dumps())
    got, weight = t.paths()
    assert {tuple(t.words[x] for x in p if x >= 0): w for p, w in zip(got.tolist(), weight.tolist(), strict=True)} == {tuple(words[x] for x in p): w for p, w in counts.items()}
    ask = [b" ".join(words[x] for x in p) for p in counts] + [b"zz", b"a zz", b"a a a a a a"]
    assert t.compose(ask).tolist()[: len(counts)] == list(counts.values()) and t.compose(ask).tolist()[-3:] == [0, 0, 0]
    equal_ends = np.array([[0, 2, 3, -1, -1], [1, 2, 3, -1, -1]])
    assert len(collocations.Transducer.build([b"a", b"b", b"c", b"d"], equal_ends, np.array([5, 5])).arcs[1][1]) == 1  # one shared state


# --- operator 13


def brute_audit(rows, labels):
    texts = [t or "" for _, t, _ in rows]
    of = {}
    for d, q, x in labels:
        if d is None:
            continue
        good, toxic = of.get(d, (0, 0))
        of[d] = max(good, int(q == 1)), max(toxic, int(x == 1))
    fails = []
    for (d, _, _), t in zip(rows, texts, strict=True):
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        fails.append({"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                      "D": any(c in "#$%&*|" for c in t), "E": d is not None and any(e is not None and e < d and u == t for (e, _, _), u in zip(rows, texts, strict=True))})
    out = []
    for part in sorted({s or "" for _, _, s in rows}):
        own = [(f, of.get(d, (0, 0))) for f, (d, _, s) in zip(fails, rows, strict=True) if (s or "") == part]
        total = Counter()
        some = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone = [o for o in left if o[0][x]]
                left = [o for o in left if not o[0][x]]
                total[x] += len(gone)
                some.append([part, "".join(order), step + 1, len(left), len(gone), sum(f[x] for f, _ in own) - len(gone),
                             sum(f[x] and sum(f.values()) == 1 for f, _ in own), sum(g for _, (g, _) in gone), sum(t for _, (_, t) in gone), x])
        out += [tuple(r[:-1]) + (total[r[-1]],) for r in some]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        words = [rng.choice(["Alpha", "beta", "gam", "D", "e#", "ff", "g", "hh", "ii", "jj"]) + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 49, 50, 80]))]
        rows.append((i, rng.choice([" ", "\n", "\x1f "]).join(words), rng.choice(["a", "b", "b", None, ""])))
    rows += [(200 + i, rows[3][1], "b") for i in range(20)] + [(300, None, "a"), (301, "", "a"), (302, None, None), (None, rows[3][1], "b"), (None, "", "c"),
             (303, "same", "a"), (303, "same", "a"), (304, "same", "a"), (305, "LONG " * 40000, "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in list(range(0, 305, 2)) + [4, 4, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as mask", "'x' as n", "'x' as part", "'x' as digest", "'x' as good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as good", "'x' as id")
    got = filter_audit.filter_audit(docs, marks)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0

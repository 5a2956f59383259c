"""Operators 4, 6, 7 and 9: exact round trips, brute force over all segmentations, accuracy on rows that were held out."""

import base64
import functools
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oddsforge.llm import bpe, language, token_counts, toxicity, words
from oddsforge.llm.words import Pieces

from .conftest import sentence

ODD = ["", None, " ", "\n\n  a", "<|endoftext|>x<|endoftext|>", "it's  we'll\r\n", "日本語 ñandú 😀😀", "\x00 a\x00", "ab" * 3000, "² Ⅷ 1234567", "a b c 　d", "...!!!,,,  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, make_docs, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([chr(rng.randint(32, 126)), chr(rng.randint(160, 0x2FFF)), " ", "the", "\n", "'s", "aaa"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    got = bpe.encode_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(np.frombuffer(bytes(by[i]["ids"]), "<u4")) == want
        assert by[i]["decoded"] == library.decode(want, skip_special_tokens=False) == (t or "")


def test_bpe_cache_turnover(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = bpe.Bpe(f.read())
    text = "one two three, four five six. seven two three one!\nnine ten eleven " * 3
    assert list(np.frombuffer(coder.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids


def brute_best(word, scores):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[j][0] + scores[word[j:i]], i - j, best[j][1] + 1) for j in range(max(0, i - token_counts.LONGEST_PIECE), i) if word[j:i] in scores]
        top = max(o[0] for o in options)
        best.append(min(((o[0], o[1], o[2]) for o in options if o[0] == top), key=lambda o: o[1])[::2])
    return best[-1][1]


def test_token_counts(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, sentence(rng, 40, "the ing er tion ä ß 12 , .")) for i in range(30)] + [(100, sentence(rng, 4, "a b"))]
    counter = token_counts.Counter(token_counts.read_scores())
    want = sorted((i, sum(brute_best(w.encode(), counter.scores) for w in counter.pattern.findall(t or ""))) for i, t in rows)
    assert sorted(map(tuple, token_counts.token_counts(make_docs(rows)).collect())) == want
    assert token_counts.token_counts(make_docs([])).count() == 0


def test_token_counts_use_every_piece(spark, make_docs):
    with open(public_tokenizers.path(token_counts.VOCABULARY), "rb") as f:
        scores = {base64.b64decode(p): -float(np.log(int(r) + 1.0)) for p, r in map(bytes.split, f)}

    def best(word):
        top = [(0.0, 0, 0)]
        for i in range(1, len(word) + 1):
            top.append(max((top[j][0] + scores[word[j:i]], j - i, top[j][2] + 1) for j in range(i) if word[j:i] in scores))
        return top[-1][2]

    long = sorted(p.decode() for p in scores if len(p) > 16 and p.isascii())
    rules = ["-" * 64, " " + "-" * 64, "=" * 64, "_" * 64, "#" * 32, "*" * 32, "-" * 300, "=" * 47, " responsibilities", " telecommunications"]
    rows = list(enumerate(rules + long + ["x" + p + "y" for p in long]))
    pattern = token_counts.Counter(scores).pattern
    want = {i: sum(best(w.encode()) for w in pattern.findall(t)) for i, t in rows}
    got = dict(map(tuple, token_counts.token_counts(make_docs(rows)).collect()))
    assert got == want and [got[i] for i in (0, 2, 3, 8)] == [1, 1, 1, 1]


def test_language_forward_sums_all_segmentations():
    names = [b"a", b"b", b"ab", b"aba", b"c", b"ca"]
    p = np.array([[0.3, 0.1], [0.2, 0.2], [0.2, 0.1], [0.1, 0.3], [0.1, 0.2], [0.1, 0.1]])
    scorer = language.Scorer(Pieces(names), p)

    @functools.cache
    def total(word):
        return np.ones(2) if not word else sum((p[k] * total(word[len(n):]) for k, n in enumerate(names) if word.startswith(n)), np.zeros(2))

    words = [b"abab", b"abaca", b"a", b"cabab", b"abacab", b"ab" * 20]
    scorer._learn(words)
    for w in words:
        assert np.allclose(scorer.logs[scorer.known[w]], np.log(total(w)))
    # expected uses of a piece: summed over explicit segmentations
    def uses(word):
        if not word:
            return [(1.0, [])]
        return [(p[k, 0] * q, [k] + ks) for k, n in enumerate(names) if word.startswith(n) for q, ks in uses(word[len(n):])]

    want = np.zeros(len(names))
    for w, weight in ((b"abab", 2.0), (b"abaca", 1.0)):
        paths = uses(w)
        for q, ks in paths:
            for k in ks:
                want[k] += weight * q / sum(x for x, _ in paths)
    assert np.allclose(language.expected_counts([b"abab", b"abaca"], np.array([2.0, 1.0]), Pieces(names), p[:, 0]), want)


def test_language_held_out_accuracy(spark, make_docs):
    rng = random.Random(5)
    style = {"en": "the ing er tion wh ou and", "de": "sch ein ung ü ß keit der", "fr": "é eau ou ment ê la que"}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(style))
        rows.append((i, sentence(rng, 25, style[lang]), lang))
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!! 😀", "en"), (1003, "日本", None), (1004, "schein " * 3000, None), (1005, "x" * 5000, "en"), (0, rows[0][1], rows[0][2])]
    got = language.identify(make_docs(rows + odd)).select("row.doc_id", "row.key", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003]["lang_pred"] in style and by[1004]["lang_pred"] == "de"
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got) >= len(held)
    assert np.mean([by[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_learns_wide_words_and_every_piece():
    names = language.read_pieces()
    with open(public_tokenizers.path(language.VOCABULARY), "rb") as f:
        assert {base64.b64decode(line.split()[0]) for line in f} <= set(names)
    assert language.spaced_words("Ab cd\nef-gh  \tñ 1 x") == [b"ab", b" cd", b"ef", b"gh", "ñ".encode(), b" x"]
    few = [b"a", b"b", b"ab", b" ", b" ab", b"ba" * 6]
    p = np.array([0.3, 0.2, 0.2, 0.1, 0.15, 0.05])
    words, weight = [b" " + b"ab" * 15, b"ba" * 30, b" ab"], np.array([2.0, 1.0, 3.0])
    want = np.zeros(len(few))
    for w, n in zip(words, weight, strict=True):
        fwd, back = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        spots = [(i, k) for i in range(len(w)) for k, x in enumerate(few) if w.startswith(x, i)]
        for i, k in spots:
            fwd[i + len(few[k])] += fwd[i] * p[k]
        for i, k in reversed(spots):
            back[i] += p[k] * back[i + len(few[k])]
        for i, k in spots:
            want[k] += n * fwd[i] * p[k] * back[i + len(few[k])] / fwd[-1]
    assert np.allclose(language.expected_counts(words, weight, Pieces(few), p), want)
    assert language.expected_counts(words, weight, Pieces(few), None)[0] == 2 * 15 + 30 + 3


def test_language_learns_rare_languages(spark, make_docs):
    rng = random.Random(11)
    rows = [(i, sentence(rng, 12, "the ing er tion wh ou and"), "en") for i in range(3000)]
    rows += [(5000 + i, sentence(rng, 12, "é eau ou ment ê la que"), "fr") for i in range(8)] + [(6000 + i, "null lang", None) for i in range(3000)]
    got = language.identify(make_docs(rows), train_docs=30).select("row.doc_id", "lang_pred").collect()
    assert all(r["lang_pred"] == ("fr" if r["doc_id"] >= 5000 else "en") for r in got if r["doc_id"] < 6000)


def test_language_without_labels(spark, make_docs):
    got = language.identify(make_docs([(1, "some text", None), (2, None, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language.identify(make_docs([])).count() == 0


def test_toxicity_held_out_and_misspelt(spark, make_docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        text = sentence(rng, rng.randint(20, 200), "the ing er tion wh ou and la").split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(["grumblefux", "zorkheads", "wankrotten"]) + rng.choice(["", "s", "y"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    unseen = " ".join(sentence(rng, 30, "the ing er").split() + ["grumblefuxx", "zorkheadz"] + sentence(rng, 30, "the ing er").split())
    odd = [(901, None), (902, ""), (903, "!!! 123"), (904, unseen), (905, "the " * 20000)]
    lab = spark.createDataFrame(labels + [(0, 0, 0), (None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(make_docs(rows + odd), lab).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    pred = np.array([got[i]["predicted"] for i in held])
    assert np.mean(pred == [i % 4 == 0 for i in held]) > 0.95 and all(got[i]["held_out"] for i in held)
    assert got[904]["predicted"] == 1
    assert [got[i]["predicted"] for i in (901, 902, 903, 905)] == [0] * 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_toxicity_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(make_docs([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(make_docs([]), none).count() == 0


def test_soft_maximum():
    got = toxicity.soft_maximum(np.array([1.0, 2.0, -3.0]), np.array([0, 2]))
    assert np.allclose(got, [math.log(math.exp(4) + math.exp(8)) / 4, -3])
    assert isinstance(pd.Series(got).sum(), float)


def brute_margin(word, margins):
    marked = b"<" + word + b">"
    found = []
    for i in range(len(marked)):
        for n in toxicity.SIZES:
            if i + n <= len(marked):
                h = n
                for c in marked[i : i + n]:
                    h = (h * int(words.BASE) + c + 1) % 2**64
                h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64
                found.append(margins[(h ^ h >> 29) >> 64 - toxicity.BUCKET_BITS])
    return sum(map(float, found)) / len(found)


def test_toxicity_score_is_the_soft_maximum_of_window_averages(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 61)
    margins = np.random.default_rng(3).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    texts = ["sh1t a$$ (really) 'quoted', é日本語 x", "w " * 40 + "ünsp" * 100, "", None, ". , !"]
    got = toxicity.Scorer(margins, 0.25).scores(texts)
    for text, score in zip(texts, got, strict=True):
        ws = [brute_margin(w, margins) for w in toxicity.toxic_words(text)] or [0.0]
        windows = [sum(ws[i : i + 16]) / len(ws[i : i + 16]) + 0.25 for i in range(0, len(ws), 16)]
        top = math.log(sum(math.exp(4 * x) for x in windows)) / 4
        assert abs(score - 1 / (1 + math.exp(-top))) < 1e-6
    assert toxicity.toxic_words("Sh1t, a$$! (it's) -- x-y.") == [b"sh1t", b"a$$", b"it's", b"x-y"]


def test_toxicity_of_long_unspaced_text(spark, make_docs):
    """A run of a million characters beside normal texts, in scoring and among the labelled rows: no word widens others."""
    import tracemalloc

    margins = np.zeros(1 << toxicity.BUCKET_BITS, np.float32)
    run = "的是不了人我在有他这" * 100_000
    tracemalloc.start()
    toxicity.Scorer(margins, 0.0).scores(["one two three"] * 500 + [run])
    long = ["的是不了人我在有他这" * 1000 + str(i) for i in range(40)]
    toxicity.train([*long, "plain words here"] * 2, np.array([0.0] * 41 + [1.0] * 41), epochs=1)
    assert tracemalloc.get_traced_memory()[1] < 10**9
    tracemalloc.stop()
    rng = random.Random(3)
    rows = [(i, sentence(rng, 30, "the ing er tion") + (" grumblefux" if i % 3 == 0 else "")) for i in range(150)] + [(900, run), (901, run[:9999])]
    lab = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(900, 1, 1), (901, 1, 0)], "doc_id long, quality int, toxic int")
    lab = lab.selectExpr("*", "'x' as text", "'x' as _text", "'x' as rank", "'x' as _doc", "'x' as _n")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(make_docs(rows), lab).collect()}
    assert len(got) == 152 and all(0 <= x <= 1 for x in got.values())
    assert np.mean([got[i] for i in range(0, 150, 3)]) > np.mean([got[i] for i in range(150) if i % 3]) + 0.1


def test_toxicity_sample_is_refilled_and_bounded(spark, make_docs):
    """Texts beyond the bound on characters leave before the ids are chosen; the bound on bytes ends a class's sample."""
    rows = [(i, ("long " * 50 if i % 2 else "short") + f" {i}") for i in range(400)]
    lab = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(400)], "doc_id long, toxic int")
    texts, y = toxicity.training_sample(make_docs(rows), lab, 30, 100, 10**6)
    assert len(texts) == 60 and y.sum() == 30 and all(t.startswith("short") for t in texts)
    texts, y = toxicity.training_sample(make_docs(rows), lab, 30, 100, 100)
    assert 0 < len(texts) < 60 and all(sum(len(t) for t, k in zip(texts, y, strict=True) if k == c) <= 100 for c in (0, 1))

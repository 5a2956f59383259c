"""Operator 9: language identification with segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary; a word keeps the space before it,
as pieces do. A word's likelihood is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. The language of the largest posterior is predicted, with that posterior as score.

Learning is expectation maximisation from labelled texts: pieces start from the counts of their places in the
words, then each round sums their expected uses over all segmentations (forward-backward). Words are counted and
expectations summed by Spark; the driver gets piece counts per language, bounded by the vocabulary. The
learning rows are all labelled rows of a language, or about ``train_docs`` of them by a hash where it has more, without
rows whose crc32(doc_id) is divisible by five; lang is read there only. Scoring covers every whole text.

A task scores a batch's unseen words together in a trie, so a prefix that words share is computed once.

Defined results: null text and text without a letter is ``und`` with score 0, and so is all text if nothing can
be learnt; rows with a null lang are not learnt from; ties of posteriors go to the first name; repeated rows are
predicted alike. Columns besides doc_id, text and (for learning) lang are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsforge.llm.common import held_out, written
from oddsforge.llm.words import LETTERS, Pieces, Trie, byte_matrix, prefix_hashes, run_hashes

WIDE, CACHE = 24, 400_000  # longer words are summed in logarithms, one by one
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
UND = "und"
#: As LETTERS, but only a space stays one.
SPACED = bytes(c if c != 32 or i == 32 else 10 for i, c in enumerate(LETTERS))
WORD = re.compile(rb" ?[^ \n]+")


def spaced_words(text: str | None) -> list[bytes]:
    """The text's letter_words, each with the space right before it, if there is one."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(SPACED))


def has_letter(text: str | None, words: list[bytes]) -> bool:
    return any(w[-1] < 128 or w.lstrip(b" ")[0] < 128 for w in words) or any(c.isalpha() for c in text or "")


def read_pieces(path: str | None = None) -> list[bytes]:
    """All pieces of the vocabulary; all single bytes are among them."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return sorted({*pieces} | {bytes([i]) for i in range(256)})


def places(m: np.ndarray, pieces: Pieces) -> list[tuple[int, np.ndarray]]:
    """Each piece length, and the piece of that length that starts at each byte of each row, or -1."""
    runs, out = prefix_hashes(m), []
    for size in pieces.lengths:
        if size > m.shape[1]:
            break
        h = run_hashes(runs[:, :-size], runs[:, size:], size)
        out.append((size, pieces.find(h.ravel()).reshape(h.shape)))
    return out


def ending(word: bytes, pieces: Pieces) -> list[list[tuple[int, int]]]:
    """Per number of bytes read, (start, piece) of the pieces that end there."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for size, a in places(np.frombuffer(word, np.uint8)[None], pieces):
        at = np.flatnonzero(a[0] >= 0)
        for i, k in zip(at.tolist(), a[0, at].tolist(), strict=True):
            out[i + size].append((i, k))
    return out


def log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def add_wide(total: np.ndarray, word: bytes, weight: float, pieces: Pieces, log_p: np.ndarray | None) -> None:
    """Adds one long word's expected uses to ``total``, or without ``log_p`` its pieces' places."""
    ends = ending(word, pieces)
    if log_p is None:
        np.add.at(total, [k for e in ends for _, k in e], weight)
        return
    fwd = [0.0]
    for e in ends[1:]:
        fwd.append(log_sum([fwd[i] + log_p[k] for i, k in e]))
    back: list[list[float]] = [[] for _ in ends]
    back[-1] = [0.0]
    for j in range(len(word), 0, -1):
        rest = log_sum(back[j])
        for i, k in ends[j]:
            back[i].append(rest + log_p[k])
            total[k] += weight * math.exp(min(0.0, fwd[i] + log_p[k] + rest - fwd[-1]))


def expected_counts(words: list[bytes], weight: np.ndarray, pieces: Pieces, p: np.ndarray | None) -> np.ndarray:
    """Weighted expected uses of each piece over all segmentations of words under ``p``; without ``p``, how often
    each stands anywhere in them."""
    total = np.zeros(len(pieces.keys))
    log_p = None if p is None else np.log(p)
    for w, n in zip(words, weight, strict=True):
        if len(w) > WIDE:
            add_wide(total, w, n, pieces, log_p)
    fit = [i for i, w in enumerate(words) if len(w) <= WIDE]
    fit.sort(key=lambda i: len(words[i]))
    for s in range(0, len(fit), 4096):
        some = fit[s : s + 4096]
        m, n = byte_matrix([words[i] for i in some])
        at, w = places(m, pieces), weight[some]
        inside = [np.arange(a.shape[1]) + k <= n[:, None] for k, a in at]
        if p is None:
            for (_, a), ok in zip(at, inside, strict=True):
                r, c = np.nonzero(ok & (a >= 0))
                total += np.bincount(a[r, c], w[r], len(total))
            continue
        q = [(k, np.where(ok & (a >= 0), p[a], 0.0)) for (k, a), ok in zip(at, inside, strict=True)]
        width = m.shape[1]
        fwd = np.zeros((len(some), width + 1))
        fwd[:, 0] = 1
        for i in range(1, width + 1):
            for k, x in q:
                if k <= i:
                    fwd[:, i] += fwd[:, i - k] * x[:, i - k]
        back = np.zeros((len(some), width + 1))
        back[np.arange(len(some)), n] = 1
        for i in range(width - 1, -1, -1):
            for k, x in q:
                if k <= width - i:
                    back[:, i] += x[:, i] * back[:, i + k]
        scale = w / np.maximum(fwd[np.arange(len(some)), n], 1e-300)
        for (k, a), (_, x) in zip(at, q, strict=True):
            uses = fwd[:, : a.shape[1]] * x * back[:, k:] * scale[:, None]
            r, c = np.nonzero(uses)
            total += np.bincount(a[r, c], uses[r, c], len(total))
    return total


class Scorer:
    """Log-likelihoods of whole texts under every language."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p, self.log_p = pieces, p, np.log(p)  # p: pieces x languages
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.logs = np.empty((0, self.p.shape[1]))

    def _wide(self, word: bytes) -> np.ndarray:
        """Logarithms of the forward sums of one long word."""
        ring = self.pieces.longest + 1
        f = np.zeros((ring, self.p.shape[1]))  # ring of the last sums
        for n, e in enumerate(ending(word, self.pieces)[1:], 1):
            f[n % ring] = np.logaddexp.reduce(f[[i % ring for i, _ in e]] + self.log_p[[k for _, k in e]], axis=0)
        return f[len(word) % ring].copy()

    def _learn(self, new: list[bytes]) -> None:
        order = [w for w in new if len(w) > WIDE]
        logs = [self._wide(w)[None] for w in order]
        short = [w for w in new if len(w) <= WIDE]
        if short:
            t = Trie(short)
            sums = np.zeros((len(short), t.m.shape[1] + 1, self.p.shape[1]))
            sums[:, 0] = 1
            for d, rows, found in t.lattice(self.pieces):
                now = np.zeros((len(rows), self.p.shape[1]))
                for size, at, owner, piece in found:
                    now[at] += sums[owner, d - size] * self.p[piece]
                sums[rows, d] = now
            order += t.words
            logs.append(np.log(sums[t.owner[np.arange(len(short)), t.n], t.n]))
        start = len(self.logs)
        self.logs = np.concatenate([self.logs, *logs])
        self.known.update(zip(order, range(start, start + len(order)), strict=True))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """One row of log-likelihoods per text; None where there is no letter."""
        docs = [spaced_words(t) for t in texts]
        if len(self.known) > CACHE:
            self._forget()
        new = list({w for d in docs for w in d if w not in self.known})
        if new:
            self._learn(new)
        return [self.logs[np.fromiter(map(self.known.__getitem__, d), np.int64, len(d))].sum(axis=0) if has_letter(t, d) else None
                for t, d in zip(texts, docs, strict=True)]


def fit(docs: DataFrame, path: str | None = None, train_docs: int = 6000, rounds: int = 2) -> tuple[list[str], np.ndarray | None]:
    """Languages and pieces x languages probabilities."""
    names = read_pieces(path)
    spark = docs.sparkSession
    sample = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    shares = sample.groupBy(F.col("lang").alias("_lang")).agg((F.lit(train_docs) / F.count(F.lit(1))).alias("share"))  # a row per language
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = sample.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(place < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(spaced_words(text))
            for lang, c in seen.items():
                words = list(c)
                for i in range(0, len(words), 20_000):
                    part = words[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([c[w] for w in part], pa.int64())], names=["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word binary, n long")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not langs:
        return [], None
    p = None
    for _ in range(rounds + 1):
        now = spark.sparkContext.broadcast((names, langs, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_names, own_langs, own_p = now.value
            pieces, sums = Pieces(own_names), {}
            for b in batches:
                lang = np.array(b.column(0).to_pylist())
                w, n = b.column(1).to_pylist(), b.column(2).to_numpy()
                for k in np.unique(lang):
                    mine = np.flatnonzero(lang == k)
                    got = expected_counts([w[i] for i in mine], n[mine].astype(float), pieces, None if own_p is None else own_p[:, own_langs.index(k)])
                    sums[k] = sums.get(k, 0) + got
            for k, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([str(k)] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "piece", "uses"])

        uses = words.mapInArrow(expect, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.full((len(names), len(langs)), 0.01)
        table[uses["piece"].to_numpy(), [langs.index(x) for x in uses["lang"]]] += uses["uses"].to_numpy()
        p = table / table.sum(axis=0)
    return langs, p


def identify(docs: DataFrame, path: str | None = None, train_docs: int = 6000, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): row (its columns ``carry``, as a struct), held_out, lang_pred and score."""
    langs, p = fit(docs, path, train_docs)
    model = docs.sparkSession.sparkContext.broadcast((read_pieces(path), langs, p))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, prob = model.value
        scorer = Scorer(Pieces(names), prob) if known else None
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                pred, score = [], []
                for log in scorer.texts(b.column(0).to_pylist()) if scorer else [None] * b.num_rows:
                    best = None if log is None else int(log.argmax())
                    pred.append(UND if best is None else known[best])
                    score.append(0.0 if best is None else float(1 / math.fsum(np.exp(log - log[best]))))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "held_out", "lang_pred", "score"])

    own = docs.select("text", F.struct(*carry).alias("row"), held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([own.schema["row"], own.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(rows, schema)

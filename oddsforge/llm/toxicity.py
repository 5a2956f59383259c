"""Operator 7: toxicity by subword-bag embeddings and a linear softmax.

A word is a run without white space (digits and symbols inside stay, so ``sh1t`` is one) and the average of the
embeddings of its character n-grams (three to six bytes of ``<word>``, hashed into buckets), so an unseen spelling or
ending shares most of a known word's vectors. N-grams are taken from the flat bytes of all words, in slices: memory does
not depend on a word's length. A window of 16 words is the
average of its words; a linear softmax over two classes scores it. A text scores by a soft maximum over
its windows, since one sentence makes a long text toxic. Embeddings and softmax are trained together in numpy
by Adagrad on a sample of at most ``per_class`` documents and ``max_train_bytes`` bytes of either label.

Only labelled documents whose crc32(doc_id) is not divisible by five are learnt from, and of these the sample is drawn from
those of at most ``max_train_chars`` characters; scoring reads every whole text. Between training and scoring the
softmax is folded into the embeddings: a bucket becomes one number, which is all that goes to the executors.

Defined results: null and empty texts and texts without words are scored as an empty window; repeated rows
score alike; of contradicting labels the toxic one counts; with no labels of both classes the score is the
share of toxic labels (0 without any). Columns besides doc_id and text (and doc_id, toxic) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.common import held_out
from oddsforge.llm.words import U, finished, window_hashes

BUCKET_BITS, DIM, WINDOW, SHARP = 18, 8, 16, 4.0
SIZES = (3, 4, 5, 6)
MARKS = b".,;:!?\"'()[]{}<>-"  # sentence punctuation
CACHE, KEPT = 300_000, 64  # words whose margins a task keeps, and their largest length
SLICE = 1 << 19            # bytes of words that are hashed at once
SCORED = 1 << 22           # bytes of texts that are scored at once


def toxic_words(text: str | None) -> list[bytes]:
    """Runs without white space, A-Z lower-cased, without sentence punctuation at their ends; digits and symbols stay."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return [w for w in (run.strip(MARKS) for run in raw.split()) if w]


def gram_slices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, numbers of the words they belong to) of the words' n-grams, by position in the flat bytes of all
    words, a slice of these at a time: neither a word's length nor the number of words widens anything."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words) + bytes(SIZES[-1]), np.uint8)
    for at in range(0, int(end[-1]) if len(words) else 0, SLICE):
        pos = np.arange(at, min(at + SLICE, int(end[-1])))
        owner = np.searchsorted(end, pos, side="right")
        h, whole = np.empty((len(pos), len(SIZES)), np.int32), np.empty((len(pos), len(SIZES)), bool)
        for j, n in enumerate(SIZES):
            run = window_hashes(flat[None, at : at + len(pos) + n - 1], n)[0]
            h[:, j] = finished(run) >> U(64 - BUCKET_BITS)
            whole[:, j] = pos + n <= end[owner]
        yield h[whole], np.repeat(owner, whole.sum(axis=1))


def gram_counts(words: list[bytes]) -> np.ndarray:
    return np.array([sum(max(0, len(w) + 3 - n) for n in SIZES) for w in words], np.int64)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, one word after the other, and how many each word has (one at least)."""
    return np.concatenate([np.empty(0, np.int32), *(h for h, _ in gram_slices(words))]), gram_counts(words)


def word_margins(words: list[bytes], margins: np.ndarray) -> np.ndarray:
    """Average margin of each word's n-grams."""
    sums = np.zeros(len(words))
    for h, owner in gram_slices(words):
        sums += np.bincount(owner, margins[h], len(words))
    return sums / np.maximum(gram_counts(words), 1)


def soft_maximum(margins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log-sum-exp over each text's run of windows, at sharpness SHARP."""
    top = np.maximum.reduceat(margins, starts)
    runs = np.diff(np.append(starts, len(margins)))
    return top + np.log(np.add.reduceat(np.exp(SHARP * (margins - np.repeat(top, runs))), starts)) / SHARP


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias) of embeddings and softmax trained together on the sample."""
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in toxic_words(t)], np.int64) for t in texts]
    grams, counts = word_grams(list(vocabulary))
    starts = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIM)).astype(np.float32) / DIM
    soft, bias = rng.normal(0, 1, (2, DIM)), np.zeros(2)
    g_emb, g_soft, g_bias = np.full(emb.shape, 1e-6, np.float32), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            lengths = np.array([max(1, len(docs[i])) for i in some])
            tokens = np.concatenate([docs[i] if len(docs[i]) else np.array([-1]) for i in some])
            windows = np.concatenate([np.arange(0, n, WINDOW) + o for n, o in zip(lengths, np.cumsum(lengths) - lengths, strict=True)])
            first = np.cumsum(-(-lengths // WINDOW)) - -(-lengths // WINDOW)
            sizes = np.diff(np.append(windows, len(tokens)))
            used, inverse = np.unique(tokens, return_inverse=True)
            known = used >= 0
            own = np.concatenate([np.empty(0, np.int64)] + [np.arange(starts[w], starts[w + 1]) for w in used[known]])
            ids, each = grams[own], counts[used[known]]
            vec = np.zeros((len(used), DIM))
            if len(ids):
                sums = np.add.reduceat(emb[ids], np.cumsum(each) - each, axis=0)
                vec[known] = sums / each[:, None]
            mean = np.add.reduceat(vec[inverse], windows, axis=0) / sizes[:, None]
            diff = soft[1] - soft[0]
            margin = mean @ diff + bias[1] - bias[0]
            pooled = soft_maximum(margin, first)
            error = 1 / (1 + np.exp(-pooled)) - labels[some]
            n_windows = np.diff(np.append(first, len(margin)))
            g = np.repeat(error, n_windows) * np.exp(SHARP * (margin - np.repeat(pooled, n_windows))) / len(some)
            step = g @ mean
            per_word = np.bincount(inverse, np.repeat(g / sizes, sizes), len(used))
            push = np.bincount(ids, np.repeat(per_word[known] / each, each), 1 << BUCKET_BITS) if len(ids) else np.zeros(1 << BUCKET_BITS)
            touched = np.flatnonzero(push)
            grad = push[touched, None] * diff
            g_emb[touched] += grad**2
            emb[touched] -= rate * grad / np.sqrt(g_emb[touched])
            for sign, k in ((-1, 0), (1, 1)):
                g_soft[k] += step**2
                soft[k] -= rate * sign * step / np.sqrt(g_soft[k])
                g_bias[k] += g.sum() ** 2
                bias[k] -= rate * sign * g.sum() / np.sqrt(g_bias[k])
    return (emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts; a word's margin is computed once and kept while there is room."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias, self.known = margins, bias, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [toxic_words(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for d in docs for w in d if w not in self.known})
        here = dict(zip(new, word_margins(new, self.margins).tolist(), strict=True))
        self.known.update((w, m) for w, m in here.items() if len(w) <= KEPT)
        out = np.empty(len(docs))
        for i, d in enumerate(docs):
            m = np.array([self.known[w] if w in self.known else here[w] for w in d]) if d else np.zeros(1)
            starts = np.arange(0, len(m), WINDOW)
            window = np.add.reduceat(m, starts) / np.diff(np.append(starts, len(m))) + self.bias
            out[i] = soft_maximum(window, np.zeros(1, np.int64))[0]
        return 1 / (1 + np.exp(-out))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_train_chars: int, max_train_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` texts and ``max_train_bytes`` of either label, of rows of at most ``max_train_chars``
    characters: the first by a hash of their ids."""
    of = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("_id is not null and toxic is not null")
    of = of.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    short = docs.select(F.col("doc_id").alias("_doc"), F.char_length(text).alias("_n")).filter(F.col("_n") <= max_train_chars)
    of = of.join(short.select("_doc").distinct(), F.col("_id") == F.col("_doc"), "left_semi")
    rank = F.xxhash64("_id")
    chosen = None
    for k in (0, 1):  # 2 * per_class ids: a fixed bound
        some = of.filter(F.col("toxic") == k).orderBy(rank, "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    own = docs.select(F.col("doc_id").alias("_doc"), text.alias("_text")).filter(F.char_length("_text") <= max_train_chars)
    rows = (own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
            .groupBy("_id").agg(F.min("_text").alias("text"), F.max("toxic").alias("toxic"), rank.alias("rank")).collect())
    left = {0: max_train_bytes, 1: max_train_bytes}
    texts, y = [], []
    for r in sorted(rows, key=lambda r: (r["rank"], r["_id"])):
        left[r["toxic"]] -= len(r["text"].encode("utf-8", "surrogatepass"))
        if left[r["toxic"]] >= 0:
            texts.append(r["text"])
            y.append(float(r["toxic"]))
    return texts, np.array(y)


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most 512 texts and SCORED bytes (or of one longer text)."""
    size = np.array([0 if v is None else v for v in pc.binary_length(column).to_pylist()], np.int64)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and (i - start == 512 or held + n > SCORED):
            yield start, i
            start, held = i, 0
        held += n
    if len(size):
        yield start, len(size)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_train_chars: int = 10_000, max_train_bytes: int = 12_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5)."""
    texts, y = training_sample(docs, labels, per_class, max_train_chars, max_train_bytes)
    both = len(y) and 0 < y.sum() < len(y)
    share = float(y.mean()) if len(y) else 0.0
    model = docs.sparkSession.sparkContext.broadcast(train(texts, y) if both else None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value) if model.value else None
        for whole in batches:
            for i, j in parts(whole.column(2)):
                b = whole.slice(i, j - i)
                s = scorer.scores(b.column(2).to_pylist()) if scorer else np.full(b.num_rows, share)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")

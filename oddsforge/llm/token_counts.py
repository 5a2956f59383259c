"""Operator 6: token counts by trie-shared dynamic programming.

Texts are cut into pre-tokens by the byte-level pattern. The distinct unseen pre-tokens of a batch are put in a
trie, and the best unigram score (Viterbi, in log space) of every prefix is computed once, at the node that all
words with that prefix share, along with the number of tokens that reach it. A text's count is the sum of
its pre-tokens' terminal counts.

The vocabulary is a public byte vocabulary, listed by rank; a piece's log-probability falls with its rank by
Zipf's law, -log(rank + 1). No tokenizer is trained. Of equally good segmentations the one with the shorter last
token counts, at every prefix.

Defined results: null and empty texts count 0; repeated rows count alike; an empty table gives no rows. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsforge.llm.bpe import PATTERN, SPACE
from oddsforge.llm.words import Pieces, Trie

WIDE, CACHE = 48, 300_000
VOCABULARY = "byte_bpe_50k.tiktoken"
LONGEST_PIECE = 128  # bytes of its longest piece; a Counter takes the lengths from the pieces themselves


def read_scores(path: str | None = None) -> dict[bytes, float]:
    """All pieces and their scores."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = [line.split() for line in f if line.strip()]
    return {base64.b64decode(p): -float(np.log(int(r) + 1.0)) for p, r in ranks}


class Counter:
    """Token counts of whole texts; the counts of chunks between spaces are kept while there is room."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        names = list(scores)
        self.pieces, self.score = Pieces(names), np.array([scores[p] for p in names])
        self.pattern, self.near_spaces = regex.compile(PATTERN), regex.compile(rf"[{SPACE}]{{2}}|\x00")
        self.known: dict[str, int] = {}

    def _wide(self, word: bytes) -> int:
        """One long pre-token, with no others to share prefixes with."""
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            top = (-np.inf, 0)
            for size in self.pieces.lengths:
                if size > i:
                    break
                s = self.scores.get(word[i - size : i])
                if s is not None and best[i - size][0] + s > top[0]:
                    top = (best[i - size][0] + s, best[i - size][1] + 1)
            best.append(top)
        return best[-1][1]

    def words(self, words: list[bytes]) -> dict[bytes, int]:
        """Terminal counts of distinct pre-tokens."""
        out = {w: self._wide(w) for w in words if len(w) > WIDE}
        short = [w for w in words if len(w) <= WIDE]
        if short:
            t = Trie(short)
            best = np.zeros((len(short), t.m.shape[1] + 1))
            count = np.zeros(best.shape, np.int64)
            for d, rows, found in t.lattice(self.pieces):
                top, n = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
                for size, at, owner, piece in found:
                    s = best[owner, d - size] + self.score[piece]
                    better = s > top[at]
                    top[at[better]], n[at[better]] = s[better], count[owner[better], d - size] + 1
                best[rows, d], count[rows, d] = top, n
            ends = count[t.owner[np.arange(len(short)), t.n], t.n]
            out.update(zip(t.words, ends.tolist(), strict=True))
        return out

    def texts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > CACHE:
            self.known = {}
        docs = []
        for t in texts:
            t = t or ""
            docs.append(self.pattern.findall(t) if self.near_spaces.search(t) else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))
        new = {c: self.pattern.findall(c) for c in {c for d in docs for c in d if c not in self.known}}
        if new:
            distinct = {w: w.encode("utf-8", "surrogatepass") for ws in new.values() for w in ws}
            counts = self.words(list(distinct.values()))
            self.known.update((c, sum(counts[distinct[w]] for w in ws)) for c, ws in new.items())
        return [sum(map(self.known.__getitem__, d)) for d in docs]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens."""
    scores = docs.sparkSession.sparkContext.broadcast(read_scores(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(scores.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.texts(b.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id"), "text").mapInArrow(rows, "doc_id long, n_tokens long")

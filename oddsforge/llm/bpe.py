"""Operator 4: exact BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is just one token its encoding can end with. An automaton over the
vocabulary (its states follow suffix links) names, for each prefix, all tokens that are suffixes of it; the one
to keep starts where a shorter prefix ends whose own last token it may stand behind. ``compatible`` tests that
on the two tokens alone: no merge across their seam may come before the merges that use up the seam's sides.
Following the last tokens back from the end gives the ids, in time linear in the text, without merging anything.

Pre-tokens follow the tokenizer file's byte-level pattern. A text without two neighbouring white-space characters
falls apart at its spaces and newlines, just where the pattern splits; these chunks' ids are cached, and only
unseen ones reach the pattern and the programming. Added tokens' strings (``<|endoftext|>``) are their own ids.

Defined results: null text is empty and has no ids; repeated rows are encoded alike; ``decoded`` comes from the ids
alone, so it equals the text. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of the pattern's \\s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern that splits text before merging.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHE, LONG, MEMO = 400_000, 256, 2_000_000
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are their own letter, the
    rest take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one tokenizer file, and its encoder and decoder."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        ids = data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: to_bytes(s) for s, i in ids.items() if s not in self.added}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # rank, left, right
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]):
            self.rank[ids[a], ids[b]] = r
            self.parts.setdefault(ids[a + b], (r, ids[a], ids[b]))
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        whole: set[int] = set()  # tokens that their own bytes encode to
        for t in sorted(self.bytes, key=lambda t: self.parts.get(t, (-1,))[0]):
            self.right_edge[t], self.left_edge[t] = self._edge(t, 2), self._edge(t, 1)
            if t not in self.parts:
                whole.add(t)
            elif self.parts[t][1] in whole and self.parts[t][2] in whole and self._first_across(*self.parts[t][1:]) == self.parts[t][0]:
                whole.add(t)
        self.memo: dict[tuple[int, int], bool] = {}
        self.whole = {self.bytes[t]: t for t in whole}
        self.automaton = ahocorasick.Automaton()
        for b, t in self.whole.items():
            self.automaton.add_word(b.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.near_spaces = regex.compile(rf"[{SPACE}]{{2}}|\x00")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at a token's right (2) or left (1) end while it is merged, each with the rank of the
        merge that uses it up."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out
            until, t = self.parts[t][0], self.parts[t][side]

    def _first_across(self, a: int, b: int) -> float:
        """Rank of the first merge that could happen across the seam of two tokens. Of equal ranks the leftmost merge
        goes first, so it must come before the left side is used up, and not after the right side is."""
        first = float("inf")
        for x, x_until in self.right_edge[a]:
            for y, y_until in self.left_edge[b]:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and r < first:
                    first = r
        return first

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a`` in an encoding."""
        ok = self.memo.get((a, b))
        if ok is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            ok = self.memo[a, b] = self._first_across(a, b) == float("inf")
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (t := self.whole.get(word)) is not None:
            return [t]
        last = [-1] * (len(word) + 1)
        size, memo = self.size, self.memo.get
        for end, t in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - size[t]
                if not before:
                    last[end] = t
                elif (a := last[before]) >= 0:
                    ok = memo((a, t))
                    if self.compatible(a, t) if ok is None else ok:
                        last[end] = t
        ids, i = [], len(word)
        while i:
            ids.append(last[i])
            i -= size[last[i]]
        return ids[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of an unseen chunk; its pre-tokens are looked up and kept in the same cache."""
        out = self.old.get(chunk)
        if out is None:
            words = self.pattern.findall(chunk)
            if len(words) == 1:
                out = np.array(self.encode_word(chunk.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            else:
                out = b"".join([self.known.get(w) or self._chunk(w) for w in words])
        if len(chunk) <= LONG:
            if len(self.known) >= CACHE:
                self.old, self.known = self.known, {}
            self.known[chunk] = out
        return out

    def _plain(self, text: str) -> bytes:
        chunks = self.pattern.findall(text) if self.near_spaces.search(text) else text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        known, out = self.known.get, []
        for c in chunks:
            if (got := known(c)) is None:
                got = self._chunk(c)
                known = self.known.get
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_added is None or not self.split_added.search(text):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.split_added.split(text) if p)

    @cached_property
    def spelled(self) -> list[bytes]:
        both = self.bytes | {i: s.encode() for s, i in self.added.items()}
        return [both.get(i, b"") for i in range(max(both) + 1)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit integers) and decoded, read back from
    the ids. The file at ``path`` (some 1.5 MB) is read once and broadcast."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                ids = [bpe.encode(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids binary, decoded string")


def encoding_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encode_documents(docs, path)
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

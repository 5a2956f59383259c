"""Operator 5: secret scan, in DataFrame functions only.

Base spans come from three patterns (assignments, access keys, long hex). Beyond them, every run of ``min_run`` key
characters or more is scored by two first-order character Markov models, one of random strings and one of ordinary
identifiers; where the log-likelihood ratio of its characters favours "random" by ``min_llr`` nats or more, the run is a
span of kind ``markov``. Base spans are blanked out first, so of a run that meets one the parts outside it are scored.
``min_run`` is about the shortest run whose pairs can reach ``min_llr``.

Training: the labelled samples are the values of base matches (random) and the other runs of key characters
that occur more than once (ordinary) in a sample of about ``train_docs`` documents, taken by a hash of doc_id. Only counts of
character pairs (at most 67 x 67 for each model) come to the driver. Scoring covers every whole text.

Defined results: null text is empty and has no spans; repeated rows each get their row; with no documents to
learn from both models are uniform and add nothing. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, least length of the whole match, least length of its value (group 1).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"   # the same spans as AKIA[A-Z0-9]+ of 20 characters or more
HEX = "[0-9a-f]{24,}"          # the same spans as [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
BACK_OFF = 20.0  # pairs that the characters' own shares count for after each character
PAIRS = r"(?=([A-Za-z0-9+/_=-]{2}))"


def _spans(text: Column, pattern: str, kind: int, keep=None, passes: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start,kind,end,value>> of the pattern's leftmost matches: what ``split`` leaves and what
    the pattern matches alternate, so their lengths give the places, in code points. Matches that do not
    pass are never appended, so many of them cost no more than their number."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if keep else found
    state = "struct<at:bigint,out:array<struct<start:bigint,kind:int,end:bigint,value:string>>>"
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        good = x["hit"].isNotNull() if passes is None else x["hit"].isNotNull() & passes(x["hit"])
        out = F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"), out.alias("out")).cast(state)

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("out")).cast(state)
    spans = F.aggregate(zipped, empty, step)["out"]
    spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= keep) if keep else spans
    return F.when(F.size(found) == 0, empty["out"]).otherwise(spans)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and the spans of the three patterns: assign, access, hex."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    return rows.select("doc_id", "text", _spans(text, ASSIGN, 0, keep=6).alias("assign"),
                       _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"))


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space for every character inside the spans: all other characters keep their places."""
    state = "struct<at:bigint,out:string>"

    def step(acc, x):
        start, end = F.greatest(acc["at"], x["start"]), F.greatest(acc["at"], x["end"])
        between = F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(acc["out"], between, F.repeat(F.lit(" "), (end - start).cast("int"))).alias("out")).cast(state)

    all_of = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(state), step)
    rest = F.substring(text, (all_of["at"] + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(all_of["out"], rest))


def train_models(docs: DataFrame, train_docs: int = 4000) -> list[float]:
    """Log ratio of P(next | previous) under random strings and under ordinary identifiers, row by row of the
    alphabet's pairs; a pair's share falls back on the second character's own share, and that on one count each."""
    rows = docs.count()  # read from the files' footers
    share = min(1.0, train_docs / max(rows, 1))
    sample = base_spans(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    base = F.concat("assign", "access", "hex")
    marked = sample.select(base.alias("base"), "text")
    positive = marked.select(F.explode(F.transform("base", lambda s: s["value"])).alias("run")).select("run", F.lit(1).alias("label"), F.lit(1).cast("long").alias("times"))
    runs = marked.select("base", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("run"))
    negative = runs.filter(~F.exists("base", lambda s: F.contains(s["value"], F.col("run")) | F.contains(F.col("run"), s["value"])))
    negative = negative.groupBy("run").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("run", F.lit(0).alias("label"), "times")
    pairs = positive.unionByName(negative).select("label", "times", F.explode(F.regexp_extract_all("run", F.lit(PAIRS), F.lit(1))).alias("pair"))
    seen = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.sum("times").alias("n")).collect()}
    own = {(k, b): sum(seen.get((k, a + b), 0) for a in ALPHABET) for k in (0, 1) for b in ALPHABET}
    every = {k: sum(own[k, b] for b in ALPHABET) for k in (0, 1)}
    after = {(k, a): sum(seen.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}

    def log_p(k: int, a: str, b: str) -> float:
        alone = (own[k, b] + 1) / (every[k] + N)
        return math.log((seen.get((k, a + b), 0) + BACK_OFF * alone) / (after[k, a] + BACK_OFF))

    return [round(log_p(1, a, b) - log_p(0, a, b), 4) for a in ALPHABET for b in ALPHABET]


def llr(run: Column, model: list[float]) -> Column:
    """Sum of the model's log ratios over a run's character pairs."""
    ratios = F.expr("array(" + ",".join(f"{x}D" for x in model) + ")")
    places = F.expr("array(" + ",".join(str(ALPHABET.find(chr(i))) for i in range(128)) + ")")
    return F.aggregate(F.regexp_extract_all(run, F.lit(PAIRS), F.lit(1)), F.lit(0.0), lambda acc, p: acc + F.get(
        ratios, F.get(places, F.ascii(p)) * N + F.get(places, F.ascii(F.substring(p, 2, 1)))))


def scan_secrets(docs: DataFrame, train_docs: int = 4000, min_run: int = 8, min_llr: float = 10.0) -> DataFrame:
    """Per row of ``docs``: doc_id and the arrays assign, access, hex and markov of struct<start,kind,end,value>
    (code points, end exclusive; kind indexes KINDS)."""
    model = train_models(docs, train_docs)
    base = base_spans(docs)
    left = base.withColumn("left", blanked(F.col("text"), F.concat("assign", "access", "hex")))
    random = _spans(F.col("left"), "[A-Za-z0-9+/_=-]{%d,}" % min_run, 3, passes=lambda run: llr(run, model) >= min_llr)
    return left.select("doc_id", "assign", "access", "hex", random.alias("markov"))


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them, written out) and n_markov."""
    s = scan_secrets(docs, **params)
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(written_spans(F.concat("assign", "access", "hex")), 256).alias("base_sha256"),
                    written_spans(F.concat("assign", "access", "hex", "markov")).alias("spans"), count("markov"))

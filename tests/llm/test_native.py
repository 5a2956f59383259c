"""Operators 1, 2, 5 and 8 against plain Python on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from oddsforge.llm import chat, decontaminate, line_dedup, secrets

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACE = " \t\n\x0b\x0c\r"
lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

TURNS = [(1, 0, "system", "be <|im_end|>\n brief"), (1, 1, "user", None), (1, 2, "assistant", "a<\\|b <|x|> <\\\\|"), (1, 3, "assistant", "é😀"),
         (1, 3, "assistant", "é😀"), (2, 0, "user", "no reply"), (None, None, None, "lost"), (None, 5, "assistant", ""),
         (3, 2000, "assistant", "late"), (3, 1, "us%er\n<|im_end|>", "<"), (3, 1030, "user", "|x\\")]


def test_chat_digest(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("segment", F.lit("s"))
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    for conv in {t[0] for t in TURNS}:
        rows = sorted([(t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv])
        replies = [r[3] for r in rows if r[2] == "assistant"]
        r = got[conv]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == sha("".join(f"{x[2]}\n{x[3]}\n" for x in rows))
        assert (r["loss_chars"], r["loss_sha256"]) == (len("".join(replies)), sha("".join(replies)))
        assert r["n_examples"] == len(replies)


def test_chat_examples_are_prefixes(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    segs = chat.segments(df, piece=2)
    texts = {r["conv_id"]: r["formatted"] for r in chat.conversation_texts(segs).collect()}
    exs = chat.example_texts(chat.examples(segs), chat.conversation_texts(segs)).collect()
    assert len(exs) == sum(t[2] == "assistant" for t in TURNS)
    for e in exs:
        assert texts[e["conv_id"]].startswith(e["text"]) and e["text"].endswith("<|im_end|>\n")
        assert e["text"][: e["loss_start"]].endswith("<|im_start|>assistant\n") and "<|" not in e["text"][e["loss_start"] : e["loss_end"]]


def test_chat_empty(spark):
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


LINES = [(1, "  This LINE is a license line\nown one\n\nÉé line that is long enough here"), (2, "this line IS a license line \t\nown two"), (5, "this line is a license line\nthis line is a license line"),
         (5, "this line is a license line\nthis line is a license line"), (7, None), (8, ""), (9, "éé line that is long enough here\nshort"), (10, "\x0bÉé line that is long enough here"),
         (11, "Éé line that is long enough here\r\ntwo documents only here"), (12, "two documents only here"), (None, "this line is a license line\nnull id")]


def brute_lines(rows):
    key = lambda x: lower(x.strip(SPACE))
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and max(where[key(x)]) != (-1 if i is None else i))]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_line_dedup(make_docs):
    got = line_dedup.line_dedup(make_docs(LINES)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(LINES)


def test_line_dedup_hot_lines(make_docs, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a very common license line", f"only line of document {i}", "another quite common line"]) for _ in range(4))) for i in range(900)]
    got = line_dedup.line_dedup(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_line_dedup_empty(make_docs):
    assert line_dedup.line_dedup(make_docs([])).count() == 0


def brute_base(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base_spans(make_docs):
    rng = random.Random(2)
    bits = ["token: token: abcdefgh", "password=abc password='hunter22'", "API_KEY :  \"A.b/c=d-e_f\"", "AKIA" + "A1" * 8, "XAKIAKIA" + "Z9" * 9, "AKIA12",
            "0123456789abcdef" * 2, "deadbeef", "é😀", "\n", " ", "secret", "=", "apikey=", "pässwd=abcdefg", "PASSWD=abcdefg", "a" * 23, "f" * 24]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(900, None), (901, ""), (905, "token=abcdef1"), (905, "token=abcdef1")]
    got = secrets.secret_digest(make_docs(rows)).collect()
    name = ["assign", "access", "hex"]
    want = sorted((i, *[sum(s[1] == k for s in brute_base(t)) for k in range(3)], sha(",".join(f"{name[k]}:{a}:{b}" for a, k, b in brute_base(t)))) for i, t in rows)
    assert sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        base = [f"{name[k]}:{a}:{b}" for a, k, b in brute_base(t)]
        spans = by[i]["spans"].split(",") if by[i]["spans"] else []
        assert [s for s in spans if not s.startswith("markov")] == base
        for s in spans:
            _, a, b = s.split(":")
            if s.startswith("markov"):
                assert not any(int(a) < e and st < int(b) for st, _, e in brute_base(t))


def test_secrets_markov_finds_random_strings(make_docs):
    rng = random.Random(3)
    alphabet = secrets.ALPHABET[:62]
    words = lambda n: " ".join("".join(rng.choice(["the", "ing", "er", "tion", "an", "or", "wh"]) for _ in range(rng.randint(1, 9))) for _ in range(n))
    rows = [(i, words(60) + f" token={''.join(rng.choice(alphabet) for _ in range(30))} ") for i in range(60)]
    hidden = "".join(rng.choice(alphabet) for _ in range(40))
    rows.append((1000, words(30) + " " + hidden + " " + words(3)))
    got = {r["doc_id"]: r for r in secrets.secret_digest(make_docs(rows)).collect()}
    start = rows[-1][1].index(hidden)
    assert got[1000]["spans"] == f"markov:{start}:{start + 40}"
    assert sum(r["n_markov"] for i, r in got.items() if i != 1000) == 0


def test_secrets_markov_short_runs_and_rests(make_docs):
    """Secrets of 12 to 19 characters, and the part of a run that lies outside a base span; long and odd texts."""
    rng = random.Random(13)
    alphabet = secrets.ALPHABET[:62]
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    words = lambda n: " ".join("".join(rng.choice(["the", "ing", "er", "tion", "an", "or", "wh"]) for _ in range(rng.randint(1, 9))) for _ in range(n))
    rows = [(i, words(60) + f" token={draw(30)} ") for i in range(80)]
    hidden = {1000 + n: draw(n) for n in range(12, 20)}
    rows += [(i, "é " + words(8) + " " + h + " " + words(3)) for i, h in hidden.items()]
    key = "AKIA" + "Z9" * 9
    rest = draw(30).replace("Z", "y").lower() + "q"
    rows += [(2000, f"{words(4)} {rest}{key}-{rest} {words(4)}"), (2001, words(60_000)), (2002, f"password=abcdefgh token=password=abcdefgh {words(5)}")]
    got = {r["doc_id"]: r["spans"].split(",") for r in secrets.secret_digest(make_docs(rows)).collect()}
    text = dict(rows)
    found = sum(f"markov:{text[i].index(h)}:{text[i].index(h) + len(h)}" in got[i] for i, h in hidden.items())
    assert found >= 7
    at = text[2000].index(key)
    assert f"access:{at}:{at + len(key)}" in got[2000] and sum(x.startswith("markov") for x in got[2000]) == 2
    assert not any(x.startswith("markov") for i in (*range(80), 2001, 2002) for x in got[i])


def test_secrets_empty(make_docs):
    assert secrets.secret_digest(make_docs([])).count() == 0


def brute_leaks(docs, items, least=0.8):
    out = {}
    cut = lambda ws, k: Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for i, t in docs:
        ws = lower(t or "").strip(SPACE)
        ws = [w for w in re.split(f"[{SPACE}]+", ws) if w]
        for j, it in items:
            iw = [w for w in re.split(f"[{SPACE}]+", lower(it or "")) if w]
            if not iw:
                continue
            k = min(5, len(iw))
            if not cut(ws, k).keys() & cut(iw, k).keys():
                continue  # nothing in common, similarity 0
            best = max((sum((cut(ws[s : s + len(iw)], k) & cut(iw, k)).values()) / max(1, sum((cut(ws[s : s + len(iw)], k) | cut(iw, k)).values())) for s in range(len(ws))), default=0)
            if best >= least:
                out[i, j] = round(best, 9)
    return out


def test_decontamination(spark, make_docs):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randint(0, 40))
    items = [(j, " ".join(word() for _ in range(rng.randint(12, 40)))) for j in range(8)] + [(50, "Three short words"), (51, None), (52, "  "), (53, "x y x y x y x y x y")]
    items.append((60, items[0][1]))
    docs = []
    for i in range(60):
        ws = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            it = rng.choice([x for x in items if x[1] and x[1].strip()])[1].upper().split()
            for _ in range(rng.randint(0, 2)):
                it.insert(rng.randint(0, len(it)), "new")
            if rng.random() < 0.5:
                it = it[1:]
            at = rng.randint(0, len(ws))
            ws[at:at] = it
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(ws)))
    docs += [(70, None), (71, ""), (72, "\t"), (3, docs[3][1]), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("value", F.lit(1)).withColumn("ws", F.lit(1))
    got = decontaminate.find_leaks(make_docs(docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == brute_leaks(docs, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) > 10
    left = decontaminate.without_leaks(make_docs(docs), decontaminate.find_leaks(make_docs(docs), bench))
    bad = {i for i, _ in brute_leaks(docs, items)}
    assert sorted([r["doc_id"] for r in left.collect()], key=repr) == sorted([i for i, _ in docs if i not in bad], key=repr)


def test_decontamination_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(make_docs([(1, "a b c d e f")]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_leaks(make_docs([]), some).count() == 0

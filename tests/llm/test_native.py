"""Operators in DataFrame functions: chat, licenses, personal data. Against brute force."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.llm import chat, licenses, pii

CHAT = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
TURNS = [
    (1, 0, "us\\er\nx", "a<|b\\<\\|"), (1, 1, "assistant", "\\\\<|im_end|>é\\"), (1, 1, "assistant", None), (2, None, None, "z"),
    (3, 1, "assistant\\/", "<"), (3, 2, "assistant", ""), (4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (None, 1, "user", "x"),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chat_against_sql(spark):
    got = {r.conv_id: tuple(r) for r in chat.op5(spark, spark.createDataFrame(TURNS, CHAT)).collect()}
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    assert got == {r[0]: r for r in con.sql(chat.ORACLE).fetchall()}
    assert [r.conv_id for r in chat.op5(spark, spark.createDataFrame([], CHAT)).collect()] == [-1]


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see<|", None, None), ("image", None, "a.png", 100000), ("other", "t", None, None)]),
            (1, 1, "assistant", [("audio", None, "b.wav", 2000), ("document", None, "c.pdf", 3), ("image", None, None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_conversations(df.withColumn("formatted", F.lit(1)).drop("formatted")).collect()}
    assert got[1].formatted == "<|im_start|>user\nsee<\\|<|image_0|>t<|im_end|>\n<|im_start|>assistant\n<|audio_1|><|document_2|><|image_3|><|im_end|>\n"
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "a.png", 128), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1536), (3, "image", None, 1)]
    assert got[1].expanded == 128 + 50 + 1536 + 1 and got[2].formatted == "<|im_start|>user\n<|im_end|>\n"
    (span,) = got[1].loss_spans
    assert got[1].formatted[span.start : span.end] == "<|audio_1|><|document_2|><|image_3|>"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(old + 1 if x == y else None for old, y in zip(row, b))], row
        new, old = row
        for j in range(1, len(b) + 1):
            new[j] = max(new[j] or 0, new[j - 1], old[j])
        row = new
    return row[-1]


def license_model(text):
    w = words(text)
    hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    met = []
    for label, t, key in licenses.TEMPLATES:
        t, reach = t.split(), math.ceil(licenses.REACH * len(t.split()))
        for i in range(len(w)):
            block = w[i : i + reach]
            share = len(set(t) & set(block)) / len(set(t))
            if share >= licenses.THRESHOLD - 1e-9 and set(key.split()) <= set(block) and lcs(t, block) >= licenses.THRESHOLD * len(t) - 1e-9:
                met.append((label, share))
    base = sorted({x for _, x in hits})
    every = sorted(set(base) | {x for x, _ in met})
    places = [i for i, _ in hits]
    return (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(base), ",".join(every), 1.0 if hits else max((s for _, s in met), default=0.0))


def test_licenses(spark):
    rnd = random.Random(4)
    texts = ["MIT license mit LICENSE cc by cc by", None, "", "BK mit\nlicense", "\x00mit\x7flicense", "İmit license", "x" * 50_000 + " apache license", " \n\n"]
    pool = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + ["foo", "É", "\n", "the", "of"]
    for _, t, _ in licenses.TEMPLATES:
        for _ in range(12):
            w = [x for x in t.split() if rnd.random() > 0.12]
            for x in rnd.sample(pool, rnd.randrange(4)):
                w.insert(rnd.randrange(len(w) + 1), x)
            if rnd.random() < 0.3:
                i = rnd.randrange(len(w))
                w = w[i:] + w[:i]
            texts.append(rnd.choice(["", "foo " * 30]) + rnd.choice([" ", "\n * "]).join(w) + rnd.choice(["", " foo" * 30]))
    texts.append(" ".join(rnd.choices(pool, k=3000)))
    prose = ["the song was released under a driving license", "released under the driving license", "this library is free software licensed under the gnu general public license"]
    prose.append(" ".join(("filler " * 1200).join(["released ", "under ", "the ", "license "]).split()))
    assert [license_model(t)[5] for t in prose] == ["", "", "gpl", ""]
    assert sum(license_model(t)[5] != license_model(t)[4] for t in texts) > 100  # what the method adds
    texts += prose
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = licenses.op8(spark, spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    model = {i: license_model(t) for i, t in rows}
    for r in got:
        assert tuple(r)[1:-1] == model[r.doc_id][:-1] and abs(r.score - model[r.doc_id][-1]) < 1e-12, r
    assert licenses.op8(spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("lead", ["", " * ", "REM "])
def test_wrapped_licenses(spark, lead):
    import textwrap

    wrap = lambda t, n: "\n".join(lead + x for x in textwrap.wrap(t, n - len(lead)))
    prose = "some other words stand here and say nothing of it\n" * 40
    rows, want = [], {}
    for label, t, _ in licenses.TEMPLATES:
        for width in (40, 72):
            want[len(rows)] = label
            rows.append((len(rows), prose + wrap(t.capitalize(), width) + "\n" + prose))
    words_apart = " \n".join(w + " and so on and so forth" for w in licenses.TEMPLATES[1][1].split())
    backwards = wrap(" ".join(reversed(licenses.TEMPLATES[1][1].split())), 40)
    rows += [(900, words_apart), (901, backwards)]
    got = {r.doc_id: r for r in licenses.op8(spark, spark.createDataFrame(rows, DOCS)).collect()}
    for i, label in want.items():
        assert label in got[i].labels.split(",") and got[i].score == 1.0, rows[i]
    assert (got[900].labels, got[901].labels, got[900].score, got[901].score) == ("", "", 0.0, 0.0)


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def pii_model(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(pii.KINDS) for m in re.finditer(RULES[k], text or "") if valid(k, m[0])]
    joined = ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in sorted(found))
    return tuple(sum(x[1] == i for x in found) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined


def test_pii(spark):
    rnd = random.Random(3)
    letters = "ab1234 .@+-()é\n9"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(90)))) for i in range(400)]
    rows += [(9001, None), (9002, "1" * 5000), (9003, "a" * 3000), (9004, "a@" + "b.c" * 500), (9005, "+1 " + "(2) 3-" * 300), (9006, "1.2.3.4 " * 300 + "a.b@c.d-e@f.gg 4111 1111 1111 1111 +1 (555) 123-4567"), (9001, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))
    got = pii.op4(spark, df)
    assert "Python" not in plan_of(got) and "Pandas" not in plan_of(got)
    model = {i: pii_model(t) for i, t in rows}
    done = got.collect()
    assert len(done) == len(rows)
    for r in done:
        counts, digest, joined = model[r.doc_id]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, digest), r
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.op4(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_pii_model_learns():
    import numpy as np

    x = np.array([[2, 3, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1], [2, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1], [3, 2, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1]], float)
    model = pii.Boosted(x, np.array([90.0, 0, 50]), np.array([90.0, 80, 50]))
    assert model.thresholds[0] == 2.0 and model.thresholds[2] < 1


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_luhn(spark, n):
    rnd = random.Random(n)
    rows = [("".join(rnd.choice("0123456789") for _ in range(n)),) for _ in range(30)]
    for r in spark.createDataFrame(rows, "d string").select("d", pii.luhn(F.col("d")).alias("v")).collect():
        assert r.v == (sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(r.d))) % 10 == 0)


@pytest.mark.parametrize("genuine, base, junk", [(1, 0, 0), (1, 30, 600), (300, 30, 20), (300, 0, 0)])
def test_pii_outside_the_base_rules(spark, genuine, base, junk):
    private = ["please call (555) 123-4567 now", "tel: 022 123 45 67 ok", "mail: jane.doe [at] example [dot] org bye", "contact jo at mail dot example dot com"]
    kinds = ["phone", "phone", "email", "email"]
    rows = [(i * 4 + j, t) for i in range(genuine) for j, t in enumerate(private)]
    rows += [(100_000 + i, f"+1 (555) 123-{4000 + i} and a.b{i}@c.org") for i in range(base)]
    noise = ["order 555 123 4567 came", "call 12 34 56 7 times", "id call=a5551234567b", "we met at home dot and went", "in 2020-01-02 12:30"]
    rows += [(200_000 + i * 5 + j, t) for i in range(max(1, junk)) for j, t in enumerate(noise)]
    got = {r.doc_id: r.spans for r in pii.op4(spark, spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows[: genuine * 4]:
        assert [s.split(":")[0] for s in got[i].split(",")] == [kinds[i % 4]], (t, got[i])
    assert not any(v for k, v in got.items() if k >= 200_000), {v for k, v in got.items() if k >= 200_000}


def test_pii_planted_spans(spark):
    """Spans that the base rules miss are added in their extent; a look-alike is no span; of spans that touch one stays."""
    texts = {
        "please call me at (555) 123-4567 now": "phone:18:32", "mail john [at] example [dot] com": "email:5:32", "john (at) example (dot) com": "email:0:27",
        "phone 555-123-4567": "phone:6:18", "card 4111.1111.1111.1111 here": "card:5:24", "card 4111.1111.1111.1112 here": "", "no 555-123-4567": "",
        "version 4.1.2.300.7 of it": "", "call 12 then 345": "", "": "", "sum 4111.1111.1111.1111 here": "",
        "ip 10.1.2.3 and tel +1 (555) 123-4567": "ip:3:11,phone:20:37",
    }
    texts |= {f"tel: +1 555 {100 + i} 4567, a{i}@b.org, card 4111 1111 1111 1111, host 10.0.0.{i}": None for i in range(12)}
    got = {r.doc_id: r.spans for r in pii.op4(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert {t: got[i] for i, (t, want) in enumerate(texts.items()) if want is not None} == {t: w for t, w in texts.items() if w is not None}


def test_pii_choice_against_brute_force(spark):
    rnd = random.Random(2)
    rows, want = [], set()
    fields = {f: 0 for f in pii.FEATURES}
    for row in range(40):
        spans = []
        for k in range(4):
            at = 0
            while at < 60:  # spans of one kind never touch
                at += rnd.randrange(9)
                end = at + rnd.randrange(1, 12)
                spans.append((k, at, end, rnd.random() < 0.2, rnd.random() < 0.6))
                at = end
        rows += [(row, 0, k, a, b, base, fields | {"digits": int(good)}) for k, a, b, base, good in spans]
        kept = [s for s in spans if s[3]]
        for s in sorted(spans):
            if not s[3] and s[4] and not any(x[1] < s[2] and s[1] < x[2] for x in kept):
                kept.append(s)
        want |= {(row, *s[:4]) for s in kept}
    schema = f"row long, fold int, k int, start long, end long, base boolean, f struct<{', '.join(f'{f}: int' for f in pii.FEATURES)}>"

    class Digits:
        def accepts(self, f):
            return f["digits"] == 1

    got = pii.chosen(spark.createDataFrame(rows, schema), Digits()).select("row", "k", "start", "end", "base").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pii_long_text(spark):
    text = "10.20.30.40 x 4111 1111 1111 1111," * 3000 + "é a@b.c"
    got = pii.op4(spark, spark.createDataFrame([(1, text)], DOCS)).first()
    counts, digest, joined = pii_model(text)
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == counts == (1, 3000, 3000, 0) and got.base_sha256 == digest and got.spans == joined


def test_chat_long_roles_and_texts(spark):
    rnd = random.Random(11)
    roles = ["\\" + "a" * 300_000, "\\" * 70_001 + "/\n" * 9, "<|" * 20_000, *("".join(rnd.choice("\\/|<\na") for _ in range(60)) for _ in range(60))]
    rows = [(i, 0, r, r * 3) for i, r in enumerate(roles)] + [(900, 0, "assistant", "x\\<|im_end|>" * 400_000)]
    made = chat.format_conversations(spark.createDataFrame(rows, CHAT).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect():
        role, text = next(x[2:] for x in rows if x[0] == r.conv_id)
        assert [tuple(x) for x in r.t] == [(role, text)] and r.l == (text if r.conv_id == 900 else "")

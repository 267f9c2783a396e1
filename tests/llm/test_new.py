"""Hard negatives, spelling groups and SentencePiece ids against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from eventloom.llm import hard_negatives, pieces, spelling
from eventloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string"


# hard negatives


def _mined(rows, every, positives=5, negatives=10):
    """Every score, sorted; rows: (vec_id, label, q)."""
    rows = [(v, k, q) for v, k, q in rows if v is not None and k is not None and q is not None and None not in q]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (v, k, q) in enumerate(rows):
        if v % every:
            continue
        same = sorted((-dot(q, r), w, j) for j, (w, l, r) in enumerate(rows) if l == k and j != i)
        other = sorted((-dot(q, r), w, j) for j, (w, l, r) in enumerate(rows) if l != k)
        for s, w, _ in same[:positives]:
            fit = [(n, -t) for t, n, _ in other if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(v, w, i + 1, n, -s, t) for i, (n, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("group", [1, 3, 512])
def test_hard_negatives_against_all_scores(spark, group):
    rnd = random.Random(group)
    rows = [(i, rnd.randrange(3), [rnd.randint(-3, 9) for _ in range(4)]) for i in range(160)]
    rows += [(200 + i, 1, [5, 5, 5, 5]) for i in range(80)]  # one vector many times
    rows += [(10, 2, [1, 2, 3, 4]), (10, 2, [1, 2, 3, 4]), (281, 0, [4]), (282, 1, []), (None, 1, [1, 1, 1, 1]), (290, None, [1]), (291, 1, None), (292, 1, [1, None])]
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").repartition(5)
    got = hard_negatives.mine(df, every=10, group=group)
    assert sorted(map(tuple, got.collect())) == _mined(rows, 10)


def test_hard_negatives_of_large_components(spark):
    rnd = random.Random(7)
    big = 1 << 27
    rows = [(i, i % 2, [rnd.randint(-big, big) for _ in range(6)]) for i in range(60)] + [(100, 0, [1 << 31] * 6), (101, 0, [1 << 62])]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, q array<long>"), every=10)
    assert sorted(map(tuple, got.collect())) == _mined(rows[:-2], 10)


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, q string, part int"
    assert hard_negatives.op11(spark, spark.createDataFrame([], schema)).collect() == []
    rows = [(100, [0.5, 0.25], 1, "x", 0), (1, [0.5, 0.25], 1, "x", 0), (2, [0.25, 0.25], 2, "x", 0), (3, [float("nan"), 1.0], 2, "x", 0), (4, [float("inf"), 1.0], 2, "x", 0), (5, [None, 1.0], 2, "x", 0), (14, [0.25, 0.25], 1, "x", 0)]
    got = hard_negatives.op11(spark, spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(100, 1, 1, 2, 20480, 12288), (100, 1, 2, 14, 20480, 12288)]


def test_bounds_spare_scores():
    """Rows whose interval misses all windows aren't scored again."""
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    centres = rnd.integers(-200, 200, (4, 16))
    rows = np.concatenate([c + rnd.integers(-4, 5, (300, 16)) for c in centres])
    anchors = np.concatenate([c + rnd.integers(-4, 5, (10, 16)) for c in centres])
    label = lambda n: pa.array(np.repeat(np.arange(4), n))
    found = [[int((a * a).sum())] for a in anchors]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), label(10), pa.array(anchors.tolist()), pa.array(found)], names=["uid", "vec_id", "label", "q", "found"])
    group = hard_negatives._Group([batch])
    best = {i: hard_negatives._Best(w, 10) for i, w in enumerate(group.windows)}
    part = pa.RecordBatch.from_arrays([pa.array(range(100, 1300)), pa.array(range(100, 1300)), label(300), pa.array(rows.tolist())], names=["uid", "vec_id", "label", "q"])
    computed = hard_negatives._scored(group, [(0, group.tree(np.arange(40)))], best, False, part)
    assert computed < 0.5 * 40 * 1200
    scores = anchors @ rows.T
    for i in range(40):
        (low, top), other = group.windows[i][0], np.repeat(np.arange(4), 300) != i // 10
        fit = sorted((-s, j + 100) for j, s in enumerate(scores[i]) if other[j] and low <= s <= top)[:10]
        assert [(-s, u) for s, u in zip(best[i].score, best[i].uid)] == fit


# spelling groups


def _words(docs):
    counts = {}
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(docs):
    n = _words(docs)
    out, forms, count = {}, {}, {}
    for w in n:
        near = [v for v in n if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w], count[w] = best if best and n[best] >= 2 * n[w] else None, len(near)
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n[w], count[w], n.get(forms[w]))
    return out


def test_spelling_groups_against_all_pairs(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeeé×") for _ in range(rnd.randint(4, 8))) for _ in range(40)]
    for w in base[:30]:
        for _ in range(4):
            i = rnd.randrange(len(w) + 1)
            base.append(rnd.choice([w[:i] + rnd.choice("abz") + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :]]))
    weights = [1 << rnd.randrange(7) for _ in base]
    docs = [(i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in rnd.choices(base, weights, k=60)) + rnd.choice(["", ",", "!x9"])) for i in range(150)]
    docs += [(None, "nulls nulls nulls"), (500, None), (501, ""), (500, "aaaaa aaaaaa aaaaa-aaaaaa aaaaa aaaaaa " * 3)] + docs[:3]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, n string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(df).collect()}
    assert got == _groups(docs)
    assert max(len(set(_chain(got, w))) for w in got) >= 3  # a root beyond the form


def _chain(found, word):
    while word:
        yield word
        word = found[word][0]


def test_spelling_of_very_long_words_and_no_words(spark):
    a, b = "xy" * 9000, "xy" * 4500 + "z" + "xy" * 4500
    docs = [(i, f"{a} {b} {b}") for i in range(5)]
    got = {r.word: (r.form, r.n_near) for r in spelling.group(spark.createDataFrame(docs, "doc_id long, text string")).collect() if len(r.word) > 17_000}
    assert {w: x for w, x in got.items() if w in (a, b)} == {w: (v[0], v[3]) for w, v in _groups(docs).items() if w in (a, b)}
    assert spelling.group(spark.createDataFrame([], DOCS)).collect() == []


def test_neighbourhoods_are_full_and_distinct():
    values = spelling._values(3)
    rows = np.array([[0, 1, 1, 2], [2, 2, 2, 2]])
    got = [[], []]
    for begin in range(5):  # place by place, as for a very long word
        for at, keys in spelling.neighbour_keys(rows, values, begin, begin + 1):
            for i, k in zip(at, keys):
                got[i].append(int(k))
    for row, keys in zip(rows.tolist(), got):
        near = {tuple(row)}
        for i in range(5):
            near |= {(*row[:i], s, *row[i:]) for s in range(3)}
            if i < 4:
                near |= {(*row[:i], *row[i + 1 :])} | {(*row[:i], s, *row[i + 1 :]) for s in range(3)}
        assert len(keys) == len(set(keys))
        assert set(keys) == {int(spelling.own_keys(np.array([x]), values)[0]) for x in near}


# SentencePiece


def _random_texts(n, own):
    rnd = random.Random(11)
    pieces_, letters = list(own.ids), "ab eh lorti \n\t▁éß中文\U0001f600\x00<>0x41,.;'()-_AB12  "
    for k in range(n):
        if k % 3 == 0:
            yield "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        elif k % 3 == 1:
            yield "".join(rnd.choice(pieces_) for _ in range(rnd.randint(1, 12)))
        else:
            yield " " * rnd.randint(0, 70) + "".join(rnd.choice(pieces_) + " " * rnd.randint(0, 40) for _ in range(rnd.randint(0, 4)))


def test_pieces_are_the_librarys():
    own = pieces.encoder(pieces.MODEL)
    texts = [*_random_texts(6000, own), "a" * 20_000, " " * 20_000, "ab" * 9000, "中" * 9000, "the" * 9000]
    flat, offsets = own.encode(texts)
    flat = flat.tolist()
    assert [flat[a:b] for a, b in zip(offsets, offsets[1:])] == own.model.encode(texts)
    assert [own.merged(t) for t in texts[:300]] == [own.merged(t) if any(p in t for p in own.tied) else own.pieces(t) for t in texts[:300]]


def test_parts_take_no_other_vocabularys_way():
    """Plain words and other parts, new and known, by either way to normalise, are the library's (F1 of round 3)."""
    own = pieces.PieceEncoder(pieces.MODEL)
    texts = ["Word, word. WORD!", "12 a1 don't", "Éclair; éclair", "日本語。a", "x\ty\nz", "", "  two  spaces ", "a\u0301 \ue000\U0001f600"]
    want = own.model.encode(texts)
    for escapes in (True, False):  # it only escapes spaces, so both give the same
        own.escapes = escapes
        own._clear()
        for part in (texts[:3], texts, texts[::-1], texts):  # some parts known and some new, in another order
            flat, offsets = own.encode(part)
            known = dict(zip(texts, want))
            assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [known[t] for t in part]
        assert len(own.known) == len(set(own.known.to_pylist())) == len(own.start) == len(own.uses)


def test_backtracking_goes_back():
    """A vocabulary where the longest match is a dead end."""
    own = object.__new__(pieces.PieceEncoder)
    own.score = {"ab": -3.0, "bc": -1.0, "abcd": -4.0, "cd": -2.0} | dict.fromkeys("abcd", -9.0)
    own.ids = {p: i for i, p in enumerate(own.score)}
    own.tied, own.shorter, own.pairs, own.sound = [], {}, {}, {}
    import ahocorasick

    own.matches = ahocorasick.Automaton()
    for p in own.ids:
        own.matches.add_word(p, len(p))
    own.matches.make_automaton()
    for text in ("abc", "abcd", "ababcdbc", "abbcdcd", "bcbcda"):
        assert own.pieces(text) == own.merged(text)
    assert own.pieces("abcd") == ["a", "bc", "d"]


def test_sentencepiece_rows(spark):
    own = pieces.encoder(pieces.MODEL).model
    rows = [(1, "Two  words,\nand a tab\t", "en"), (2, None, None), (3, "", "x"), (None, "again", "n_tokens"), (1, "Two  words,\nand a tab\t", "en"), (4, "long " * 30_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, pieces.op13(spark, df).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = own.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.op13(spark, df.limit(0)).collect() == []
    back = pieces.decoded(pieces.encoded(df, "doc_id"), "doc_id")
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)


def test_sql_of_hard_negatives(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    rows = QUERIES["op11_hard_negatives"](spark, folder)
    want = duckdb.sql(ORACLES["op11_hard_negatives"])
    order = sorted(rows.columns)
    assert sorted(want.columns) == order
    assert sorted(map(tuple, rows.select(order).collect())) == sorted(want.select(*order).fetchall())

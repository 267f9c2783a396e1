"""Exact and near copies, components; the pipeline's stages."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import components, exact_dedup, rows, simhash
from eventloom.runtime import scratch, written

DOCS = "doc_id long, text string"


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_exact_and_collisions(spark):
    rows = [(3, "a  b"), (1, "a b"), (None, "a\nb"), (1, "a b"), (5, None), (4, ""), (9, " "), (8, "a b")] + [(100 + i, f"text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumn("keep_id", F.lit("clash"))
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted((repr(i), min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    for n in (32, 1):  # one byte: digests collide, and the full bytes must tell texts apart
        got = exact_dedup.deduplicate(df.select("doc_id", "text"), n).collect()
        assert sorted((repr(r.doc_id), r.keep_id, r.group_size) for r in got) == want
        assert sum(r._at == r.keep_at for r in got) == len(groups)
    done = exact_dedup.op9(spark, df)
    assert done.filter("kept").count() == len(groups)
    assert exact_dedup.op9(spark, df.limit(0)).count() == 0


def test_hits_alone_are_fetched(spark, monkeypatch):
    texts = [(i, f"text {i % 500}" if i < 700 else f"own {i}") for i in range(2000)]
    docs, at = rows.located(written(spark.createDataFrame(texts, DOCS).repartition(7), "spread"))
    all_of_them = {r.doc_id: r._at for r in docs.collect()}
    hits = {i for i in range(700) if i < 200 or i >= 500}
    places = spark.createDataFrame([(all_of_them[i],) for i in sorted(hits)], "_at string")
    for words, tables in ((1 << 20, 1), (3, 7), (1, None)):  # ranges of files; then pieces of files
        monkeypatch.setattr(rows, "MOST_WORDS", words)
        got = rows.fetched(docs, at, places, lambda x: x.select("doc_id", "text"))
        assert len(got) == tables if words == 1 << 20 else len(got) >= 7
        assert sorted(r.doc_id for df in got for r in df.collect()) == sorted(hits)
    monkeypatch.setattr(rows, "MOST_WORDS", 2)
    done = exact_dedup.deduplicate(written(spark.createDataFrame(texts, DOCS).repartition(5), "spread")).collect()
    assert all((r.keep_id, r.group_size) == ((r.doc_id % 500, 2) if r.doc_id in hits else (r.doc_id, 1)) for r in done) and len(done) == 2000
    assert rows.fetched(docs, at, places.limit(0), lambda x: x) == []


def test_collisions_over_ranges_of_files(spark, monkeypatch):
    monkeypatch.setattr(rows, "MOST_WORDS", 2)
    df = written(spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], DOCS).repartition(5), "spread")
    assert {(r.doc_id % 300 == r.keep_id, r.group_size) for r in exact_dedup.deduplicate(df, 1).collect()} == {(True, 3)}


def test_stream_goes_on_with_new_files(spark):
    folder, state = scratch(spark, "in"), scratch(spark, "state")

    def add(rows):
        df = spark.createDataFrame(rows, DOCS).withColumn("_at", F.col("doc_id").cast("string"))
        exact_dedup.digests(df).coalesce(1).write.mode("append").parquet(folder)

    add([(5, "x"), (6, "y")])
    stream = exact_dedup.StreamingDeduplicator(spark, folder, state, files_a_batch=1)
    assert sorted((r.keep_id, r.n) for r in stream.run().collect()) == [(5, 1), (6, 1)]
    add([(2, "x"), (9, "x")])
    add([(7, "z")])
    again = exact_dedup.StreamingDeduplicator(spark, folder, state, files_a_batch=1)
    assert sorted((r.keep_id, r.n) for r in again.run().collect()) == [(2, 3), (6, 1), (7, 1)]


def test_fingerprints():
    def model(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rnd = random.Random(1)
    for text in ["", " \n", "One", "one two", "É É é A b", "a a a a a a", *("".join(rnd.choice("aB \n\x1cé\x0b") for _ in range(60)) for _ in range(80))]:
        assert simhash.fingerprint(text.encode()) == model(text), text


def test_near_against_brute_force(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(400)}" for _ in range(400)]
    rows = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 90)))) for i in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(400)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " "), (1000, " ".join(base))]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash")).repartition(3)
    fps = np.array([simhash.fingerprint((t or "").encode()) for _, t in rows], np.uint64)
    root = roots(len(rows), [(i, i + 1 + int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3)])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{int(f):016x}", least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert sorted(map(tuple, simhash.op7(spark, df).collect())) == want
    assert simhash.op7(spark, df.limit(0)).count() == 0
    assert simhash.one_of_each(df).count() == len(least)


@pytest.mark.parametrize("loose", [False, True])
def test_families_against_brute_force(spark, loose):
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(900)}" for _ in range(150)] for _ in range(3)]
    rows = [(i, " ".join(f"w{rnd.randrange(900)}" for _ in range(rnd.randrange(1, 60)))) for i in range(60)] + [(500, None), (501, " "), (502, "one"), (503, "One")]
    for i in range(120):
        w = list(base[i % 3])
        for _ in range(rnd.randrange(1, 12 if not loose else 40)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(900)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    linked = []
    for k in range(4):
        fps = np.array([simhash.fingerprint((t or "").encode(), k, loose) for _, t in rows], np.uint64)
        linked += [(i, i + 1 + int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3)]
    root, least = roots(len(rows), linked), {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    got = simhash.near_duplicates(df, "doc_id", bucket=4, families=4, loose=loose)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == sorted((i, least[r]) for (i, _), r in zip(rows, root))
    assert sorted(r.doc_id for r in simhash.one_of_each(df, families=4, loose=loose).collect()) == sorted(least.values())
    assert len(least) < simhash.one_of_each(df, families=1, loose=loose).count() and simhash.one_of_each(df.limit(0)).count() == 0


def test_loose_fingerprints():
    def model(text, family):
        words = text.lower().split()
        pairs = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []
        out = 0
        for things, bits in ((sorted(set(words)), range(simhash.WORD_BITS)), (pairs, range(simhash.WORD_BITS, 64))):
            h = simhash._mixed(np.array([xxhash.xxh64_intdigest(x, 42) for x in things], np.uint64), family).tolist()
            out |= sum(1 << b for b in bits if 2 * sum(x >> b & 1 for x in h) > len(h))
        return out

    rnd = random.Random(2)
    for text in ["", " ", "One", "a a a a", *(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(20))) for _ in range(60))]:
        assert [simhash.fingerprint(text.encode(), k, True) for k in range(3)] == [model(text, k) for k in range(3)], text


def test_near_copies_are_found_and_clean_documents_stay(spark):
    """Of copies with 80 % or more of their five-word shingles in common, at least nine in ten go; other documents stay."""
    rnd = random.Random(12)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 5000}"
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, copies = [], []
    for i in range(300):
        first = [word() for _ in range(rnd.randrange(120, 500))]
        rows.append((i, " ".join(first)))
        while i % 2 == 0 and (not copies or copies[-1] != 1000 + i):
            w = list(first)
            for _ in range(max(1, len(w) // 60)):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[], [word()], [w[at], word()]])
            a, b = shingles(first), shingles(w)
            if 0.8 <= len(a & b) / len(a | b) < 1:
                copies.append(1000 + i)
                rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in simhash.one_of_each(df, families=simhash.FAMILIES, loose=True).collect()}
    assert set(range(300)) <= kept and sum(i not in kept for i in copies) >= 0.9 * len(copies)


def test_large_buckets_are_cut_exactly(spark):
    rnd = random.Random(1)
    centre, values = rnd.getrandbits(64), set()
    while len(values) < 500:
        v = centre
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 9])):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    v = np.array(sorted(values), np.uint64)
    root = roots(len(v), [(i, i + 1 + int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 3)])
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = components.components(simhash.links(df, bucket=4)).collect()
    sizes = lambda xs: sorted(n for n in np.unique(xs, return_counts=True)[1] if n > 1)
    assert sizes([r.component for r in got]) == sizes(root)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 260), 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rnd = random.Random(2)
    prose = lambda n, a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    rows = [(i, prose(60, "aeilmnorst"), "en", f"s{i % 3}", 0) for i in range(40)] + [(50 + i, prose(60, "äöüßzwkg"), "de", None, None) for i in range(20)]
    rows += [(90, rows[3][1].replace(" ", "  "), "en", "s0", 5), (91, None, None, None, None), (92, "123 !!", "en", "s1", 6), (93, rows[3][1], "en", "s2", 7)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, columns).withColumn("_extra", F.lit(1))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    clean = sorted({r[0] for r in rows} - {91, 92})
    assert kept[0] == sorted([*clean, 0]) and kept[1] == sorted(set(clean) - {90, 93}) and kept[2] == kept[1]
    assert set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]


def test_joins_of_hot_keys(spark, monkeypatch):
    rnd = random.Random(3)
    keys = [7] * 900 + [8] * 300 + [rnd.randrange(100, 400) for _ in range(500)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).filter("k % 5 <> 0")
    for how in ("inner", "left"):
        want = sorted(map(repr, df.join(per, "k", how).select("k", "i", "n", "top").collect()))
        for most in (1, 20_000):
            monkeypatch.setattr(rows, "HOT_KEYS", most)
            assert sorted(map(repr, rows.join_one(df, per, "k", "n", len(keys), how).select("k", "i", "n", "top").collect())) == want


def test_slots_keep_every_key(spark, monkeypatch):
    df = spark.range(5000).withColumn("_w", F.lit("own"))
    some = df.filter("id % 50 = 0")
    for most in (rows.MOST_SLOTS, 1024):
        monkeypatch.setattr(rows, "MOST_SLOTS", most)
        met = rows.that_may_be(df, rows.slot_table(some, "id", 100), "id")
        assert met.columns == df.columns and met.filter("id % 50 = 0").count() == 100 and met.count() < (200 if most > 1024 else 1500)
    assert rows.that_may_be(df, rows.slot_table(df.limit(0), "id", 0), "id").count() == 0


def test_pipeline_fills_in_languages_and_lays_copies_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n_null = docs.filter("lang is null and text rlike '[a-z]'").count()
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    found = corpus_pipeline.language_id(spark, some, "")
    assert found.filter("lang is null").count() == 0 and n_null < found.count() == docs.filter(r"text rlike '\\p{L}'").count()
    both = found.select("doc_id", F.col("lang").alias("now")).join(docs.filter("lang is not null and doc_id % 5 = 0"), "doc_id")
    assert both.filter("now = lang").count() > 0.9 * both.count() > 0
    mixed = written(corpus_pipeline.mix(spark, docs, ""), "mixed")
    again = mixed.groupBy("doc_id").count().filter("count > 1")
    assert again.count() > 50
    pieces = written(corpus_pipeline.packing(spark, mixed, ""), "pieces")
    assert pieces.agg(F.sum("length")).first()[0] == pieces.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces.groupBy("sequence_id", "doc_id", "start", "ids_crc32").count().filter("count > 1").count() == 0

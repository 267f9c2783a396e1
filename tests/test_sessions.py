"""Gaps, clustering, bounds, statistics, names."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.config import Representative
from eventloom.operators import naming, sessions
from eventloom.schemas import CLUSTERS, empty

MEDIA = "file_name string, date timestamp_ntz, is_image boolean, cluster_id long, status string"


def at(text):
    return datetime.fromisoformat(f"2020-{text}")


EIGHT = [
    ("img_001.jpg", at("01-10 14:00"), True), ("img_002.jpg", at("01-10 14:15"), True), ("img_003.jpg", at("01-10 14:30"), True),
    ("img_004.jpg", at("03-15 10:00"), True), ("img_005.jpg", at("03-15 10:20"), True), ("img_006.jpg", at("03-15 10:45"), True),
    ("img_007.jpg", at("06-20 18:00"), True), ("img_008.jpg", at("06-20 19:30"), False),
]


def table(spark, rows):
    """rows: (name, date[, is_image[, status]])"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else True, None, r[3] if len(r) > 3 else "UNKNOWN") for r in rows]
    return spark.createDataFrame(full, MEDIA)


def ids(df):
    return {r.file_name: r.cluster_id for r in df.collect()}


def model(rows, gap, first=1):
    """Row after row: the gap is measured over all rows, the event opened on unknown ones."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or datetime.max, r[0]))
    out, number, before, opened = {}, first - 1, None, False
    for name, date, status in rows:
        wide = before is not None and date is not None and date - before > gap
        if status == "UNKNOWN":
            if not opened or wide:
                number, opened = number + 1, True
            out[name] = number
        before = date
    return out


def test_eight_files(spark):
    df = table(spark, EIGHT)
    got = sessions.cluster(df)
    assert list(ids(got.orderBy("file_name")).values()) == [1, 1, 1, 2, 2, 2, 3, 4]
    assert {r.status for r in got.collect()} == {"NEW_CLUSTER"}
    bounds = {r.cluster_id: (r.start_date, r.end_date, r.is_continuous) for r in sessions.bounds(got).collect()}
    assert bounds[1] == (at("01-10 14:00"), at("01-10 14:30"), True) and len(bounds) == 4
    assert len(set(ids(sessions.cluster(df, gap=timedelta(minutes=10))).values())) == 8
    first = sessions.gaps(df).orderBy("date").first()
    assert first.date_delta is None
    names = {r.cluster_id: (r.target_path, r.new_file_count) for r in naming.named(got).collect()}
    assert names == {
        1: ("new/[2020_01_10]_141500_IC_3_VC_0_", 3), 2: ("new/[2020_03_15]_102000_IC_3_VC_0_", 3),
        3: ("new/[2020_06_20]_180000_IC_1_VC_0_", 1), 4: ("new/[2020_06_20]_193000_IC_0_VC_1_", 1),
    }


def test_boundary_is_strict(spark):
    rows = [("a", at("01-01 10:00")), ("b", at("01-01 11:00")), ("c", at("01-01 12:00:01"))]
    assert ids(sessions.cluster(table(spark, rows))) == {"a": 1, "b": 1, "c": 2}


def test_duplicates_bridge_and_take_gaps(spark):
    a = [("a", at("01-01 10:00")), ("b", at("01-01 10:50"), True, "DUPLICATE"), ("c", at("01-01 11:40"))]
    assert ids(sessions.cluster(table(spark, a))) == {"a": 1, "b": None, "c": 1}
    b = [("a", at("01-01 10:00")), ("b", at("01-01 12:00"), True, "DUPLICATE"), ("c", at("01-01 12:30"))]
    assert ids(sessions.cluster(table(spark, b))) == {"a": 1, "b": None, "c": 1}


def test_null_dates_join_the_last_event(spark):
    rows = [("a", at("01-01 10:00")), ("b", at("01-02 10:00")), ("c", None)]
    assert ids(sessions.cluster(table(spark, rows))) == {"a": 1, "b": 2, "c": 2}
    assert ids(sessions.cluster(table(spark, [("x", None), ("y", None)]))) == {"x": 1, "y": 1}
    assert ids(sessions.cluster(table(spark, []))) == {}


@pytest.mark.parametrize("keyed", [False, True])
def test_random_against_model(spark, keyed, monkeypatch):
    monkeypatch.setattr(sessions, "SINGLE_WINDOW_ROWS", 40)  # several ranges
    rnd = random.Random(5)
    for trial in range(3):
        base, rows = at("01-01 00:00"), []
        for i in range(300):
            date = None if rnd.random() < 0.02 else base + timedelta(minutes=rnd.randrange(4000) // 3 * 3)
            rows.append((f"f{rnd.randrange(10**6):06d}_{i}", date, rnd.choice(["UNKNOWN", "UNKNOWN", "DUPLICATE"])))
        df = spark.createDataFrame([(n, d, True, None, s) for n, d, s in rows], MEDIA)
        gap = timedelta(minutes=12)
        if keyed:
            hot = F.when(F.xxhash64("file_name") % 4 == 0, F.lit(None).cast("string"))  # a null key that is hot too
            got = {}
            df = df.withColumn("k", F.when(F.xxhash64("file_name") % 4 == 0, hot).when(F.xxhash64("file_name") % 16 == 1, "cold").otherwise("hot"))
            done = sessions.cluster(df, "k", gap=gap, first_id=5).collect()
            assert len(done) == len(rows)
            keys = {r.file_name: r.k for r in done}
            for key in set(keys.values()):
                want = model([r for r in rows if keys[r[0]] == key], gap, 5)
                assert {r.file_name: r.cluster_id for r in done if r.k == key and r.cluster_id is not None} == want
            continue
        else:
            got = ids(sessions.cluster(df, gap=gap, first_id=5))
        assert {k: v for k, v in got.items() if v is not None} == model(rows, gap, 5)


def test_next_id_and_union(spark):
    for have, want in (([], 1), ([1, 2, 3], 4), ([1, 5, 10], 11), ([1, 2, None, 5], 6), ([42], 43)):
        assert sessions.next_id(spark.createDataFrame([(x,) for x in have], "cluster_id long")).first().next_id == want
    old = empty(spark, CLUSTERS)
    new = sessions.as_clusters(sessions.bounds(sessions.cluster(table(spark, EIGHT))))
    both = sessions.append(old, new)
    assert both.columns == CLUSTERS.names and both.count() == 4
    assert sessions.new_cluster_ids(sessions.cluster(table(spark, EIGHT))).count() == 4
    used = spark.createDataFrame([(0, "/a", 2), (1, "/b", None), (2, None, 3), (3, "/c", 0)], "cluster_id long, path string, new_file_count long")
    assert [r.cluster_id for r in sessions.expanded_cluster_ids(used).collect()] == [0]


def test_folder_stats(spark):
    rows = [("w", at("01-01 10:00")), ("w", at("01-01 15:00")), ("t", at("01-01 10:00")), ("t", at("01-01 10:30")), ("t", at("01-01 10:50")), ("n", None), ("n", at("01-01 10:00")), ("z", None)]
    df = spark.createDataFrame(rows, "k string, date timestamp_ntz")
    got = {r.k: r for r in sessions.folder_stats(df, "k").collect()}
    assert {k: r.is_time_consistent for k, r in got.items()} == {"w": False, "t": True, "n": False, "z": True}
    assert got["w"].median == at("01-01 12:30") and got["t"].file_count == 3 and got["z"].median is None and got["n"].file_count == 2


def test_representatives(spark):
    rows = [(f"f{i}", at(f"01-01 10:{i:02d}"), i % 2 == 0) for i in range(6)] + [("g", None, True)]
    df = table(spark, rows).withColumn("cluster_id", F.lit(1).cast("long"))
    assert naming.representative(df).first().representative_date == at("01-01 10:03")
    one = naming.representative(df, method=Representative.RANDOM, seed=3).first()
    assert one == naming.representative(df.repartition(3), method=Representative.RANDOM, seed=3).first()
    assert naming.counts(df).first()[1:] == (4, 3, 7)


def test_gaps_and_stats_over_ranges(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    rows = [(f"f{i:04d}", datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(900) * 20) if rnd.random() < 0.95 else None, i % 5 == 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "file_name string, date timestamp_ntz, k boolean")
    dated = sorted((d, n) for n, d, _ in rows if d)
    want = {n: d - p for (d, n), (p, _) in zip(dated[1:], dated)} | {dated[0][1]: None} | {n: None for n, d, _ in rows if not d}
    by_key = {k: sorted((d, n) for n, d, x in rows if d and x == k) for k in (True, False)}
    keyed = {n: d - p for v in by_key.values() for (d, n), (p, _) in zip(v[1:], v)}
    for limit in (sessions.SINGLE_WINDOW_ROWS, 90):
        monkeypatch.setattr(sessions, "SINGLE_WINDOW_ROWS", limit)
        assert {r.file_name: r.date_delta for r in sessions.gaps(df).collect()} == want
        assert {r.file_name: r.date_delta for r in sessions.gaps(df, "k").collect() if r.date_delta is not None} == keyed
        for r in sessions.folder_stats(df, "k").collect():
            mine = [d for d, _ in by_key[r.k]]
            n = len(mine)
            assert r.median == mine[(n - 1) // 2] + (mine[n // 2] - mine[(n - 1) // 2]) // 2 and (r.date_start, r.date_stop) == (mine[0], mine[-1])
            assert r.file_count == sum(x == r.k for *_, x in rows) and not r.is_time_consistent
        assert sessions.folder_stats(df).first().file_count == 1500

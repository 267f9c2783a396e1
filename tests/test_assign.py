"""Attaching to library events; duplicates."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.operators import assign, duplicates, naming, sessions
from eventloom.schemas import CLUSTERS
from tests.test_sessions import EIGHT, MEDIA, at, table


def library(spark, rows):
    """rows: (id, start, end, continuous)"""
    full = [(i, s, e, None, c, f"/lib/2020/[{i}]_event", None, 5, None) for i, s, e, c in rows]
    return spark.createDataFrame(full, CLUSTERS)


def model(files, events, gap):
    bounds = {i: [s, e] for i, s, e, c in events if c and s and e}
    out = {}
    for name, date in sorted(((n, d) for n, d in files if d is not None), key=lambda x: (x[1], x[0])):
        for i in sorted(bounds):
            s, e = bounds[i]
            if s - gap <= date <= e + gap:
                out[name] = i
                bounds[i] = [min(s, date), max(e, date)]
                break
    return out


def got(df):
    return {r.file_name: r.cluster_id for r in df.collect()}


def test_two_events(spark):
    lib = spark.createDataFrame(
        [(0, at("01-10 13:50"), at("01-10 14:40"), at("01-10 14:15"), True, "/lib/2020/[2020_01_10]_event_a", None, 5, None),
         (1, at("03-15 09:50"), at("03-15 10:50"), at("03-15 10:20"), True, "/lib/2020/[2020_03_15]_event_b", None, 3, None)], CLUSTERS)
    media, after = assign.attach(table(spark, EIGHT), lib)
    by = {r.file_name: (r.cluster_id, r.status) for r in media.collect()}
    assert [by[f"img_00{i}.jpg"][0] for i in range(1, 9)] == [0, 0, 0, 1, 1, 1, None, None]
    assert by["img_001.jpg"][1] == "EXISTING_CLUSTER" and by["img_008.jpg"][1] == "UNKNOWN"
    rows = {r.cluster_id: r for r in after.collect()}
    assert [rows[i].new_file_count for i in (0, 1)] == [3, 3]
    assert rows[0].target_path == "existing/[2020_01_10]_event_a" and rows[1].target_path == "existing/[2020_03_15]_event_b"
    assert naming.with_existing_targets(lib).orderBy("cluster_id").first().target_path == "existing/[2020_01_10]_event_a"


def test_chain_overlap_and_limits(spark):
    files = table(spark, [("a", at("01-01 11:00")), ("b", at("01-01 11:50")), ("c", at("01-01 12:45")), ("d", at("01-01 15:00"), True, "DUPLICATE"), ("e", None)])
    lib = library(spark, [(3, at("01-01 10:00"), at("01-01 10:10"), True), (4, at("01-01 10:00"), at("01-01 10:20"), True), (5, at("01-01 11:00"), at("01-01 20:00"), False), (6, None, None, True)])
    assert got(assign.match(files, lib)) == {"a": 3, "b": 3, "c": 3}
    assert got(assign.match_static(files, lib)) == {"a": 3}
    edge = table(spark, [("a", at("01-01 11:10")), ("b", at("01-01 12:10:01"))])
    one = library(spark, [(0, at("01-01 10:00"), at("01-01 10:10"), True)])
    assert got(assign.match(edge, one)) == {"a": 0}


@pytest.mark.parametrize("single,wide,far", [(10**6, 90, 6000), (30, 90, 6000), (7, 600, 1500), (7, 5, 9000), (25, 2, 2500)])
def test_random_against_model(spark, single, wide, far, monkeypatch):
    """Overlapping, chained and lone events; stretches within a range and over several."""
    monkeypatch.setattr(sessions, "SINGLE_WINDOW_ROWS", single)
    rnd = random.Random(single + wide)
    gap = timedelta(minutes=20)
    base = datetime(2020, 1, 1)
    files = [(f"f{i:03d}", base + timedelta(minutes=rnd.randrange(far))) for i in range(220)]
    events = []
    for i in range(25):
        s = base + timedelta(minutes=rnd.randrange(far))
        events.append((i, s, s + timedelta(minutes=rnd.randrange(wide)), rnd.random() < 0.8))
    rnd.shuffle(events)
    found = got(assign.match(table(spark, files), library(spark, events), gap))
    assert found == model(files, events, gap)


def test_one_stretch_over_many_ranges(spark, monkeypatch):
    """No gap at all: the first event grows over everything until a lower one opens."""
    monkeypatch.setattr(sessions, "SINGLE_WINDOW_ROWS", 100)
    base = datetime(2020, 1, 1)
    n = 20_000
    files = spark.range(n).select(
        F.format_string("f%06d", "id").alias("file_name"), (F.lit(base) + F.make_dt_interval(mins="id")).alias("date"), F.lit("UNKNOWN").alias("status")
    )
    at_minute = lambda m: base + timedelta(minutes=m)
    lib = library(spark, [(5, at_minute(100), at_minute(101), True), (3, at_minute(15_000), at_minute(15_001), True), (9, at_minute(0), at_minute(n), True), (7, at_minute(50), at_minute(90), True)])
    counts = {r.cluster_id: r.n for r in assign.match(files, lib, timedelta(minutes=2)).groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {9: 48, 7: 50, 5: 14_900, 3: 5_002}
    plan = assign.match(files, lib, timedelta(minutes=2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_missing_columns(spark):
    from eventloom.errors import MissingColumnError

    with pytest.raises(MissingColumnError, match="start_date"):
        assign.match_static(table(spark, EIGHT), spark.createDataFrame([(1,)], "cluster_id long"))


def test_duplicates_by_stages(spark):
    big = bytes(1 << 20)
    inbox = spark.createDataFrame([("a", bytearray(b"same")), ("b", bytearray(b"none")), ("c", bytearray(big + b"x")), ("d", bytearray(b"size"))], "file_name string, content binary")
    lib = spark.createDataFrame([("/l/e2/y", bytearray(b"same"), 0), ("/l/e1/z", bytearray(b"same"), 1), ("/l/e/big", bytearray(big + b"y"), 0), ("/l/e/w", bytearray(b"abcd"), 0)], "path string, content binary, lib_idx int")
    size = F.octet_length("content").cast("long")
    found = duplicates.duplicates(inbox.withColumn("size", size), lib.withColumn("size", size))
    assert [tuple(r) for r in found.collect()] == [("a", "/l/e2/y")]
    none = F.lit(None).cast("string")
    media = table(spark, [("a", None), ("b", None)]).withColumns({"duplicated_to": none, "duplicated_cluster": none, "target_path": none})
    rows = {r.file_name: r for r in duplicates.with_duplicate_targets(duplicates.mark(media, found)).collect()}
    assert (rows["a"].status, rows["a"].duplicated_cluster, rows["a"].target_path) == ("DUPLICATE", "e2", "duplicated/e2")
    assert rows["b"].status == "UNKNOWN" and rows["b"].target_path is None
    assert MEDIA

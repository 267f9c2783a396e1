"""Destination names, plans, execution, reports, streaming."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.config import Mode
from eventloom.errors import MissingTargetError
from eventloom.operators import naming
from eventloom.plans import file_plan, reports
from eventloom.streaming.sessions import session_bounds


def resolve(spark, names, restore=True, taken=None, target="new/c"):
    df = spark.createDataFrame([(n, target) for n in names], "file_name string, target_path string")
    disk = None if taken is None else spark.createDataFrame([(target, n) for n in taken], "target_path string, name string")
    return {r.file_name: r.dst_name for r in naming.resolved_names(df, restore, disk).collect()}


def test_originals_keep_their_names(spark):
    names = ["IMG_0015.HEIC", "IMG_0016.HEIC", "IMG_0017.HEIC", "IMG_0015-Kopiuj(1).HEIC", "IMG_0016-Kopiuj(1).HEIC", "IMG_0017-Kopiuj(1).HEIC", "IMG_0017-Kopiuj(2).HEIC", "IMG_0017-Kopiuj.HEIC"]
    assert resolve(spark, names) == {n: n for n in names}
    assert resolve(spark, names, restore=False) == {n: n for n in names}


def test_promotion(spark):
    assert resolve(spark, ["IMG_0099-Kopiuj(1).HEIC"]) == {"IMG_0099-Kopiuj(1).HEIC": "IMG_0099.HEIC"}
    two = ["A-Kopiuj(1).HEIC", "A-Kopiuj(2).HEIC"]
    assert resolve(spark, two) == {two[0]: "A.HEIC", two[1]: two[1]}
    assert resolve(spark, two[:1], taken=["a.heic"]) == {two[0]: two[0]}


def test_nested_suffixes_stay_unique(spark):
    for names in (["a.jpg", "a (1).jpg", "a (1) (2).jpg"], ["a (1).jpg", "a (1) (2).jpg"], ["a.jpg", "a (1).jpg", "a (1) (2).jpg", "a (1) (2) (3).jpg"]):
        got = resolve(spark, names)
        assert max(Counter(x.lower() for x in got.values()).values()) == 1


@pytest.mark.parametrize("levels", [4, 6, 8])
def test_deep_suffixes_stay_unique(spark, levels):
    chain = ["a" + " (1)" * i + ".jpg" for i in range(levels + 1)]
    assert resolve(spark, chain) == {n: n for n in chain}
    # without the plain name all move down one level
    assert resolve(spark, chain[1:]) == {n: chain[i] for i, n in enumerate(chain[1:])}
    # below a gap the level above it is free
    got = resolve(spark, chain[:2] + chain[3:])
    assert got == {n: n for n in chain[:2]} | {n: chain[i] for i, n in enumerate(chain[3:], 2)}


def test_random_names_against_model(spark):
    import re

    def plain(n):
        return re.sub(r"( \(\d+\))(?=\.jpg$)", "", n)

    rnd = random.Random(2)
    for _ in range(3):
        names = sorted({f"{rnd.choice('abAB')}{rnd.choice(['', ' (1)', ' (2)', ' (3)'])}.jpg" for _ in range(9)})
        want, claimed = {}, set()
        for copy in (False, True):
            for n in sorted(x for x in names if (plain(x) != x) == copy):
                key = plain(n).lower()
                want[n] = plain(n) if key not in claimed else n
                claimed.add(key)
        assert resolve(spark, names) == want


def media(spark, target="new/cluster1"):
    return spark.createDataFrame([("a.jpg", target), ("b.jpg", target)], "file_name string, target_path string")


def test_plans(spark):
    nop = file_plan.build(media(spark, None), "/in", "/out", Mode.NOP)
    assert [r.op for r in nop.collect()] == ["skip", "skip"] and file_plan.summary(nop) == "Plan: 0 dirs, 0 moves, 0 copies, 2 skips"
    copy = file_plan.build(media(spark), "/in", "/out", Mode.COPY).orderBy("seq").collect()
    assert [(r.op, r.dst) for r in copy] == [("mkdir", "/out/new/cluster1"), ("copy", "/out/new/cluster1/a.jpg"), ("copy", "/out/new/cluster1/b.jpg")]
    move = file_plan.build(media(spark), "/in", "/out", Mode.MOVE)
    assert tuple(file_plan.counters(move).first()) == (1, 2, 0, 0)
    with pytest.raises(MissingTargetError):
        file_plan.build(media(spark, None), "/in", "/out", Mode.COPY)
    held = spark.createDataFrame([("/out/new/cluster1/a.jpg",)], "dst string")
    assert file_plan.conflicts(move, held).count() == 1


@pytest.mark.parametrize("mode", [Mode.COPY, Mode.MOVE])
def test_execution(spark, tmp_path, mode):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in ("a.jpg", "b.jpg"):
        (source / n).write_text(n)
    plan = file_plan.build(media(spark), str(source), str(target), mode)
    file_plan.execute(plan)
    file_plan.execute(plan)  # again: nothing is lost
    assert sorted(p.name for p in (target / "new/cluster1").iterdir()) == ["a.jpg", "b.jpg"]
    assert (target / "new/cluster1/a.jpg").read_text() == "a.jpg"
    assert (source / "a.jpg").exists() == (mode is Mode.COPY)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("[2020_01_02]_a_b", "2020"), ("x", "2020"), ("[2020_01_02]_c", "other")], "name string, year string")
    assert [r.line for r in reports.catalogue(df, year="year").collect()] == ["2020-01-02;a b"]
    reports.write_catalogue(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    items = spark.createDataFrame([(g, f"n{i}") for g in range(20) for i in range(3)], "g int, n string")
    some = naming.one_per_group(items, "g", F.concat("g", "n"), cap=10)
    assert some.count() == 10 and some.select("g").distinct().count() == 10


def test_streaming_sessions_match_batch(spark, tmp_path):
    rows = [(1, f"2020-01-01 10:{m:02d}:00") for m in (0, 10, 20, 31)] + [(2, "2020-01-01 10:00:00"), (1, "2020-01-09 00:00:00"), (2, "2020-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    batch = session_bounds(df, "user_id", gap=timedelta(minutes=10))
    assert sorted((r.user_id, r.file_count) for r in batch.collect()) == [(1, 1), (1, 1), (1, 3), (2, 1), (2, 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session_bounds(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", gap=timedelta(minutes=10))
    q = stream.writeStream.format("memory").queryName("sessions_test").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.table("sessions_test").collect()
    assert sorted((r.user_id, r.file_count) for r in done) == [(1, 1), (1, 3), (2, 1)]  # the last ones wait for the watermark


def test_targets_leave_large_events_where_they_are(spark, monkeypatch):
    """Files of a large event, and files without one, aren't gathered; targets are those of the plain join."""
    from eventloom.operators import sessions

    monkeypatch.setattr(sessions, "SINGLE_WINDOW_ROWS", 100)
    event = F.when(F.col("id") % 10 < 5, 1).when(F.col("id") % 10 < 8, None).otherwise(F.col("id")).cast("long")
    media = spark.range(0, 2000, 1, 8).select(F.concat(F.lit("f"), "id").alias("file_name"), event.alias("cluster_id"), F.lit("old").alias("target_path"))
    clusters = spark.range(0, 1500).select(F.col("id").alias("cluster_id"), F.concat(F.lit("new/"), "id").alias("target_path"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = naming.with_targets(media, clusters).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    number = lambda i: 1 if i % 10 < 5 else None if i % 10 < 8 else i
    want = [(f"f{i}", number(i), f"new/{number(i)}" if number(i) is not None and number(i) < 1500 else None) for i in range(2000)]
    assert sorted((r.file_name, repr(r.cluster_id), r.target_path) for r in rows) == sorted((f, repr(c), t) for f, c, t in want)
    for large in (1, None):
        assert len({r.p for r in rows if r.cluster_id == large}) == 8


def test_a_plan_computes_its_media_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(name):
        seen.add(1)
        return name

    media = spark.range(60).select(F.udf(told)(F.concat(F.lit("f"), "id")).alias("file_name"), F.concat(F.lit("t"), F.col("id") % 3).alias("target_path"))
    plan = file_plan.build(media, "/in/", "/out//", Mode.COPY)
    assert sorted((r.op, r.src or "", r.dst) for r in plan.collect()) == sorted(
        [("mkdir", "", f"/out/t{i}") for i in range(3)] + [("copy", f"/in/f{i}", f"/out/t{i % 3}/f{i}") for i in range(60)]
    )
    assert seen.value == 60

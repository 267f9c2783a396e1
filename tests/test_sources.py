"""Trees with pushed filters, folders as a stream, thumbnails."""

import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from eventloom.config import load, override
from eventloom.sources import arrivals as arr, media as med, tree as tr
from eventloom.sources.listing import listing
from eventloom.streaming.imports import IncrementalImport


@pytest.fixture
def shelf(tmp_path):
    for year in ("2019", "2020"):
        for event in ("a", "b"):
            for deep in ("", "raw/old"):
                folder = tmp_path / "shelf" / year / event / deep
                folder.mkdir(parents=True, exist_ok=True)
                for name in ("x.JPG", "y.mov", "none", ".ini"):
                    (folder / name).write_bytes(name.encode() * (2 if year == "2020" else 1))
    (tmp_path / "shelf" / "loop").symlink_to(tmp_path / "shelf" / "2019")
    return str(tmp_path / "shelf")


CASES = [
    "extension = 'jpg'", "extension in ('mov', 'ini') and not is_dir", "depth <= 1", "depth < 2 and is_dir", "depth = 2", "not is_dir and size > 6",
    "parent like '{0}/2020/a%'", "parent = '{0}/2019/b/raw/old'", "path like '{0}/2020/b/raw/%' and extension = 'mov'", "path = '{0}/2019/a/none'",
    "extension is null", "not (extension = 'jpg')", "lib_idx = 1", "name like '%one%'", "parent like '{0}/20%' and depth >= 3", "size is null",
    "extension = 'jpg' or depth = 0", "m_date > '2000-01-01' and extension = 'jpg'", "extension <=> null", "parent like '{0}'",
]


def test_pushed_filters_change_no_result(spark, shelf):
    whole = tr.tree(spark, [shelf, shelf + "/2019"])
    kept = spark.createDataFrame(whole.collect(), tr.TREE)
    plain = listing(spark, [shelf, shelf + "/2019"], recursive=True)
    assert sorted(map(tuple, kept.drop("depth", "extension").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    for case in CASES:
        where = case.format(shelf)
        want = sorted(map(repr, kept.filter(where).collect()))
        assert sorted(map(repr, tr.tree(spark, [shelf, shelf + "/2019"], where).collect())) == want, case
    # one result under several filters, in one plan and in plans one after the other
    flat = tr.tree(spark, [shelf], "depth <= 2 or is_dir")
    n = flat.count()
    both = flat.filter("is_dir").unionByName(flat.filter("not is_dir")).unionByName(flat.filter("extension = 'jpg'"))
    assert both.count() == n + flat.filter("extension = 'jpg'").count() and flat.count() == n == flat.filter("is_dir or depth >= 0").count()


def test_plan_shows_pushed_filters(spark, shelf):
    found = tr.tree(spark, [shelf], "extension = 'jpg' and depth <= 1 and m_date is not null")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "media_tree" in x)
    assert "extension" in pushed and "depth" in pushed.split("PushedFilters")[-1] and "(extension" not in plan.replace(pushed, ""), plan
    assert found.count() == 0 and tr.tree(spark, [shelf + "/missing"]).count() == 0


def opened(monkeypatch, shelf, *filters):
    """(folders opened, rows) of a walk with pushed filters."""
    seen, scan = [], os.scandir

    def counting(folder):
        seen.append(folder)
        return scan(folder)

    monkeypatch.setattr(os, "scandir", counting)
    reader = tr.TreeReader({"roots": json.dumps([shelf])})
    assert list(reader.pushFilters(list(filters))) == []
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.setattr(os, "scandir", scan)
    return {os.path.relpath(x, shelf) for x in seen}, rows


@pytest.mark.parametrize("subtrees", [1, 3, 256])
def test_subtrees_that_are_ruled_out_are_not_opened(monkeypatch, shelf, subtrees):
    monkeypatch.setattr(tr, "SUBTREES", subtrees)
    everything, rows = opened(monkeypatch, shelf)
    assert len(everything) == 1 + 2 * (1 + 2 * 3) and len(rows) == 3 + 2 * (2 + 2 * (4 + 1 + 1 + 4))
    assert opened(monkeypatch, shelf, ds.LessThanOrEqual(("depth",), 1))[0] == {".", "2019", "2020"}
    walked, rows = opened(monkeypatch, shelf, ds.StringStartsWith(("parent",), shelf + "/2020/a"))
    assert walked == {".", "2020", "2020/a", "2020/a/raw", "2020/a/raw/old"} and len(rows) == 10
    walked, rows = opened(monkeypatch, shelf, ds.EqualTo(("parent",), shelf + "/2019/b"))
    assert walked == {".", "2019", "2019/b"} and len(rows) == 5
    assert opened(monkeypatch, shelf, ds.EqualTo(("lib_idx",), 4)) == (set(), [])


def taken(spark, folder, checkpoint, **options):
    """Names that one more run of the stream brings."""
    got = []
    rows = arr.arrivals(spark, [folder], **options)
    rows.writeStream.foreachBatch(lambda batch, _: got.extend(r.name for r in batch.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(got)


def test_each_file_arrives_once(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    folder.mkdir()
    for name in ("a.jpg", "b.jpg"):
        (folder / name).write_bytes(b"1")
    (folder / "deep").mkdir()
    (folder / "deep" / "x.jpg").write_bytes(b"1")
    assert taken(spark, str(folder), checkpoint) == ["a.jpg", "b.jpg"]
    assert taken(spark, str(folder), checkpoint) == []
    (folder / "c.jpg").write_bytes(b"1")
    os.utime(folder / "c.jpg", (1_000_000_000, 1_000_000_000))  # an old picture that comes late
    os.chmod(folder / "a.jpg", 0o600)  # no new file
    assert taken(spark, str(folder), checkpoint) == ["c.jpg"]
    assert taken(spark, str(folder), str(tmp_path / "other"), settle=3600) == []


def test_arrivals_of_one_instant(monkeypatch):
    """Offsets and ranges against a listing in which times are equal; ranges that are read again give the same."""
    files = {}
    stat = lambda at: os.stat_result([0o100644, 0, 0, 1, 0, 0, 1, at, at, at], {"st_mtime": at, "st_ctime": at, "st_ctime_ns": at})
    monkeypatch.setattr(arr, "_files", lambda folder: [(f"/in/{n}", n, stat(at)) for n, at in files.items()])
    reader = arr.ArrivalsReader({"roots": '["/in"]'})
    offset, came, ranges = reader.initialOffset(), [], []
    for new in ({"a": 5, "b": 5}, {}, {"c": 5}, {"d": 9, "e": 5, "f": 9}, {"g": 9}, {"h": 10}):
        files.update(new)
        end = json.loads(json.dumps(reader.latestOffset()))
        rows = [r[1] for p in reader.partitions(offset, end) for r in reader.read(p)]
        came += rows
        ranges.append((offset, end, rows))
        offset = end
        if len(ranges) == 3:
            reader = arr.ArrivalsReader({"roots": '["/in"]'})  # a restart
    assert sorted(came) == list("abcdefgh")  # e shares the instant of a, b and c, and comes in the batch after them
    for start, end, rows in ranges[3:]:
        assert [r[1] for p in reader.partitions(start, end) for r in reader.read(p)] == rows


def test_import_of_a_folder_that_fills_up(spark, tmp_path):
    config = override(load(True), inbox=str(tmp_path / "in"), outbox=str(tmp_path / "out"), libraries=["/lib"], gap=timedelta(minutes=15))
    (tmp_path / "in").mkdir()
    own = IncrementalImport(spark, str(tmp_path / "import"), config)
    base = datetime(2020, 1, 1, 12)
    for k, minutes in enumerate(([0, 5], [10, 300], [20])):
        for m in minutes:
            path = tmp_path / "in" / f"f{m}.jpg"
            path.write_bytes(b"x")
            os.utime(path, ((base + timedelta(minutes=m)).timestamp(),) * 2)
        (tmp_path / "in" / f"note{k}.txt").write_bytes(b"no media")
        files = med.media_table(arr.arrivals(spark, [config.inbox]), config).drop("path", "parent")
        own.start(files, availableNow=True).awaitTermination()
    ids = {r.file_name: r.cluster_id for r in own.media().collect()}
    assert set(ids) == {"f0.jpg", "f5.jpg", "f10.jpg", "f20.jpg", "f300.jpg"}
    assert ids["f0.jpg"] == ids["f5.jpg"] == ids["f10.jpg"] == ids["f20.jpg"] != ids["f300.jpg"]
    assert sorted(r.file_count for r in own.clusters().collect()) == [1, 4]


def test_thumbnails_as_columns(spark, shelf, monkeypatch):
    files = listing(spark, [shelf + "/2019/a"]).filter("not is_dir").withColumn("Thumbnail", F.lit("clash"))
    rows = {r.name: r for r in med.with_image_tags(med.with_thumbnails(files, side=20, make=lambda content, side: content[:1] * side * 9 if content != b"none" else None)).collect()}
    assert bytes(rows["x.JPG"].thumbnail) == b"x" * 180 and rows["none"].thumbnail is None and rows["none"].image_tag is None
    from eventloom.functions.decode import image_tag

    assert all(r.image_tag == image_tag(r.thumbnail and bytes(r.thumbnail)) for r in rows.values())
    gone = files.withColumn("path", F.lit(shelf + "/missing"))
    assert [r.thumbnail for r in med.with_thumbnails(gone).collect()] == [None] * 4  # nor does a text make an image
    assert med.with_thumbnails(files.limit(0)).count() == 0


def test_command_line_leaves_no_scratch(spark, shelf, tmp_path, monkeypatch):
    from eventloom import cli, runtime

    dropped = []
    monkeypatch.setattr(runtime, "drop_scratch", lambda s: dropped.append(s) or True)
    assert cli.main(["refresh", "-l", shelf]) == 0 and len(dropped) == 1
    with pytest.raises(Exception):
        cli.main(["sample", "-l", shelf, "-y", "no year", "-o", "/proc/none/here"])
    assert len(dropped) == 2

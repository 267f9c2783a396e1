"""Real files: listing, decoders, library, a whole import, configuration, command line."""

import io
import os
import struct
from datetime import datetime, timedelta

import pytest

from eventloom import cli, config as conf
from eventloom.functions import decode
from eventloom.plans import importing
from eventloom.sources import library as lib, media as med
from eventloom.sources.catalogue import Catalogue
from eventloom.sources.listing import listing


def jpeg(date=b"2018:05:06 07:08:09\x00", order="<"):
    head = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", 8)
    top = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, 26) + struct.pack(order + "I", 0)
    inner = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, len(date), 44) + struct.pack(order + "I", 0)
    tiff = head + top + inner + date
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\x00\x00" + tiff + b"\xff\xd9", tiff


def mov(seconds, kind=b"mvhd"):
    header = kind + struct.pack(">I", 0) + struct.pack(">I", seconds) + bytes(90)
    return struct.pack(">I4s", 16, b"ftyp") + bytes(8) + struct.pack(">I4s", len(header) + 12, b"moov") + struct.pack(">I", len(header) + 4) + header


def test_decoders():
    for order in "<>":
        whole, tiff = jpeg(order=order)
        assert decode.exif_date(whole) == decode.exif_date(tiff) == "2018:05:06 07:08:09"
    assert decode.exif_date(b"plain text") is None and decode.exif_date(b"Exif\x00\x00II*\x00\xff") is None and decode.exif_date(b"") is None
    assert decode.quicktime_seconds(io.BytesIO(mov(3_600_000_000))) == 3_600_000_000
    for bad in (b"", mov(5, b"cmov"), mov(5)[:30], struct.pack(">I4s", 3, b"free")):
        assert decode.quicktime_seconds(io.BytesIO(bad)) is None
    assert len(decode.file_hash(io.BytesIO(b"x" * 300_000))) == 40 and len(decode.file_hash(io.BytesIO(b"x"), "md5")) == 32
    assert decode.file_hash(io.BytesIO(b"abcdef"), "md5", 3) == decode.file_hash(io.BytesIO(b"abc"), "md5")
    assert decode.image_tag(None) is None and decode.image_tag(b"x").startswith("<img src=")


def box(kind, content):
    return struct.pack(">I4s", len(content) + 8, kind) + content


def heic(tiff, gap, version=0):
    """A HEIC skeleton whose Exif item stands ``gap`` bytes behind the item tables."""
    infe = box(b"infe", struct.pack(">IHH4s", 2 << 24, 1, 0, b"hvc1")) + box(b"infe", struct.pack(">IHH4s", 2 << 24, 2, 0, b"Exif"))
    iinf = box(b"iinf", struct.pack(">IH", 0, 2) + infe)
    item = struct.pack(">I", 6) + b"Exif\x00\x00" + tiff
    method = struct.pack(">H", 0) if version else b""
    ftyp = box(b"ftyp", b"heic" + bytes(8))

    def meta(at):
        rows = b"".join(struct.pack(">H", i) + method + struct.pack(">HHII", 0, 1, a, n) for i, a, n in ((1, 9, 9), (2, at, len(item))))
        return box(b"meta", bytes(4) + iinf + box(b"iloc", struct.pack(">IBBH", version << 24, 0x44, 0, 2) + rows))

    return ftyp + meta(len(ftyp) + len(meta(0)) + 8 + gap) + box(b"mdat", bytes(gap) + item)


@pytest.mark.parametrize("gap", [0, 3 << 20])
def test_dates_far_into_a_file(spark, tmp_path, gap):
    date = b"2018:05:06 07:08:09\x00"
    for order, name in (("<", "a.dng"), (">", "b.tif")):
        at = 8 + gap
        tiff = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", at) + bytes(gap)
        tiff += struct.pack(order + "HHHIII", 1, 0x8769, 4, 1, at + 18, 0) + struct.pack(order + "HHHIII", 1, 0x9003, 2, len(date), at + 36, 0) + date
        (tmp_path / name).write_bytes(tiff)
    (tmp_path / "c.heic").write_bytes(heic(jpeg()[1], gap))
    (tmp_path / "d.HEIC").write_bytes(heic(jpeg(order=">")[1], gap, version=1))
    more = (b"\xff\xe2" + struct.pack(">H", 65_000) + bytes(64_998)) * (gap // 65_000)
    (tmp_path / "e.jpg").write_bytes(b"\xff\xd8" + more + jpeg()[0][2:])
    (tmp_path / "f.heic").write_bytes(heic(jpeg()[1], gap)[:-150])
    got = {r["name"]: r.exif_date for r in med.with_dates(listing(spark, [str(tmp_path)])).collect()}
    assert got == {n: datetime(2018, 5, 6, 7, 8, 9) for n in ("a.dng", "b.tif", "c.heic", "d.HEIC", "e.jpg")} | {"f.heic": None}


def put(path, data, when):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (when.timestamp(), when.timestamp()))


@pytest.fixture
def world(tmp_path):
    inbox, out, shelf = tmp_path / "inbox", tmp_path / "out", tmp_path / "shelf"
    day = datetime(2020, 1, 10, 14)
    put(inbox / "IMG_1.jpg", jpeg()[0], day)
    put(inbox / "_MG_0001.CR2", b"raw1", day)
    put(inbox / ".hid.jpg", b"hidden", day + timedelta(minutes=5))
    put(inbox / "clip.MOV", mov(2082844800 + int(datetime(2020, 1, 10, 14, 30).timestamp())), day + timedelta(days=9))
    put(inbox / "old.MOV", mov(100), day)
    put(inbox / "twin.jpg", b"twin", day + timedelta(days=30))
    put(inbox / "note.txt", b"no", day)
    put(inbox / "deep" / "x.jpg", b"deep", day)
    put(shelf / "2020" / "[2020_01_10]_ev" / "a.jpg", b"first", day + timedelta(minutes=40))
    put(shelf / "2020" / "[2020_01_10]_ev" / "b.jpg", b"twin", day + timedelta(minutes=50))
    (shelf / "2020" / "[2020_02_02]_bare").mkdir(parents=True)
    put(shelf / "2020" / "[2020_03_03]_doc" / "readme.txt", b"text", day)
    return inbox, out, shelf


def configured(world, **changes):
    inbox, out, shelf = world
    return conf.override(conf.load(True), inbox=inbox, outbox=out, libraries=[shelf], **changes)


def test_listing_sees_everything(spark, world):
    inbox, _, shelf = world
    names = {r.name for r in listing(spark, [str(inbox)]).filter("not is_dir").collect()}
    assert names == {"IMG_1.jpg", "_MG_0001.CR2", ".hid.jpg", "clip.MOV", "old.MOV", "twin.jpg", "note.txt"}
    deep = listing(spark, [str(shelf), str(shelf / "missing")], recursive=True)
    assert deep.filter("is_dir").count() == 4 and deep.filter("not is_dir").count() == 3


def test_inbox_table(spark, world):
    rows = {r.file_name: r for r in med.inbox(spark, configured(world), hashes=True).collect()}
    assert set(rows) == {"IMG_1.jpg", "_MG_0001.CR2", ".hid.jpg", "clip.MOV", "old.MOV", "twin.jpg"}
    assert rows["IMG_1.jpg"].date == datetime(2018, 5, 6, 7, 8, 9) and rows["clip.MOV"].date == datetime(2020, 1, 10, 14, 30)
    assert rows["old.MOV"].date is None and not rows["old.MOV"].is_image and len(rows["twin.jpg"].hash_value) == 40


def test_library_and_ini(spark, world):
    config = configured(world, use_existing=True, deep_scan=True)
    clusters, bare = lib.clusters(spark, config)
    rows = clusters.collect()
    assert [(r.cluster_id, r.file_count, r.is_continuous) for r in rows] == [(0, 2, True)]
    assert [r.path.rsplit("/", 1)[1] for r in bare.collect()] == ["[2020_02_02]_bare"]
    assert not list(world[2].rglob(".cluster.ini"))  # looking writes nothing
    lib.refresh(spark, [str(world[2])], config)
    event = world[2] / "2020" / "[2020_01_10]_ev"
    assert "is_continuous = True" in (event / ".cluster.ini").read_text()
    kept = lib.read_ini(spark.createDataFrame([(str(event),)], "path string")).first()
    assert kept.start_date == datetime(2020, 1, 10, 14, 40) and kept.median == datetime(2020, 1, 10, 14, 45) and kept.file_count == 2
    (event / ".cluster.ini").write_text("[Range]\nstart_date = 2020-01-01 12:00:00.5\nend_date = 2020-01-02 12:00:00\nis_continuous = True\nmedian = 2020-01-01 18:00:00.123456\nfile_count = 10\n")
    kept = lib.read_ini(spark.createDataFrame([(str(event),)], "path string")).first()
    assert kept.start_date is None and kept.median == datetime(2020, 1, 1, 18, 0, 0, 123456) and kept.file_count == 10
    assert lib.clusters(spark, configured(world))[0].count() == 0


def test_whole_import(spark, world):
    config = configured(world, use_existing=True, skip_duplicates=True, copy=True)
    result = importing.run(spark, config)
    rows = {r.file_name: (r.status, r.target_path) for r in result.media.collect()}
    assert rows["twin.jpg"] == ("DUPLICATE", "duplicated/[2020_01_10]_ev")
    assert rows["clip.MOV"] == ("EXISTING_CLUSTER", "existing/[2020_01_10]_ev") and rows[".hid.jpg"][0] == "EXISTING_CLUSTER"
    assert rows["IMG_1.jpg"] == ("NEW_CLUSTER", rows["IMG_1.jpg"][1]) and rows["IMG_1.jpg"][1].startswith("new/[NaT_]_")  # its middle file has no date
    assert (world[1] / "existing/[2020_01_10]_ev/clip.MOV").exists() and (world[1] / "duplicated/[2020_01_10]_ev/twin.jpg").exists()
    assert "1 duplicate" in result.summary()


def test_year_reports(spark, world, tmp_path):
    from eventloom.plans import reports

    shelf = world[2]
    put(shelf / "2020" / "[2020_05_05]_two" / "a.jpg", b"again", datetime(2020, 5, 5))
    put(shelf / "2020" / "[2020_06_06]_x_y" / "c.HEIC", b"heic", datetime(2020, 6, 6))
    lines = {r.line for r in reports.library_catalogue(spark, str(shelf)).collect()}
    assert lines == {"2020-01-10;ev", "2020-02-02;bare", "2020-03-03;doc", "2020-05-05;two", "2020-06-06;x y"}
    sample = reports.year_sample(spark, str(shelf), 2020)
    rows = sample.collect()
    assert {r.name for r in rows} <= {"a.jpg", "b.jpg", "c.HEIC"} and len({r.name for r in rows}) == len(rows) >= 2
    assert reports.year_sample(spark, str(shelf), 2020, cap=1).count() == 1
    reports.export_sample(sample, str(tmp_path / "sample"))
    assert {p.name for p in (tmp_path / "sample").iterdir()} == {r.name for r in rows}


def test_dry_run_and_empty_inbox(spark, world, tmp_path):
    result = importing.run(spark, configured(world, no_operation=True))
    assert result.plan.filter("op = 'skip'").count() == 6 and not world[1].exists()
    (tmp_path / "void").mkdir()
    nothing = importing.run(spark, conf.override(configured(world), inbox=tmp_path / "void"))
    assert nothing.media.count() == 0 and nothing.clusters.count() == 0 and nothing.plan.count() == 0


def test_configuration(monkeypatch, tmp_path):
    for system in ("nt", "posix"):
        assert conf.load(True, system).mode is conf.Mode.COPY and conf.load(False, system).mode is conf.Mode.MOVE
    assert conf.load(False, "nt").inbox.startswith("C:") and conf.load(True, "posix").libraries == ("./library",)
    base = conf.load(True)
    assert base.gap == timedelta(minutes=60) and base["mode"] is conf.Mode.COPY and not base.use_existing
    with pytest.raises(KeyError):
        base["none"]
    env = tmp_path / ".env"
    env.write_text("EVENTLOOM_GAP_MINUTES=5\n# comment\nEVENTLOOM_MODE=nop\n")
    monkeypatch.setenv("EVENTLOOM_MODE", "copy")
    monkeypatch.setenv("EVENTLOOM_IMAGE_EXTENSIONS", '[".JPG", ".PNG"]')
    got = conf.load(False, env_file=str(env))
    assert got.gap == timedelta(minutes=5) and got.mode is conf.Mode.COPY and got.image_extensions == (".jpg", ".png")
    assert conf.override(base, copy=True, no_operation=True).mode is conf.Mode.NOP
    assert conf.override(base, gap=timedelta(1), unknown=3).gap == timedelta(1)
    for flag in ("skip_duplicates", "use_existing"):
        with pytest.raises(ValueError):
            conf.override(base, libraries=[], **{flag: True})
    assert conf.library_arguments(None) == [] and conf.library_arguments(["a"]) == ["a"]
    with pytest.raises(TypeError):
        conf.library_arguments("a")


def test_command_line():
    args = cli.parser().parse_args("import -i in -o out -w a -w b -n -y -f -d -c -r -t -g 15".split())
    got = cli.configured(args)
    assert (got.inbox, got.outbox, got.libraries, got.mode) == ("in", "out", ("a", "b"), conf.Mode.NOP)
    assert got.deep_scan and got.skip_duplicates and got.use_existing and got.restore_names and got.gap == timedelta(minutes=15)
    assert cli.parser().parse_args(["refresh", "-l", "x", "-f"]).force


def test_schemas(spark):
    from eventloom import schemas as S
    from eventloom.errors import MissingColumnError, MissingTargetError

    df = S.empty(spark, S.CLUSTERS)
    assert S.require_columns(df, S.CLUSTERS.names) is df and S.reject_others(df, S.CLUSTERS.names) is df
    with pytest.raises(MissingColumnError, match="missing column: nope"):
        S.require_columns(df, ["cluster_id", "nope"])
    with pytest.raises(ValueError, match="unexpected column"):
        S.reject_others(df, ["cluster_id"])
    assert "target" in str(MissingTargetError())


def test_config_items_and_older_names():
    c = conf.get_development_config("posix")
    c["seed"] = 5
    assert c["seed"] == c.seed == 5 and conf.get_proper_mode_config(False) == conf.get_default_config()
    with pytest.raises(KeyError):
        c["nothing"] = 1
    changed = conf.override_config_with_cli_params(c, inbox_dir="in", watch_dir_list=["a"], drop_duplicates=True, copy_mode=None)
    assert (changed.inbox, changed.libraries, changed.skip_duplicates, changed.mode) == ("in", ("a",), True, c.mode)


def disguised(path, data):
    """Other bytes of the same length under the same times: what only a reader of the file would notice."""
    old = os.stat(path)
    assert len(data) == old.st_size
    path.write_bytes(data)
    os.utime(path, ns=(old.st_atime_ns, old.st_mtime_ns))


def test_catalogue_spares_unchanged_folders(spark, world, tmp_path):
    shelf = world[2]
    put(shelf / "2020" / "[2020_05_05]_two" / "a.jpg", jpeg()[0], datetime(2020, 5, 5))
    put(shelf / "2020" / "[2020_06_06]_three" / "b.jpg", jpeg()[0], datetime(2020, 6, 6))
    config = configured(world, use_existing=True, catalogue=str(tmp_path / "table"))
    seen = lambda c=config: {r.path.rsplit("_", 1)[1]: (r.start_date, r.file_count) for r in lib.clusters(spark, c)[0].collect()}
    table = Catalogue(spark, config.catalogue)
    assert table.version() == 0 and table.read().count() == 0
    dry = conf.override(config, no_operation=True)
    first = seen(dry)
    assert table.version() == 0  # a dry run writes no version
    assert first["two"] == first["three"] == (datetime(2018, 5, 6, 7, 8, 9), 1) and seen() == first and table.version() == 1
    other = jpeg(b"2019:09:09 09:09:09\x00")[0]
    disguised(shelf / "2020" / "[2020_05_05]_two" / "a.jpg", other)
    disguised(shelf / "2020" / "[2020_06_06]_three" / "b.jpg", other)
    assert seen() == first and table.version() == 1  # no file was opened, nothing was written
    put(shelf / "2020" / "[2020_05_05]_two" / "c.jpg", jpeg()[0], datetime(2020, 5, 6))
    now = seen()
    assert now == first | {"two": (datetime(2018, 5, 6, 7, 8, 9), 2)} and table.version() == 2
    rows = {r.path.rsplit("_", 1)[1]: r.end_date for r in table.read().collect()}
    assert rows["two"].year == 2019 and rows["three"].year == 2018  # the changed folder was opened, the other one not
    assert seen(conf.override(config, deep_scan=True))["three"] == (datetime(2019, 9, 9, 9, 9, 9), 1)
    (shelf / "2020" / "[2020_05_05]_two" / "a.jpg").unlink()
    (shelf / "2020" / "[2020_05_05]_two" / "c.jpg").unlink()
    assert "two" not in seen() and table.versions() == [3, 4]


def test_inis_with_a_catalogue(spark, world, tmp_path):
    """An ini is taken where it fits its folder; a stale one is found."""
    event = world[2] / "2020" / "[2020_01_10]_ev"
    text = "[Range]\nstart_date = 2001-01-01 12:00:00\nend_date = 2001-01-02 12:00:00\nis_continuous = True\nmedian = 2001-01-01 18:00:00\nfile_count = {}\n"
    years = lambda c: [r.start_date.year for r in lib.clusters(spark, c)[0].collect()]
    plain = configured(world, use_existing=True)
    (event / ".cluster.ini").write_text(text.format(7))
    tree = lib.scan(spark, [str(world[2])])
    assert lib.stale(tree, lib.read_ini(tree.events), plain).count() == 1
    assert years(plain) == [2001]  # without a catalogue it holds as it is
    assert years(conf.override(plain, catalogue=str(tmp_path / "a"))) == [2020]
    (event / ".cluster.ini").write_text(text.format(2))
    assert years(conf.override(plain, catalogue=str(tmp_path / "b"))) == [2001]
    put(event / "a.jpg", b"first", datetime.now() + timedelta(days=1))
    assert years(conf.override(plain, catalogue=str(tmp_path / "c"))) == [2020]


def test_inis_spare_decoding(spark, world):
    event = world[2] / "2020" / "[2020_01_10]_ev"
    lib.refresh(spark, [str(world[2])], configured(world))
    media = lib.decoded(lib.scan(spark, [str(world[2])]), spark.createDataFrame([], "path string"), configured(world))
    assert media.count() == 0
    disguised(event / "a.jpg", b"other")
    assert lib.refresh(spark, [str(world[2])], configured(world), force=False).count() == 0
    assert lib.refresh(spark, [str(world[2])], configured(world)).count() == 1


def test_catalogue_of_several_writers(spark, tmp_path):
    from eventloom.errors import CatalogueConflict
    from eventloom.schemas import CATALOGUE

    table = Catalogue(spark, str(tmp_path / "table"))
    day = datetime(2020, 1, 1)
    rows = lambda n: spark.createDataFrame([("/lib", f"/lib/{i}", "s", day, day, day, True, i) for i in range(n)], CATALOGUE)
    assert table.commit(rows(1), 0) == 1 and table.commit(rows(2), 1) == 2
    with pytest.raises(CatalogueConflict):
        table.commit(rows(9), 1)  # made from a version that isn't the latest
    assert table.read().count() == 2 and table.read(1).count() == 1
    table.commit(rows(3), 2)
    assert table.versions() == [2, 3] and sorted(p.name for p in (tmp_path / "table").iterdir()) == ["v0000000002", "v0000000003"]

"""Scalar functions against their tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.functions import media as M, names as N


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


@pytest.mark.parametrize("name,yes", [("img.jpg", 1), ("img.JPG", 1), ("img.Jpg", 1), ("img.cr2", 1), ("img.CR2", 1), (".jpg", 1), ("img.xyz", 0), ("img.jpg.xyz", 0), ("", 0), ("no_extension", 0)])
def test_extension_filter(spark, name, yes):
    assert values(spark, [(name,)], "n string", M.has_extension(F.col("n"), [".jpg", ".CR2"])) == [bool(yes)]


def test_extension_lists(spark):
    assert values(spark, [("a.jpg",)], "n string", M.has_extension(F.col("n"), [])) == [False]
    assert values(spark, [("foomov",), ("a.mp4",)], "n string", M.is_supported(F.col("n"))) == [True, True]
    assert values(spark, [("photo.jpg",), ("photo.cr2",), ("video.mp4",), ("video.mov",)], "n string", M.is_image(F.col("n"))) == [True, True, False, False]


NAMES = {
    "IMG_0017-Kopiuj(2).HEIC": "IMG_0017.HEIC", "IMG_0017-Kopiuj(1).HEIC": "IMG_0017.HEIC", "IMG_0017-Kopiuj.HEIC": "IMG_0017.HEIC",
    "photo - Copy.jpg": "photo.jpg", "photo - Copy (3).jpg": "photo.jpg", "photo (1).jpg": "photo.jpg", "photo(1).jpg": "photo.jpg",
    "IMG_0017.HEIC": "IMG_0017.HEIC", "vacation.jpg": "vacation.jpg", "README-Kopiuj(1)": "README", ".hidden (1)": ".hidden", "a (1) (2).jpg": "a (1).jpg",
    "x-kopiuj.jpg": "x-kopiuj.jpg", "x - COPY.jpg": "x.jpg",
}


def test_strip_copy_suffix(spark):
    assert values(spark, [(n,) for n in NAMES], "n string", N.strip_copy_suffix(F.col("n"))) == list(NAMES.values())


def test_folders(spark):
    paths = ["2020", "1999", "2099", "/home/2019", "3000", "20202", "abcd", "202", "photos/2019/[2019_01_02]_event"]
    assert values(spark, [(p,) for p in paths], "p string", N.is_year_folder(F.col("p"))) == [True] * 4 + [False] * 5
    paths = ["2020/event_name", "not_year/event_name", "2020", "2020/sub/deeper"]
    assert values(spark, [(p,) for p in paths], "p string", N.is_event_folder(F.col("p"))) == [True, False, False, False]
    labels = {"2020": "year", "2020/[2020_01_01]_event": "event", "2020/[2020_01_01]_event/sel": "sel", "random_folder": "unknown", "2020/2021": "year", "2020/sel": "sel", "2020/e/x": "unknown"}
    assert values(spark, [(p,) for p in labels], "p string", N.folder_type(F.col("p"))) == list(labels.values())
    none = spark.createDataFrame([], "path string")
    assert N.library_is_valid(none).first().is_valid
    assert not N.library_is_valid(spark.createDataFrame([("2020",), ("odd",)], "path string")).first().is_valid


def test_flags_and_paths(spark):
    assert values(spark, [("True",), ("False",)], "t string", N.parse_flag(F.col("t"))) == [True, False]
    for bad in ("true", "yes", "1", ""):
        with pytest.raises(Exception, match="not a flag"):
            values(spark, [(bad,)], "t string", N.parse_flag(F.col("t")))
    rows = [("/lib/2020/x", "/lib/"), ("/other/lib/2020", "/lib")]
    assert values(spark, rows, "p string, l string", N.relative_path(F.col("p"), F.col("l"))) == ["2020/x", "/other/lib/2020"]
    assert values(spark, [("/a/2020/base",)], "p string", N.existing_target(F.col("p"))) == ["existing/base"]
    assert values(spark, [("base",)], "p string", N.duplicate_target(F.col("p"))) == ["duplicated/base"]


def test_event_name(spark):
    rows = [(datetime(2020, 1, 10, 14, 15), 3, 0), (datetime(2020, 6, 20, 19, 30), 11, 1), (datetime(2020, 6, 20), 10, 10), (None, 1, 0)]
    got = values(spark, rows, "d timestamp_ntz, i long, v long", N.event_name(F.col("d"), F.col("i"), F.col("v"), F.lit("7")))
    assert got[:3] == ["[2020_01_10]_141500_IC_3_VC_0_", "[2020_06_20]_193000_IC_11_VC_1__rich", "[2020_06_20]_000000_IC_10_VC_10_"]
    import re

    assert re.fullmatch(r"\[NaT_\]_\d{6}_\d{6}_IC_1_VC_0_", got[3])


def test_catalogue_entry(spark):
    names = ["[2020_01_02]_my_trip", "[2020_01_02]_", "nothing", "[]_x", "[a]_b]_c"]
    assert values(spark, [(n,) for n in names], "n string", N.catalogue_entry(F.col("n"))) == ["2020-01-02;my trip", "2020-01-02;unlabelled", None, None, None]


def test_dates(spark):
    at = lambda h, m=0: datetime(2020, 1, 10, h, m)
    rows = [("a", at(14), at(14, 5), at(13, 55)), ("b", at(15), at(15, 5), None), ("c", at(16), at(16, 5), at(15, 55)), ("d", at(17), at(17, 5), None), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "f string, m_date timestamp_ntz, c_date timestamp_ntz, exif_date timestamp_ntz")
    for rule in ("m_date", "earliest"):
        assert [r.date for r in M.resolve_date(df, rule).orderBy("f").collect()] == [at(13, 55), at(15), at(15, 55), at(17), None]
    assert M.resolve_date(df, "none", drop=False).columns[-1] == "date"
    assert dict(M.resolve_date(df.limit(0)).dtypes)["date"] == "timestamp_ntz"
    texts = [("2018:05:06 07:08:09",), ("2018:05:06 07:08:09.25",), ("2018-05-06 07:08:09",), ("2018:13:06 07:08:09",), ("",), (None,)]
    got = values(spark, texts, "t string", M.exif_timestamp(F.col("t")))
    assert got == [datetime(2018, 5, 6, 7, 8, 9), datetime(2018, 5, 6, 7, 8, 9, 250000), None, None, None, None]
    seconds = [(2082844800 + 1_600_000_000,), (2082844800 + 100,), (None,)]
    assert values(spark, seconds, "s long", M.quicktime_timestamp(F.col("s"))) == [datetime(2020, 9, 13, 12, 26, 40), None, None]


def test_hashes(spark):
    import hashlib

    data = bytes(range(256)) * 9000
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    r = df.select(M.content_hash(F.col("c")).alias("a"), M.content_hash(F.col("c"), "md5").alias("b"), M.partial_hash(F.col("c")).alias("p")).first()
    assert (r.a, r.b, r.p) == (hashlib.sha1(data).hexdigest(), hashlib.md5(data).hexdigest(), hashlib.md5(data[: 1 << 20]).hexdigest())
    with pytest.raises(ValueError):
        M.content_hash(F.col("c"), "crc")

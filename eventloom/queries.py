"""Driver-facing queries of the media operators, over views of the driver's tables, and their SQL.

``events`` are a media timeline: file ``IMG_<event_id>`` with an extension by type (error:
unsupported, and in some queries a duplicate), ``documents`` stand for file contents.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventloom.config import Config, Mode, Representative, Status
from eventloom.functions import media as M, names as N
from eventloom.operators import assign, duplicates, naming, order_stats, sessions
from eventloom.plans import file_plan, importing, reports
from eventloom.runtime import written
from eventloom.sources import library
from eventloom.streaming.sessions import session_bounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The gap that gives many events over the whole timeline.
GAP = timedelta(minutes=10)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _media(spark: SparkSession, sf_dir: str, duplicate: str | None = None) -> DataFrame:
    """Events as media; those of the type ``duplicate`` are marked as duplicates."""
    kind = F.col("event_type")
    ext = F.when(kind == "view", ".jpg").when(kind == "click", ".HEIC").when(kind == "purchase", ".mp4").when(kind == "signup", ".MOV").otherwise(".txt")
    status = F.when(kind == duplicate, Status.DUPLICATE.name) if duplicate else F.lit(None).cast("string")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("IMG_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), ext).alias("file_name"), F.col("ts").alias("date"),
        kind.isin("view", "click").alias("is_image"), F.coalesce(status, F.lit(Status.UNKNOWN.name)).alias("status"),
        F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("string").alias("duplicated_cluster"), "event_id", "user_id",
    )


EXT = "CASE event_type WHEN 'view' THEN '.jpg' WHEN 'click' THEN '.HEIC' WHEN 'purchase' THEN '.mp4' WHEN 'signup' THEN '.MOV' ELSE '.txt' END"
MEDIA = f"SELECT 'IMG_' || lpad(CAST(event_id AS VARCHAR), 9, '0') || {EXT} AS file_name, ts AS date, event_type IN ('view', 'click') AS is_image, event_type, event_id, user_id FROM events"


def numbered(where: str = "true", gap: int = 10, keys: str = "", lag_where: str = "true") -> str:
    """SQL of media with cluster_id: lag over ``lag_where``, then filter, then a running sum."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""m AS ({MEDIA}),
d AS (SELECT *, date - lag(date) OVER ({part} ORDER BY date NULLS LAST, file_name) AS delta FROM m WHERE {lag_where}),
f AS (SELECT *, CASE WHEN row_number() OVER ({part} ORDER BY date NULLS LAST, file_name) = 1 OR delta > INTERVAL {gap} MINUTE THEN 1 ELSE 0 END AS opens FROM d WHERE {where}),
n AS (SELECT *, CAST(sum(opens) OVER ({part} ORDER BY date NULLS LAST, file_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id FROM f)"""


@query(f"""SELECT event_id, file_name, is_supported, is_image FROM (
SELECT event_id, file_name, regexp_matches(lower(file_name), '(\\.jpg|\\.jpeg|\\.dng|\\.cr2|\\.tif|\\.tiff|\\.heic|\\.mp4|\\.3gp|mov)$') AS is_supported,
regexp_matches(lower(file_name), '(\\.jpg|\\.jpeg|\\.dng|\\.cr2|\\.tif|\\.tiff|\\.heic)$') AS is_image FROM ({MEDIA}))""")
def media_supported_filter(spark, sf_dir):
    name = F.col("file_name")
    return _media(spark, sf_dir).select("event_id", "file_name", M.is_supported(name).alias("is_supported"), M.is_image(name).alias("is_image"))


def _raw_dates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = lambda n: F.col("o_orderdate") + F.expr(f"interval {n} days")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("m_date"),
        F.when(F.col("o_orderkey") % 7 != 0, day(1)).alias("c_date"), F.when(F.col("o_orderkey") % 3 == 0, day(-2)).alias("exif_date"),
    )


RAW = """r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS m_date,
CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS c_date,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 DAY END AS exif_date FROM orders)"""


@query(f"WITH {RAW} SELECT o_orderkey, coalesce(exif_date, m_date) AS date FROM r")
def date_resolve_coalesce(spark, sf_dir):
    return M.resolve_date(_raw_dates(spark, sf_dir))


@query(f"WITH {RAW} SELECT o_orderkey, least(m_date, c_date, exif_date) AS date FROM r")
def date_resolve_earliest(spark, sf_dir):
    return M.resolve_date(_raw_dates(spark, sf_dir), "earliest")


@query(f"WITH {RAW} SELECT count(*) FILTER (coalesce(exif_date, m_date) IS NULL) AS n_missing, count(*) AS n_files FROM r")
def missing_dates(spark, sf_dir):
    return M.missing_dates(M.resolve_date(_raw_dates(spark, sf_dir)))


@query(f"SELECT event_id, CAST(epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY user_id ORDER BY date NULLS LAST, file_name) AS BIGINT) AS delta_us FROM ({MEDIA})")
def gap_delta(spark, sf_dir):
    rows = sessions.gaps(_media(spark, sf_dir), "user_id")
    return rows.select("event_id", F.expr("cast(date_delta as interval second)").cast("decimal(18,6)").alias("d")).select("event_id", (F.col("d") * 1_000_000).cast("long").alias("delta_us"))


@query(f"SELECT event_id, CAST(coalesce(epoch_us(date) - lag(epoch_us(date)) OVER (ORDER BY date NULLS LAST, file_name), -1) AS BIGINT) AS delta_us FROM ({MEDIA})")
def gap_delta_global(spark, sf_dir):
    rows = sessions.gaps(_media(spark, sf_dir)).select("event_id", F.expr("cast(date_delta as interval second)").cast("decimal(18,6)").alias("d"))
    return rows.select("event_id", F.coalesce((F.col("d") * 1_000_000).cast("long"), F.lit(-1)).alias("delta_us"))


@query("""SELECT o_orderkey, CASE WHEN year(made) >= 1990 THEN made END AS shot,
CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) END AS exif FROM (
SELECT o_orderkey, o_orderdate, make_timestamp((o_orderkey * 300000 - 2082844800) * 1000000) AS made FROM orders)""")
def media_timestamps(spark, sf_dir):
    """QuickTime seconds, before 1990 and after, and EXIF strings (every fourth one malformed) of orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey") % 86_400)
    text = F.when(F.col("o_orderkey") % 4 == 3, F.date_format(at, "yyyy/MM/dd HH:mm")).otherwise(F.date_format(at, "yyyy:MM:dd HH:mm:ss"))
    return o.select("o_orderkey", M.quicktime_timestamp(F.col("o_orderkey") * 300_000).alias("shot"), M.exif_timestamp(text).alias("exif"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '/lib2/' || path ELSE path END AS relative, c_custkey % 2 = 0 AS flag FROM (
SELECT c_custkey, '2019/' || replace(c_name, '#', '/') AS path FROM customer)""")
def relative_paths(spark, sf_dir):
    """Paths of two libraries below one of them, and flags in their written form."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = F.concat(F.when(F.col("c_custkey") % 3 == 2, "/lib2/").otherwise("/lib/"), F.lit("2019/"), F.replace("c_name", F.lit("#"), F.lit("/")))
    flag = F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("False")
    return c.select("c_custkey", N.relative_path(path, F.lit("/lib//")).alias("relative"), N.parse_flag(flag).alias("flag"))


@query(f"WITH {numbered()} SELECT event_id, cluster_id FROM n")
def gap_cluster_assign(spark, sf_dir):
    return sessions.cluster(_media(spark, sf_dir), gap=GAP).select("event_id", "cluster_id")


@query(f"WITH {numbered(gap=60, keys='user_id')} SELECT user_id, event_id, cluster_id FROM n")
def gap_cluster_by_key(spark, sf_dir):
    return sessions.cluster(_media(spark, sf_dir), "user_id").select("user_id", "event_id", "cluster_id")


@query(f"WITH {numbered("event_type <> 'error'")} SELECT event_id, cluster_id FROM n")
def gap_cluster_dup_bridge(spark, sf_dir):
    rows = sessions.cluster(_media(spark, sf_dir, "error"), gap=GAP)
    return rows.filter(F.col("status") == Status.NEW_CLUSTER.name).select("event_id", "cluster_id")


@query(f"WITH {numbered()} SELECT cluster_id, min(date) AS start_date, max(date) AS end_date, true AS is_continuous FROM n GROUP BY 1")
def cluster_bounds(spark, sf_dir):
    return sessions.bounds(sessions.cluster(_media(spark, sf_dir), gap=GAP))


NAMED = """c AS (SELECT cluster_id, count(*) AS files, count(*) FILTER (is_image) AS ic, count(*) FILTER (NOT is_image) AS vc FROM n GROUP BY 1),
k AS (SELECT cluster_id, date, row_number() OVER (PARTITION BY cluster_id ORDER BY date NULLS LAST, file_name) - 1 AS i FROM n),
named AS (SELECT c.cluster_id, 'new/' || strftime(date, '[%Y_%m_%d]_%H%M%S') || '_IC_' || ic || '_VC_' || vc || '_' || CASE WHEN ic > 10 OR vc > 10 THEN '_rich' ELSE '' END AS target_path,
files AS new_file_count FROM c JOIN k ON c.cluster_id = k.cluster_id AND i = files // 2)"""


def _clustered(spark, sf_dir, duplicate="error"):
    media = written(sessions.cluster(_media(spark, sf_dir, duplicate), gap=GAP), "clustered")
    return media, naming.named(media.filter(F.col("status") == Status.NEW_CLUSTER.name))


NOT_ERROR = "event_type <> 'error'"


@query(f"WITH {numbered(NOT_ERROR)}, {NAMED} SELECT cluster_id, target_path, new_file_count FROM named")
def cluster_names(spark, sf_dir):
    return _clustered(spark, sf_dir)[1]


@query("""WITH r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts IS NOT NULL)
SELECT event_type, rank, ts FROM r WHERE rank IN (0, n // 4, n // 2, 3 * n // 4, n - 1)""")
def order_statistics(spark, sf_dir):
    """Exact quartiles of the times of each type of event; no time is ordered."""
    times = _events(spark, sf_dir).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("value"), F.lit(1).cast("long").alias("n"))
    sizes = times.groupBy("event_type").agg(F.count("value").alias("n"))
    ranks = sizes.select("event_type", F.explode(F.expr("array(0, n div 4, n div 2, 3 * n div 4, n - 1)")).alias("rank"))
    found = order_stats.kth(times, ["event_type"], ranks)
    return found.select("event_type", "rank", F.timestamp_micros("value").cast(_events(spark, sf_dir).schema["ts"].dataType).alias("ts"))


@query("""WITH d AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT user_id, min(ts) AS date_start, max(ts) AS date_stop, make_timestamp(CAST(floor(median(epoch_us(ts))) AS BIGINT)) AS median, count(*) AS file_count,
NOT coalesce(bool_or(d > 3600000000), false) AS is_time_consistent FROM d GROUP BY 1""")
def folder_stats(spark, sf_dir):
    return sessions.folder_stats(_media(spark, sf_dir), "user_id")


@query("""WITH d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
n AS (SELECT *, sum(CASE WHEN d IS NULL OR d > INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS start_date, max(ts) AS end_date, count(*) AS file_count FROM n GROUP BY user_id, k""")
def session_window_equiv(spark, sf_dir):
    return session_bounds(_events(spark, sf_dir), "user_id")


def _library(spark, sf_dir):
    """Library events: all events by hour, ids from 0 by hour."""
    rows = _events(spark, sf_dir).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("h")).agg(
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.count("*").alias("file_count")
    )
    # an id a distinct hour: the hours of a timeline are few
    cid = (F.row_number().over(Window.orderBy("h")) - 1).cast("long")
    path = F.concat(F.lit("/lib/2024/"), F.date_format("h", "'['yyyy_MM_dd']_'HH"))
    return rows.select(
        cid.alias("cluster_id"), "start_date", "end_date", F.lit(None).cast("timestamp_ntz").alias("median"), (F.hour("h") % 5 != 0).alias("is_continuous"),
        path.alias("path"), F.lit(None).cast("string").alias("target_path"), "file_count", F.lit(None).cast("long").alias("new_file_count"),
    )


LIBRARY = """l AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS cluster_id, start_date, end_date, hour(h) % 5 <> 0 AS is_continuous,
'/lib/2024/' || strftime(h, '[%Y_%m_%d]_%H') AS path, file_count FROM (
SELECT date_trunc('hour', ts) AS h, min(ts) AS start_date, max(ts) AS end_date, count(*) AS file_count FROM events GROUP BY 1))"""
SMALL = timedelta(minutes=2)


@query(f"WITH {LIBRARY} SELECT coalesce(max(cluster_id) + 1, 1) AS next_id FROM l")
def next_cluster_id(spark, sf_dir):
    return sessions.next_id(_library(spark, sf_dir))


STATIC = f"""WITH {LIBRARY}, m AS ({MEDIA}) SELECT file_name, min(cluster_id) AS cluster_id FROM m JOIN l
ON is_continuous AND date BETWEEN start_date - INTERVAL 2 MINUTE AND end_date + INTERVAL 2 MINUTE WHERE event_type <> 'error' GROUP BY 1"""


@query(STATIC)
def assign_existing_static(spark, sf_dir):
    return assign.match_static(_media(spark, sf_dir, "error"), _library(spark, sf_dir), SMALL)


#: Each file in order takes the lowest event that holds it, and widens it for the next ones: a
#: recursion over files that carries the events' grown ends.
EXPANDING = f"""WITH RECURSIVE {LIBRARY}, m AS ({MEDIA}),
f AS MATERIALIZED (SELECT file_name, date, row_number() OVER (ORDER BY date, file_name) AS i FROM m WHERE event_type <> 'error' AND date IS NOT NULL),
o AS MATERIALIZED (SELECT cluster_id, start_date AS s, end_date AS e FROM l WHERE is_continuous),
step(i, file_name, cluster_id, grown) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(MAP {{}} AS MAP(BIGINT, TIMESTAMP))
  UNION ALL
  SELECT x.i, x.file_name, x.c, CASE WHEN x.c IS NULL THEN x.kept ELSE map_concat(x.kept, MAP {{x.c: x.date}}) END FROM (
    SELECT f.i, f.file_name, f.date,
           map_from_entries(list_filter(map_entries(step.grown), lambda g: g.value + INTERVAL 2 MINUTE >= f.date)) AS kept,
           (SELECT min(o.cluster_id) FROM o WHERE o.s - INTERVAL 2 MINUTE <= f.date
             AND greatest(o.e, coalesce(step.grown[o.cluster_id], o.e)) + INTERVAL 2 MINUTE >= f.date) AS c
    FROM step JOIN f ON f.i = step.i + 1) x)
SELECT file_name, cluster_id FROM step WHERE cluster_id IS NOT NULL"""


@query(EXPANDING)
def assign_existing_expanding(spark, sf_dir):
    return assign.match(_media(spark, sf_dir, "error"), _library(spark, sf_dir), SMALL)


ATTACHED = f"""WITH {LIBRARY}, m AS ({MEDIA}), a AS ({EXPANDING}),
g AS (SELECT a.cluster_id, min(date) AS s, max(date) AS e, count(*) AS n FROM a JOIN m USING (file_name) GROUP BY 1)
SELECT l.cluster_id, least(start_date, s) AS start_date, greatest(end_date, e) AS end_date, CAST(NULL AS TIMESTAMP) AS median, is_continuous, path,
CASE WHEN n IS NOT NULL THEN 'existing/' || regexp_extract(path, '[^/]+$') END AS target_path, file_count, n AS new_file_count FROM l LEFT JOIN g USING (cluster_id)"""


@query(ATTACHED)
def attach_existing(spark, sf_dir):
    return assign.attach(_media(spark, sf_dir, "error"), _library(spark, sf_dir), SMALL)[1]


@query(f"WITH {LIBRARY}, u AS ({STATIC}) SELECT DISTINCT u.cluster_id FROM u JOIN l USING (cluster_id) WHERE path IS NOT NULL")
def expand_candidates(spark, sf_dir):
    lib = _library(spark, sf_dir)
    used = assign.match_static(_media(spark, sf_dir, "error"), lib, SMALL).groupBy("cluster_id").agg(F.count("*").alias("new_file_count"))
    return sessions.expanded_cluster_ids(lib.drop("new_file_count").join(used, "cluster_id", "left"))


@query(f"WITH {LIBRARY} SELECT cluster_id, 'existing/' || regexp_extract(path, '[^/]+$') AS target_path FROM l")
def existing_targets(spark, sf_dir):
    return naming.with_existing_targets(_library(spark, sf_dir)).select("cluster_id", "target_path")


@query(f"WITH {LIBRARY} SELECT CAST(sum(file_count) AS BIGINT) AS total_files FROM l")
def total_file_count(spark, sf_dir):
    return naming.total_files(_library(spark, sf_dir))


def _contents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = d.select("doc_id", content.alias("content"), F.octet_length(content).cast("long").alias("size"))
    name = F.concat(F.lit("IMG_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".jpg"))
    inbox = rows.filter("doc_id % 2 = 1").select(name.alias("file_name"), "content", "size")
    path = F.concat(F.lit("/lib/2020/"), F.concat(F.lit("[2020_01_"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("]_event/")), name)
    return inbox, rows.filter("doc_id % 2 = 0").select(path.alias("path"), "content", "size")


CONTENTS = """b AS (SELECT doc_id, coalesce(text, '') AS content, 'IMG_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.jpg' AS name FROM documents),
i AS (SELECT name AS file_name, content FROM b WHERE doc_id % 2 = 1),
l AS (SELECT '/lib/2020/[2020_01_' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ']_event/' || name AS path, content FROM b WHERE doc_id % 2 = 0),
d AS (SELECT file_name, min(path) AS duplicated_to FROM i JOIN l USING (content) GROUP BY 1)"""


@query(f"WITH {CONTENTS} SELECT file_name, duplicated_to FROM d")
def dup_detect_staged(spark, sf_dir):
    return duplicates.duplicates(*_contents(spark, sf_dir))


@query(f"WITH {CONTENTS} SELECT i.file_name, d.file_name IS NOT NULL AS is_duplicate FROM i LEFT JOIN d USING (file_name)")
def dup_partition_semi_anti(spark, sf_dir):
    inbox, library = _contents(spark, sf_dir)
    names, found = inbox.select("file_name"), duplicates.duplicates(inbox, library)
    yes = names.join(found, "file_name", "left_semi").withColumn("is_duplicate", F.lit(True))
    return yes.unionByName(names.join(found, "file_name", "left_anti").withColumn("is_duplicate", F.lit(False)))


@query(f"""WITH {CONTENTS} SELECT i.file_name, CASE WHEN duplicated_to IS NULL THEN 'UNKNOWN' ELSE 'DUPLICATE' END AS status,
regexp_extract(duplicated_to, '([^/]+)/[^/]+$', 1) AS duplicated_cluster, 'duplicated/' || regexp_extract(duplicated_to, '([^/]+)/[^/]+$', 1) AS target_path
FROM i LEFT JOIN d USING (file_name)""")
def target_duplicates(spark, sf_dir):
    inbox, library = _contents(spark, sf_dir)
    none = F.lit(None).cast("string")
    media = inbox.select("file_name", F.lit(Status.UNKNOWN.name).alias("status"), none.alias("duplicated_to"), none.alias("duplicated_cluster"), none.alias("target_path"))
    marked = duplicates.mark(media, duplicates.duplicates(inbox, library))
    return duplicates.with_duplicate_targets(marked).select("file_name", "status", "duplicated_cluster", "target_path")


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", *[M.content_hash(text, a).alias(a) for a in ("sha1", "md5", "sha256")])


@query("""SELECT doc_id, '<img src="data:image/jpeg;base64,' || base64(encode(text)) || '">' AS image_tag FROM documents""")
def image_tags(spark, sf_dir):
    """Whole texts stand for the bytes of thumbnails."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", M.image_tag(F.col("text").cast("binary")).alias("image_tag"))


@query("""SELECT doc_id, md5(encode(content)[1:1048576]) AS part, octet_length(encode(content)) > 1048576 AS is_cut FROM (SELECT doc_id,
CASE WHEN doc_id % 250 = 1 AND strlen(text) > 0 THEN repeat(text, 1048576 // strlen(text) + 1) ELSE coalesce(text, '') END AS content FROM documents)""")
def partial_content_hash(spark, sf_dir):
    """Hashes of contents, some of which (texts that are repeated) are longer than the prefix."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = F.expr("repeat(text, cast(1048576 div octet_length(text) + 1 as int))")
    d = d.withColumn("content", F.when((F.col("doc_id") % 250 == 1) & (F.octet_length("text") > 0), long).otherwise(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", M.partial_hash(F.col("content")).alias("part"), (F.octet_length("content") > M.PARTIAL_BYTES).alias("is_cut"))


@query(f"WITH {numbered(NOT_ERROR)}, {NAMED}, m2 AS ({MEDIA}) SELECT m2.event_id, n.cluster_id, target_path FROM m2 LEFT JOIN n USING (event_id) LEFT JOIN named ON n.cluster_id = named.cluster_id")
def media_target_join(spark, sf_dir):
    media, named = _clustered(spark, sf_dir)
    return naming.with_targets(media, named).select("event_id", "cluster_id", "target_path")


NAMES = """v AS (SELECT o_orderkey, 'D' || o_custkey % 20 AS target_path, CASE o_orderkey % 5
WHEN 0 THEN 'IMG_' || o_custkey || '.jpg' WHEN 1 THEN 'IMG_' || o_custkey || '-Kopiuj(' || o_orderkey || ').jpg' WHEN 2 THEN 'IMG_' || o_custkey || ' - Copy (' || o_orderkey || ').jpg'
WHEN 3 THEN 'img_' || o_custkey || ' (' || o_orderkey || ').JPG' ELSE 'IMG_' || o_custkey || '-Kopiuj.' || o_orderkey END AS file_name FROM orders),
s AS (SELECT *, regexp_extract(file_name, '^.+(\\.[^.]+)$', 1) AS x FROM v),
t AS (SELECT *, file_name[:length(file_name) - length(x)] AS stem FROM s),
w AS (SELECT *, CASE WHEN regexp_matches(stem, '-Kopiuj(\\s*\\(\\d+\\))?$') THEN regexp_replace(stem, '-Kopiuj(\\s*\\(\\d+\\))?$', '')
WHEN regexp_matches(stem, '(?i)\\s*-\\s*Copy(\\s*\\(\\d+\\))?$') THEN regexp_replace(stem, '(?i)\\s*-\\s*Copy(\\s*\\(\\d+\\))?$', '')
WHEN regexp_matches(stem, '\\s*\\(\\d+\\)$') THEN regexp_replace(stem, '\\s*\\(\\d+\\)$', '') ELSE stem END || x AS want FROM t)"""


def _named_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("IMG_"), c, F.lit(".jpg")))
        .when(kind == 1, F.concat(F.lit("IMG_"), c, F.lit("-Kopiuj("), k, F.lit(").jpg")))
        .when(kind == 2, F.concat(F.lit("IMG_"), c, F.lit(" - Copy ("), k, F.lit(").jpg")))
        .when(kind == 3, F.concat(F.lit("img_"), c, F.lit(" ("), k, F.lit(").JPG")))
        .otherwise(F.concat(F.lit("IMG_"), c, F.lit("-Kopiuj."), k))
    )
    return o.select("o_orderkey", F.concat(F.lit("D"), (F.col("o_custkey") % 20).cast("string")).alias("target_path"), name.alias("file_name"))


@query(f"WITH {NAMES} SELECT o_orderkey, file_name, want AS stripped FROM w")
def strip_copy_suffix(spark, sf_dir):
    return _named_orders(spark, sf_dir).select("o_orderkey", "file_name", N.strip_copy_suffix(F.col("file_name")).alias("stripped"))


@query(f"""WITH {NAMES}, u AS (SELECT DISTINCT file_name, target_path, want FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY target_path, lower(want) ORDER BY want <> file_name, file_name) AS k FROM u)
SELECT file_name, target_path, CASE WHEN want <> file_name AND k = 1 THEN want ELSE file_name END AS dst_name FROM r""")
def resolve_names(spark, sf_dir):
    return naming.resolved_names(_named_orders(spark, sf_dir).select("file_name", "target_path").distinct(), True)


def _folders(spark, sf_dir):
    """Paths such as 2019/name, 2019/sel, 2019/name/deep and others, from customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    year = (k % 160 + 1890).cast("string")
    kind = k % 6
    path = (
        F.when(kind == 0, year).when(kind == 1, F.concat(year, F.lit("/sel"))).when(kind == 2, F.concat(year, F.lit("/["), year, F.lit("_01_02]_trip_"), k.cast("string")))
        .when(kind == 3, F.concat(year, F.lit("/a/sel"))).when(kind == 4, F.concat(year, F.lit("/e/deep"))).otherwise(F.concat(F.lit("x"), year))
    )
    return c.select("c_custkey", path.alias("path"))


FOLDERS = """p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN y WHEN 1 THEN y || '/sel' WHEN 2 THEN y || '/[' || y || '_01_02]_trip_' || c_custkey
WHEN 3 THEN y || '/a/sel' WHEN 4 THEN y || '/e/deep' ELSE 'x' || y END AS path FROM (SELECT c_custkey, CAST(c_custkey % 160 + 1890 AS VARCHAR) AS y FROM customer)),
q AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)(19|20)\\d{2}$') THEN 'year' WHEN regexp_matches(path, '(^|/)sel$') THEN 'sel'
WHEN regexp_matches(path, '(^|/)(19|20)\\d{2}/[^/]*$') THEN 'event' ELSE 'unknown' END AS folder_type FROM p)"""


@query(f"WITH {FOLDERS} SELECT c_custkey, path, folder_type FROM q")
def folder_labels(spark, sf_dir):
    return _folders(spark, sf_dir).withColumn("folder_type", N.folder_type(F.col("path")))


@query(f"WITH {FOLDERS} SELECT NOT coalesce(bool_or(folder_type = 'unknown'), false) AS is_valid FROM q")
def library_valid(spark, sf_dir):
    return N.library_is_valid(_folders(spark, sf_dir))


@query(f"WITH {FOLDERS} SELECT c_custkey, path FROM q WHERE folder_type = 'event'")
def event_folders(spark, sf_dir):
    return _folders(spark, sf_dir).filter(N.folder_type(F.col("path")) == "event")


@query(f"""WITH {FOLDERS}, b AS (SELECT regexp_extract(path, '[^/]*$') AS n, path FROM p),
z AS (SELECT string_split(n, ']_') AS s FROM b WHERE regexp_matches(path, '^\\d{{4}}'))
SELECT replace(s[1][2:], '_', '-') || ';' || CASE WHEN s[2] = '' THEN 'unlabelled' ELSE replace(s[2], '_', ' ') END AS line FROM z WHERE len(s) = 2 AND s[1][2:] <> ''""")
def event_catalogue(spark, sf_dir):
    rows = _folders(spark, sf_dir).select(N.basename(F.col("path")).alias("name"), F.col("path").alias("year"))
    return reports.catalogue(rows, year="year")


CONFIG = Config(inbox="/in", outbox="/out", gap=GAP, mode=Mode.COPY)


def _plan(spark, sf_dir):
    media, named = _clustered(spark, sf_dir, None)
    return file_plan.build(naming.with_targets(media, named), CONFIG.inbox, CONFIG.outbox, CONFIG.mode)


PLANNED = f"""{numbered()}, {NAMED}, x AS (SELECT file_name, target_path FROM n JOIN named USING (cluster_id)),
ops AS (SELECT DISTINCT 'mkdir' AS op, CAST(NULL AS VARCHAR) AS src, '/out/' || target_path AS dst FROM x
UNION ALL SELECT 'copy', '/in/' || file_name, '/out/' || target_path || '/' || file_name FROM x)"""


@query(f"WITH {PLANNED} SELECT op, src, dst FROM ops")
def plan_ops(spark, sf_dir):
    return _plan(spark, sf_dir).select("op", "src", "dst")


@query(f"""WITH {PLANNED} SELECT count(*) FILTER (op = 'mkdir') AS n_mkdirs, CAST(0 AS BIGINT) AS n_moves, count(*) FILTER (op = 'copy') AS n_copies, CAST(0 AS BIGINT) AS n_skips FROM ops""")
def plan_summary(spark, sf_dir):
    return file_plan.counters(_plan(spark, sf_dir))


#: What is on disk: a photo of every third customer, in the folder of their number.
DISK = "disk AS (SELECT 'D' || c_custkey % 20 AS target_path, CASE WHEN c_custkey % 2 = 0 THEN 'IMG_' ELSE 'img_' END || c_custkey || '.jpg' AS name FROM customer WHERE c_custkey % 3 = 0)"


def _disk(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, "IMG_").otherwise("img_"), k.cast("string"), F.lit(".jpg"))
    return c.select(F.concat(F.lit("D"), (k % 20).cast("string")).alias("target_path"), name.alias("name"))


#: One plan of all events' and orders' files; on disk are the photos of DISK, and in the events' folders
#: those that bear the numbers of orders.
@query(f"""WITH {numbered()}, {NAMED}, {NAMES}, {DISK}, e AS (SELECT event_id, file_name, target_path FROM n JOIN named USING (cluster_id)),
u AS (SELECT file_name, target_path FROM e UNION ALL SELECT DISTINCT file_name, target_path FROM v),
h AS (SELECT target_path, name FROM disk UNION ALL SELECT target_path, 'IMG_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.jpg' FROM orders JOIN e ON event_id = o_orderkey)
SELECT 'copy' AS op, '/in/' || file_name AS src, '/out/' || target_path || '/' || file_name AS dst FROM u WHERE (target_path, file_name) IN (SELECT (target_path, name) FROM h)""")
def plan_conflicts(spark, sf_dir):
    """Operations of a plan whose destination is on disk, by what other tables say is there."""
    media, named = _clustered(spark, sf_dir, None)
    events = written(naming.with_targets(media, named).select("event_id", "file_name", "target_path"), "events")
    orders = _named_orders(spark, sf_dir)
    files = events.drop("event_id").unionByName(orders.select("file_name", "target_path").distinct())
    photo = F.concat(F.lit("IMG_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".jpg"))
    photos = events.join(orders.select(F.col("o_orderkey").alias("event_id")), "event_id", "left_semi").select("target_path", photo.alias("name"))
    held = _disk(spark, sf_dir).unionByName(photos).select(F.concat(F.lit("/out/"), "target_path", F.lit("/"), "name").alias("dst"))
    return file_plan.conflicts(file_plan.build(files, "/in", "/out", Mode.COPY), held).select("op", "src", "dst")


def _nested_orders(spark, sf_dir):
    """Names with up to three copy suffixes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stem = F.concat(F.when(k % 7 == 0, "img_").otherwise("IMG_"), (c % 900).cast("string"))
    name = F.concat(stem, F.expr("repeat(' (1)', cast(o_orderkey % 4 as int))"), F.when(k % 5 == 0, " (2)").otherwise(""), F.lit(".jpg"))
    return o.select(F.concat(F.lit("D"), (c % 20).cast("string")).alias("target_path"), name.alias("file_name")).distinct()


#: A copy may take its plain name (may) if it is the first of those that want it and the disk hasn't
#: it; it keeps its own if a row that has that name keeps it, or another such row does.
NESTED = f"""{DISK}, v AS (SELECT DISTINCT 'D' || o_custkey % 20 AS target_path, CASE WHEN o_orderkey % 7 = 0 THEN 'img_' ELSE 'IMG_' END || o_custkey % 900
|| repeat(' (1)', o_orderkey % 4) || CASE WHEN o_orderkey % 5 = 0 THEN ' (2)' ELSE '' END || '.jpg' AS file_name FROM orders),
w AS (SELECT *, regexp_replace(file_name, '\\s*\\(\\d+\\)\\.jpg$', '.jpg') AS want FROM v),
c AS MATERIALIZED (SELECT *, want <> file_name AND row_number() OVER (PARTITION BY target_path, lower(want) ORDER BY want <> file_name, file_name) = 1
AND (target_path, lower(want)) NOT IN (SELECT (target_path, lower(name)) FROM disk) AS may FROM w),
l AS MATERIALIZED (SELECT a.target_path, a.file_name, min(b.file_name) AS other, count(*) = 1 AND bool_and(b.may) AS ok FROM c a JOIN c b
ON a.may AND a.target_path = b.target_path AND lower(a.want) = lower(b.file_name) AND a.file_name <> b.file_name GROUP BY 1, 2),
k AS (SELECT target_path, file_name FROM l WHERE NOT ok UNION SELECT l.target_path, l.file_name FROM l JOIN k ON l.target_path = k.target_path AND l.other = k.file_name),
r AS (SELECT file_name, target_path, CASE WHEN may AND (target_path, file_name) NOT IN (SELECT (target_path, file_name) FROM k) THEN want ELSE file_name END AS dst_name FROM c)"""


@query(f"WITH RECURSIVE {NESTED} SELECT file_name, target_path, dst_name FROM r")
def resolve_names_on_disk(spark, sf_dir):
    """Names with several copy suffixes, in folders that hold some names already."""
    return naming.resolved_names(_nested_orders(spark, sf_dir), True, _disk(spark, sf_dir))


@query(f"""WITH RECURSIVE {NESTED} SELECT 'mkdir' AS op, NULL AS src, '/out/' || target_path AS dst, NULL AS reason FROM r GROUP BY target_path
UNION ALL SELECT CASE WHEN held THEN 'skip' ELSE 'move' END, '/in/' || file_name, '/out/' || target_path || '/' || dst_name, CASE WHEN held THEN 'destination exists' END
FROM (SELECT *, (target_path, lower(dst_name)) IN (SELECT (target_path, lower(name)) FROM disk) AS held FROM r)""")
def plan_beside_files(spark, sf_dir):
    """A plan that restores names and overwrites nothing."""
    return file_plan.build(_nested_orders(spark, sf_dir), "/in", "/out", Mode.MOVE, True, _disk(spark, sf_dir)).select("op", "src", "dst", "reason")


@query(f"""WITH {numbered(NOT_ERROR)} SELECT cluster_id, arg_max(date, md5('5|' || file_name)) AS representative_date FROM n GROUP BY 1""")
def random_representatives(spark, sf_dir):
    media = sessions.cluster(_media(spark, sf_dir, "error"), gap=GAP).filter(F.col("status") == Status.NEW_CLUSTER.name)
    return naming.representative(media, method=Representative.RANDOM, seed=5)


@query("""WITH d AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events)
SELECT '/lib/2020/' || user_id AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_date,
CASE WHEN coalesce(bool_or(d > 3600000000), false) THEN 'False' ELSE 'True' END AS is_continuous,
strftime(make_timestamp(CAST(floor(median(epoch_us(ts))) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS median, CAST(count(*) AS VARCHAR) AS file_count FROM d GROUP BY user_id""")
def ini_texts(spark, sf_dir):
    """What stands in the ini files of folders by user."""
    stats = sessions.folder_stats(_media(spark, sf_dir), "user_id")
    return library.ini_values(stats.select(
        F.concat(F.lit("/lib/2020/"), F.col("user_id").cast("string")).alias("path"), F.col("date_start").alias("start_date"), F.col("date_stop").alias("end_date"),
        F.col("is_time_consistent").alias("is_continuous"), "median", "file_count",
    ))


def _tree(spark, sf_dir):
    """A listing of two libraries: a folder a customer, a file an order (some without a dot, some ini files)."""
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    folder = lambda k: F.concat(F.lit("/lib"), (k % 2).cast("string"), F.lit("/"), (k % 30 + 1990).cast("string"), F.lit("/c"), k.cast("string"))
    k = F.col("o_custkey")
    name = F.when((F.col("o_orderkey") % 6 == 0) | (k % 9 == 4), ".cluster.ini").when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("note"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")))
    columns = lambda path, name, parent, is_dir, k: [path.alias("path"), name.alias("name"), parent.alias("parent"), F.lit(is_dir).alias("is_dir"), (k % 2).cast("int").alias("lib_idx")]
    own = F.col("c_custkey")
    dirs = c.select(*columns(folder(own), F.concat(F.lit("c"), own.cast("string")), F.regexp_replace(folder(own), "/[^/]*$", ""), True, own))
    files = o.select(*columns(F.concat(folder(k), F.lit("/"), name), name, folder(k), False, k))
    events = dirs.select("path", "lib_idx")
    return library.Tree(dirs.unionByName(files), events, ("/lib0", "/lib1"))


TREE = """f AS (SELECT c_custkey, '/lib' || c_custkey % 2 || '/' || (c_custkey % 30 + 1990) || '/c' || c_custkey AS path FROM customer),
o AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 = 0 OR o_custkey % 9 = 4 THEN '.cluster.ini' WHEN o_orderkey % 11 = 0 THEN 'note' || o_orderkey ELSE o_orderkey || '.jpg' END AS name FROM orders)"""


@query(f"WITH {TREE} SELECT path FROM f WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE name <> '.cluster.ini')")
def bare_folders(spark, sf_dir):
    """Event folders of all libraries without a file."""
    return library.bare(_tree(spark, sf_dir))


@query(f"WITH {TREE} SELECT path || '/' || name AS path, name, c_custkey % 2 AS lib_idx FROM o JOIN f ON o_custkey = c_custkey WHERE name LIKE '%.%'")
def listed_files(spark, sf_dir):
    """Files of all libraries."""
    return _tree(spark, sf_dir).files().select("path", "name", F.col("lib_idx").cast("long").alias("lib_idx"))


@query(f"SELECT 'skip' AS op, '/in/' || file_name AS src, 'NOP mode' AS reason FROM ({MEDIA})")
def plan_dry_run(spark, sf_dir):
    return file_plan.build(_media(spark, sf_dir), "/in", "/out", Mode.NOP).select("op", "src", "reason")


@query(f"""WITH m AS ({MEDIA}), r AS (SELECT user_id, file_name, md5('7|' || file_name) AS k FROM m WHERE is_image),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, file_name) AS i FROM r) SELECT user_id, file_name FROM o WHERE i = 1 ORDER BY user_id LIMIT 10""")
def sample_one_per_group(spark, sf_dir):
    items = _media(spark, sf_dir).filter("is_image").select("user_id", "file_name")
    return naming.one_per_group(items, "user_id", F.col("file_name"), cap=10, seed=7)


@query(f"""WITH {LIBRARY}, {numbered()}, b AS (SELECT cluster_id + 10000000 AS cluster_id, min(date) AS start_date, max(date) AS end_date FROM n GROUP BY 1)
SELECT cluster_id, start_date, end_date, path FROM l UNION ALL SELECT cluster_id, start_date, end_date, NULL FROM b""")
def union_clusters(spark, sf_dir):
    new = sessions.bounds(sessions.cluster(_media(spark, sf_dir), gap=GAP, first_id=10_000_001))
    return sessions.append(_library(spark, sf_dir), sessions.as_clusters(new)).select("cluster_id", "start_date", "end_date", "path")


@query(f"WITH {numbered()} SELECT DISTINCT cluster_id FROM n")
def distinct_ids(spark, sf_dir):
    return sessions.new_cluster_ids(sessions.cluster(_media(spark, sf_dir), gap=GAP))


@query(f"WITH {numbered()} SELECT cluster_id, count(*) FILTER (is_image) AS n_images, count(*) FILTER (NOT is_image) AS n_videos, count(*) AS new_file_count FROM n GROUP BY 1")
def media_counts(spark, sf_dir):
    return naming.counts(sessions.cluster(_media(spark, sf_dir), gap=GAP))


@query(f"WITH {PLANNED} SELECT file_name, n.cluster_id, target_path FROM n JOIN named USING (cluster_id)")
def full_import(spark, sf_dir):
    """A whole import over tables: no library, events by gap, names and targets."""
    media, _ = importing.organise(_media(spark, sf_dir), importing.nothing(spark), CONFIG)
    return media.select("file_name", "cluster_id", "target_path")


IMPORTED = f"""WITH {LIBRARY}, m AS ({MEDIA}), a AS ({EXPANDING}),
free AS (SELECT m.* FROM m LEFT JOIN a USING (file_name) WHERE a.cluster_id IS NULL),
d AS (SELECT *, date - lag(date) OVER (ORDER BY date NULLS LAST, file_name) AS delta FROM free),
f AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date NULLS LAST, file_name) = 1 OR delta > INTERVAL 2 MINUTE THEN 1 ELSE 0 END AS opens FROM d WHERE event_type <> 'error'),
n AS (SELECT *, CAST((SELECT max(cluster_id) FROM l) + sum(opens) OVER (ORDER BY date NULLS LAST, file_name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id FROM f), {NAMED}
SELECT file_name, cluster_id, 'EXISTING_CLUSTER' AS status, 'existing/' || regexp_extract(path, '[^/]+$') AS target_path FROM a JOIN l USING (cluster_id)
UNION ALL SELECT file_name, cluster_id, 'NEW_CLUSTER', target_path FROM n JOIN named USING (cluster_id)
UNION ALL SELECT file_name, NULL, 'DUPLICATE', NULL FROM m WHERE event_type = 'error'"""


@query(IMPORTED)
def full_import_with_library(spark, sf_dir):
    """A whole import over tables that also extends library events."""
    from dataclasses import replace

    config = replace(CONFIG, use_existing=True, libraries=("/lib",), gap=SMALL)
    media, _ = importing.organise(_media(spark, sf_dir, "error"), _library(spark, sf_dir), config)
    return media.select("file_name", "cluster_id", "status", "target_path")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their folder names, from the media timeline."""
    return cluster_names(spark, sf_dir)

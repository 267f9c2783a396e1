"""Held-out accuracy and SQL on the driver's tables."""

import os

import duckdb
import pytest

from eventloom.llm import queries as q

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_language_of_held_out_documents(spark):
    got = q.op3_language_id(spark, FOLDER).filter("held_out").join(table(spark, "documents"), "doc_id")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 200 and right / n > 0.98


def test_quality_of_labelled_documents(spark):
    got = q.op2_quality_rules(spark, FOLDER).join(table(spark, "labels"), "doc_id").filter("not base_failed")
    rates = {r.quality: r.r for r in got.selectExpr("quality", "cast(kept as int) k").groupBy("quality").agg({"k": "avg"}).withColumnRenamed("avg(k)", "r").collect()}
    assert rates[1] > 0.98 and rates[0] < 0.05


def test_mix_meets_its_targets(spark):
    rows = q.op1_mix_sources(spark, FOLDER).join(table(spark, "documents").select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source", "target", "source_size").agg({"taken": "sum", "size": "sum"}).collect()
    assert len(per) == 20 and all(abs(r["sum(taken)"] - r.target) <= 1 and r["sum(size)"] == r.source_size for r in per)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = q.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({q.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())

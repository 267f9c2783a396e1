"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns, an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import chat, curve_packing, exact_dedup, language, licenses, mixing, pii, quality, simhash, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet, 10.0.0.1 a@b.co\n" * 20_000
TEXTS = [None, "", " \n", "word", "the mit license", "café au lait " * 30, LONG, "same text of some words", "same  text of some words", "call +1 555 123 4567"]
ROWS = [(i, t, ("en", "fr", None)[i % 3], ("a", None)[i % 2], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], ROWS[7], (None, None, None, None, None), (None, "same text of some words", None, "a", 1), (3, "word", "en", "a", 4)]
CLASHING = (
    "_at", "size", "words", "shard", "order", "score", "lang_pred", "key", "n", "fp", "row", "spans", "bucket", "ids", "digest", "component",
    "h", "ix", "kept", "keep_id", "held_out", "labels", "anomaly", "_metadata", "place", "taken", "start", "base", "hits", "fold",
)
LABELS = [(i, i % 2, 0) for i in range(9)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


QUERIES = {
    "op1": lambda s, d: mixing.op1(s, d), "op2": lambda s, d: quality.op2(s, d, labels(s)), "op3": lambda s, d: language.op3(s, d),
    "op4": lambda s, d: pii.op4(s, d), "op6": lambda s, d: curve_packing.op6(s, d), "op7": lambda s, d: simhash.op7(s, d),
    "op8": lambda s, d: licenses.op8(s, d), "op9": lambda s, d: exact_dedup.op9(s, d), "op10": lambda s, d: token_files.op10(s, d),
}
STAYING = {
    "identified": language.identified, "first_of_each": exact_dedup.first_of_each, "one_of_each": simhash.one_of_each,
    "mixed": lambda d: mixing.Mix(d).documents(),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.mark.parametrize("name", QUERIES)
def test_edges(spark, docs, clashing, name):
    plain = QUERIES[name](spark, docs)
    want = sorted(map(repr, plain.collect()))
    assert sorted(map(repr, QUERIES[name](spark, clashing).collect())) == want
    per_row = [r for r in want if "start=0" in r] if name == "op6" else want
    assert len(per_row) == len(ROWS)
    empty = QUERIES[name](spark, clashing.limit(0))
    assert empty.count() == 0 and empty.schema == plain.schema


@pytest.mark.parametrize("name", STAYING)
def test_rows_that_stay(docs, clashing, name):
    columns = docs.columns
    plain, more = STAYING[name](docs), STAYING[name](clashing)
    assert [c for c in more.columns if c in clashing.columns] == clashing.columns
    assert sorted(map(repr, more.select(columns).collect())) == sorted(map(repr, plain.select(columns).collect()))
    for c in CLASHING:
        assert {r[0] for r in more.select(c).distinct().collect()} == {f"own {c}"}, c
    assert STAYING[name](clashing.limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, ""), (None, None, None, None), (2, 1, "assistant", LONG), (2, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(repr, chat.op5(spark, df).collect()))
    more = df.withColumns({c: F.lit("own") for c in ("at", "head", "content", "k", "first", "n", "span", "t", "parts", "formatted", "attachments", "start", "id")})
    assert sorted(map(repr, chat.op5(spark, more).collect())) == want and len(want) == 4


def test_pipeline_on_an_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0
        none = out if out.columns == docs.columns else none

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordinata.llm import bpe, filter_audit, html_text, lm_scoring, media, minmax_dedup, packing, quality_model, quality_rules, rans, spelling, token_counts, url_filter
from ordinata.llm.queries import PATTERN, RANKS, TOKENIZER, WORD_TOKENIZER

LONG = "lorem ipsum dolor sit amet consectetur " * 4000 + "x" * 30_000
TEXTS = [None, "", " \n\t ", "one", "a b c", "the quick brown fox jumps over the lazy dog near the river bank " * 3, "Zażółć gęślą jaźń 漢字 🙂 <|endoftext|> end", LONG, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value double, batch long, shard int, band long, bands string, near int, ids string, n int, c int"


def documents(spark):
    rows = [(i, t, None, None, None, 1.0, 2, 3, 4, "b", 5, "i", 6, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", *rows[0][2:])], SCHEMA)


def pages(spark):
    html = "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b</p></article></body>"
    return spark.createDataFrame([(1, None, None, 1, 2), (2, "", "", 1, 2), (3, "no scheme", "<p>", 1, 2), (4, "http://A.example.org/es/1?x#y", html, 1, 2), (4, "http://A.example.org/es/1?x#y", html, 1, 2), (None, "https://x.net", html * 300, 1, 2)], "page_id long, url string, html string, host int, length int")


OPERATORS = {
    "packing": lambda d: packing.pack(d, TOKENIZER, RANKS, PATTERN),
    "lm": lm_scoring.score,
    "counts": lambda d: token_counts.count_tokens(d, RANKS, PATTERN),
    "statistics": quality_model.describe,
    "rules": lambda d: quality_rules.judge(d).select("doc_id", "quality_rules.*"),
    "dedup": minmax_dedup.near_duplicates,
    "media": media.store_and_describe,
    "encode": lambda d: bpe.encode(d, RANKS, PATTERN),
    "round trip": lambda d: bpe.round_trip(d, RANKS, PATTERN),
    "ids": lambda d: rans.store_and_read(d, WORD_TOKENIZER),
    "flags": filter_audit.described,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, name):
    out = OPERATORS[name](documents(spark)).collect()
    got = [r["doc_id"] for r in out]
    want = [*range(len(TEXTS)), 5, None]
    if name == "packing":
        assert set(got) == set(want)
    else:
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark).limit(0)).collect() == []


def test_odd_words_and_filters(spark):
    """Clashing columns, nulls and empty tables in the operators whose rows are not documents."""
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and all(r["kept"] + r["removed"] <= len(TEXTS) + 2 for r in got)
    assert {(r["good_lost"], r["toxic_lost"]) for r in got if r["filter_order"][0] == "A" and r["step"] == 1} == {(2, 2)}
    assert filter_audit.audit(docs.limit(0), labels).collect() == [] and len(filter_audit.audit(docs, labels.limit(0)).collect()) == 600
    words = {r["word"]: r["n"] for r in spelling.variants(docs).collect()}
    assert words["lorem"] % 4000 == 0 and words["quick"] >= 3
    assert spelling.variants(docs.limit(0)).collect() == []


def test_odd_pages(spark):
    text = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark)).collect()}
    assert (text[1], text[2], text[3], text[4]) == ("", "", "", "T\n\na & b")
    judged = url_filter.judge(pages(spark)).collect()
    assert len(judged) == 6 and {(r["host"], r["path"], r["rule"], r["verdict"]) for r in judged if r["page_id"] == 4} == {("a.example.org", "/es/1", "example.org/es/", "block")}
    assert {(r["host"], r["path"]) for r in judged if r["page_id"] in (1, 2, 3)} == {("", "")}
    assert html_text.extract(pages(spark).limit(0)).collect() == [] and url_filter.judge(pages(spark).limit(0)).collect() == []


def test_copies_are_grouped(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(documents(spark)).collect()}
    assert got[7][1] == got[8][1] == 7 and (got[7][2], got[8][2]) == (True, False)
    assert got[0] == (0, 0, True) and got[2] == (0, 2, True) and got[3] == (1, 3, True) and got[None][1:] == (None, True)


def test_packing_stage_takes_odd_rows(spark, tmp_path):
    docs = documents(spark)
    pack = corpus_pipeline.STAGES[3][1]
    assert {r["doc_id"] for r in pack(spark, docs, str(tmp_path)).collect()} == {*range(len(TEXTS)), None}
    assert pack(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_rows_of_one_id(spark):
    """Rows that share a doc_id and a text are one document; those that differ in text are grouped by their own."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:58], "x", "y"]), "quite another text of its own"
    docs = spark.createDataFrame([(5, a), (5, a), (5, c), (3, b), (None, a), (None, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(docs).collect()), key=str)
    assert [g for g in got if g[0] is None] == [(None, 56, None, True)] * 2
    assert (3, 56, 3, True) in got and got.count((5, 56, 3, False)) + got.count((5, 56, 5, True)) == 2 and len(got) == 6


def test_ties_and_repeats_in_scores(spark):
    """Copies of one row beyond a batch, without ids, are scored like any."""
    docs = spark.createDataFrame([(None, "a b a b")] * 50 + [(1, "a b")], "doc_id long, text string")
    got = lm_scoring.score(docs).collect()
    assert len(got) == 51 and len({r["mean_log_score"] for r in got if r["doc_id"] is None}) == 1


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    minmax_dedup.near_duplicates(documents(spark)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_the_columns(spark, tmp_path, stage):
    docs = documents(spark)
    spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_model_without_both_classes_scores_a_half(spark):
    model = quality_model.fit(quality_model.describe(documents(spark)).withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality_model.score(quality_model.describe(documents(spark)), model).collect()} == {0.5}

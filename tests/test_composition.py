"""Compatibility composition of the rows that need it."""

from unicodedata import normalize

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import dedup, runs, studies

TEXTS = ["plain", "Café", "Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ligature", "e\u0301", "x²", None, "", "１０．１０００／ａｂｃ", "가", "ﾊﾟ"]


def test_same_as_unicodedata(spark):
    rows = [(k, t, [t, "ﬃ", None] if k % 2 else ([] if t else None)) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, title string, authors array<string>")
    out = {r["id"]: r for r in text.with_nfkc(df, ["title", "authors"]).collect()}
    form = lambda t: None if t is None else normalize("NFKC", t)
    assert len(out) == len(rows)
    for k, t, a in rows:
        assert out[k]["title"] == form(t) and out[k]["authors"] == (None if a is None else [form(x) for x in a])


def test_records_match_over_forms(spark):
    rows = [(1, "pubmed", "10.1000/ABC", "The ﬁne Full width", ["Lee Ａ"]), (2, "arxiv", "１０．１０００／ａｂｃ", "The fine Ｆｕｌｌ width", ["Lee A"])]
    df = spark.createDataFrame(rows, "record_id int, source string, raw_doi string, title string, authors array<string>")
    df = df.withColumns({"source_updated_at": F.lit("2023-01-01").cast("timestamp_ntz"), "pub_year": F.lit(2001), "citation_count": F.lit(1)})
    got = dedup.normalize_records(df, "2024-01-01 00:00:00").select("doi_norm", "title_norm", "authors_norm", "fingerprint", "dedup_key").distinct().collect()
    assert len(got) == 1 and got[0]["doi_norm"] == "10.1000/abc"


def test_study_merge_keeps_structs(spark):
    o = lambda m, r, e=None: (m, "snippet", r, e)
    rows = [
        ("s", 0, "Old", "long excerpt", None, [o("a", "x", "1"), o("a", "x", "2"), o(None, None)]),
        ("s", 1, "New", "same length!", 0, [o("b", "y"), o("a", "x", "3"), o("", "")]),
        ("t", 0, "Alone", None, 0, [o("a", "x"), o("a", "x")]),
        ("u", 0, "None", "e", 4, None),
        (None, 0, "no id", "e", 4, None),
    ]
    df = spark.createDataFrame(rows, "study_id string, ordinal int, title string, abstract_excerpt string, citation_count int, outcomes array<struct<outcome_measured:string,citation_snippet:string,key_result:string,effect_size:string>>")
    got = {r["study_id"]: r for r in studies.merge_studies(df).collect()}
    assert set(got) == {"s", "t", "u"}
    assert (got["s"]["title"], got["s"]["abstract_excerpt"], got["s"]["citation_count"]) == ("New", "long excerpt", None)
    assert [tuple(x) for x in got["s"]["outcomes"]] == [o("a", "x", "1"), o(None, None), o("b", "y")]
    assert len(got["t"]["outcomes"]) == 2 and got["u"]["outcomes"] == [] and got["u"]["citation_count"] == 4


def test_cells_of_a_runs_columns(spark):
    rows = spark.createDataFrame([(1, "r", "A", None), (2, "s", "B", 3)], "run_id int, key string, title string, year int")
    columns = spark.createDataFrame([(1, "year", 1), (1, "title", 2), (2, "other", 1)], "run_id int, column_key string, position int")
    got = [tuple(r) for r in runs.cells_by_run(rows, columns, ["key"], ["title", "year"]).orderBy("run_id", "position").collect()]
    assert got == [(1, "r", "year", 1, None, "missing"), (1, "r", "title", 2, "A", "filled"), (2, "s", "other", 1, None, "missing")]

from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import extraction as X
from quillspark.functions import hashing, scores, similarity
from quillspark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, D.normalize_doi(F.lit(" https://doi.org/10.1234/AbC-1 "))) == "10.1234/abc-1"
    assert one(spark, D.normalize_doi(F.lit("doi:10.5555/XYZ.2024"))) == "10.5555/xyz.2024"
    assert one(spark, D.normalize_doi(F.lit("  "))) is None
    assert one(spark, D.is_valid_doi(F.lit("10.1000/xyz"))) is True
    assert one(spark, D.is_valid_doi(F.lit("abc/10.1000"))) is False
    assert one(spark, D.is_valid_doi(F.lit(None).cast("string"))) is False


def test_record_quality(spark):
    d = [F.lit(v).cast("decimal(6,5)") for v in ("1.0", "0.9", "0.8", "0.7")]
    assert str(one(spark, scores.record_quality(*d))) == "90.00"


def test_sample_size(spark):
    assert one(spark, X.sample_size(F.lit("Methods: n=150 adults were enrolled."))) == 150
    assert one(spark, X.sample_size(F.lit("A total of 420 participants completed follow-up."))) == 420
    assert one(spark, X.sample_size(F.lit("No size."))) is None


def test_outcome_parts(spark):
    s = F.lit("Melatonin versus placebo improved sleep quality (OR = 1.45) with p = 0.02.")
    assert one(spark, X.effect_size(s)) == "OR = 1.45"
    assert one(spark, X.p_value_or_interval(s)) == "p = 0.02"
    assert one(spark, X.comparison(s)["intervention"]) == "Melatonin"


def test_query_steps(spark):
    q = F.lit("What are the effects of Melatonin 10mg versus placebo")
    assert one(spark, T.normalize_query(q)) == "outcomes associated with melatonin 10 mg vs placebo"
    assert "without" in one(spark, T.query_terms(F.lit("sleep without stress")))


def test_hash_of_empty_text(spark):
    assert one(spark, hashing.fnv1a(F.lit(""))) == "811c9dc5"
    assert one(spark, hashing.fnv1a(F.lit("a"))) == "e40c292c"


def test_similarity_of_nothing(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, similarity.jaccard(empty, empty)) == 0.0
    assert one(spark, similarity.text_similarity(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, similarity.text_similarity(F.lit("sleep loss"), F.lit("sleep loss"))) == 1.0


def test_abstract_from_index(spark):
    index = F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, T.abstract_of(index)) == "hello world hello"

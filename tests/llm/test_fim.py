import hashlib
import re

from pyspark.sql import functions as F

from quillspark.llm import fim
from quillspark.llm.queries import op13_fill_in_middle

from .helpers import odd_documents


def plain(text, key):
    """The same cut with Python's own means."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(key.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_plain_python(spark):
    texts = ["", "a", "Hello, World 12", "ß<P", "<P", ">", "a<P>b", "x<S>", "<M>", "\n\r  \0é🙂東京 $1 \\2 {3}", "aaaa", "1 2", "<S", "S><M", "Z" * 9, None, "a b c d e f g\n" * 40]
    rows = [(k, t, "row", "n", k) for k in range(40) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n string, fim long")
    out = fim.transform(docs, F.concat(F.lit("1:"), F.col("doc_id").cast("string"))).withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form")))
    assert out.columns == ["doc_id", "text", "row", "n", "fim", "back"]
    got = out.collect()
    assert len(got) == len(rows) and {r["row"] + r["n"] for r in got} == {"rown"}
    for r in got:
        assert tuple(r["fim"]) == plain(r["text"] or "", f"1:{r['doc_id']}") and r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    texts = ["1" * 2_000_000, "ab " * 700_000, "x" * 3_000_000, "🙂" * 500_000]
    docs = spark.createDataFrame([(k, t) for k in range(3) for t in texts], "doc_id int, text string")
    out = fim.transform(docs, F.col("doc_id").cast("string")).select("doc_id", "text", "fim", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back"))
    for r in out.collect():
        assert tuple(r["fim"]) == plain(r["text"], str(r["doc_id"])) and r["back"] == r["text"]


def test_shares_odd_documents_and_empty_table(spark):
    docs = odd_documents(spark)
    key = F.col("doc_id").cast("string")
    assert {r["fim"]["form"] for r in fim.transform(docs, key, plain_percent=100).collect()} == {"plain"}
    forms = [r["fim"]["form"] for r in fim.transform(docs.where("text <> ''"), key, plain_percent=0, spm_percent=100).collect()]
    assert set(forms) == {"spm"} and len(forms) == 7
    assert fim.transform(docs.where("false"), key).count() == 0


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, output = plain(docs[r["doc_id"]], f"1:{r['doc_id']}")
        assert tuple(r) == (r["doc_id"], n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())

import json

from quillspark.sources import readers, writers
from quillspark.views import view


def test_json_mappers(spark, tmp_path):
    (tmp_path / "oa.json").write_text(json.dumps({"id": "W1", "title": None, "publication_year": 2020, "doi": "https://doi.org/10.1/X", "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "Lee A"}}]}))
    row = readers.openalex(spark, str(tmp_path / "oa.json"), 2024).first()
    assert (row["title"], row["abstract"], row["authors"], row["doi"]) == ("Untitled", "a b", ["Lee A"], "10.1/x")
    (tmp_path / "s2.json").write_text("\n".join(json.dumps({"paperId": str(i), "title": "t", "abstract": "x" * n, "year": None}) for i, n in enumerate((50, 51))))
    rows = readers.semantic_scholar(spark, str(tmp_path / "s2.json"), 2024).collect()
    assert [(r["paper_id"], r["year"], r["authors"]) for r in rows] == [("1", 2024, ["Unknown"])]


def test_xml_mappers(spark, tmp_path):
    text = "An abstract that is certainly longer than fifty characters, is it not?"
    (tmp_path / "p.xml").write_text(f"<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>Sleep</ArticleTitle><Abstract><AbstractText>{text}</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><Year>2021</Year></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Lee</LastName><Initials>A</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>")
    row = readers.pubmed(spark, str(tmp_path / "p.xml"), 2024).first()
    assert (row["paper_id"], row["year"], row["authors"], row["venue"]) == ("7", 2021, ["Lee A"], "J")
    (tmp_path / "a.xml").write_text(f"<feed><entry><id>http://arxiv.org/abs/2101.00001v3</id><title>Big\n title</title><summary>{text}</summary><published>2021-01-01T00:00:00Z</published><author><name>Kim B</name></author></entry></feed>")
    row = readers.arxiv(spark, str(tmp_path / "a.xml"), 2024).first()
    assert (row["paper_id"], row["title"], row["year"], row["authors"]) == ("2101.00001", "Big title", 2021, ["Kim B"])


def test_exports_and_snapshots(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.catalog.report import exported
    from quillspark.operators import report

    rows = exported(spark, sf)
    writers.write_outcome_csv(rows, f"{tmp_path}/csv")
    writers.write_paper_csv(rows, f"{tmp_path}/papers")
    writers.write_ris(rows, f"{tmp_path}/ris")
    assert spark.read.text(f"{tmp_path}/csv").count() == rows.agg(F.sum(F.greatest(F.size("outcomes"), F.lit(1)))).first()[0] + 1
    parts = sorted(p for p in (tmp_path / "papers").iterdir() if p.name.startswith("part"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == report.PAPER_HEADER and len(lines) == rows.count() + 1
    base = f"file://{tmp_path}/snap"
    writers.publish(rows, base, "r1")
    writers.publish(rows.limit(3), base, "r2")
    assert writers.published(spark, base).count() == 3


def test_search_plan(spark, sf):
    from quillspark.plans import runs
    from quillspark.views import CURRENT_YEAR

    out = runs.answer(view(spark, sf, "studies"), "What are the effects of placebo on sleep quality", CURRENT_YEAR, rows=20)
    assert 0 < out["evidence"].count() <= 20 and out["studies"].count() > 0

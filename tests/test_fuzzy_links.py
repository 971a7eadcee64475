import random

import duckdb
import pytest

from quillspark.catalog import dedup as catalog
from quillspark.operators import dedup
from quillspark.operators.dedup import fuzzy_edges, fuzzy_groups
from quillspark.storage import materialise

from .oracle import TABLES, assert_same

SCHEMA = "record_id string, pub_year int, authors_norm string, title_norm string, key_type string, is_deleted boolean, fingerprint string"


def rows(spark, seed, n=160):
    """Few titles, some a word apart, and none to five names of few, so that all sizes meet."""
    rng = random.Random(seed)
    titles = ["effects of sleep on pain in adults with chronic disease", "effects of sleep on pain in adult with chronic disease", "effects of sleep on pains in adults with chronic diseases", "sleep", "another trial of quite something else", None, "pain in adults of sleep on effects with chronic disease"]
    out = []
    for i in range(n):
        names = "|".join(rng.sample("abcdef" if i % 2 else "abcdefghijkl", rng.choice([0, 1, 2, 2, 3, 3, 3, 5]))) or None
        out.append((f"r{i:04d}", rng.choice([None, 2001, 2002, -1]), names, rng.choice(titles), "doi" if rng.random() < 0.05 else "fingerprint", rng.random() < 0.05, f"f{rng.randrange(10**6)}"))
    return materialise(spark.createDataFrame(out, SCHEMA), "rows")


@pytest.mark.parametrize("seed, title_similarity, overlap", [(1, 0.92, 0.5), (2, 0.7, 0.5), (4, 0.7, 0.667)])
def test_links_give_the_groups_of_all_pairs(spark, seed, title_similarity, overlap):
    held = rows(spark, seed)
    edges = materialise(fuzzy_edges(held, title_similarity, overlap), "edges")
    links = materialise(dedup.fuzzy_links(held, title_similarity, overlap), "links")
    pairs = {(r["a"], r["b"]): r["similarity"] for r in edges.collect()}
    thin = {(r["a"], r["b"]): r["similarity"] for r in links.collect()}
    assert thin and all(pairs.get(k) == v for k, v in thin.items())
    assert sorted(fuzzy_groups(held, links).collect()) == sorted(fuzzy_groups(held, edges).collect())


def test_links_of_one_title_grow_with_its_records(spark, monkeypatch):
    """All share a title and a name: 300 records are 44,850 pairs, of which grouping needs 299."""
    out = [(f"r{i:04d}", 2001, f"a|b{i % 100}", "effects of sleep on pain", "fingerprint", False, f"f{i}") for i in range(300)]
    held = materialise(spark.createDataFrame(out, SCHEMA), "rows")
    seen = []
    monkeypatch.setattr(catalog, "normalized", lambda *_: held)
    monkeypatch.setattr(dedup, "fuzzy_groups", lambda records, edges: seen.append(edges.count()) or fuzzy_groups(records, edges))
    found = catalog.dedup_components(spark, "").collect()
    assert seen[0] <= 600 and {(r["root"], r["group_size"], r["confidence"]) for r in found} == {("r0000", 300, 1.0)}


def test_coverage_groups_by_links(spark, sf, monkeypatch):
    """The records of one title that share names make all pairs; ``dedup_coverage`` mustn't list them."""
    monkeypatch.setattr(dedup, "fuzzy_edges", lambda *_: pytest.fail("all pairs were listed"))
    assert catalog.dedup_coverage(spark, sf).first()["records"] > 0


@pytest.mark.parametrize("name", ["dedup_components", "dedup_coverage", "dedup_duplicate_rate"])
def test_records_that_share_an_id_stay_single_rows(spark, tmp_path, name):
    """The views keep six digits of an id, so from a million documents on ten share one."""
    full = "/root/testdata/sf0.01"
    for t in TABLES:
        if t in ("documents", "labels"):
            duckdb.sql(f"copy (select * replace (doc_id + 999500 as doc_id) from '{full}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"{full}/{t}.parquet")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLE_SQL[name], str(tmp_path))

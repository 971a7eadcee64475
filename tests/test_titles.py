"""Titles by edits against all pairs, and the merge by arrival against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from quillspark.catalog.enrichment import arriving, legacy_dedup, legacy_reasons
from quillspark.operators import titles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pairs_against_all_pairs(spark):
    rng, rows = random.Random(5), []
    for size in (0, 1, 2, 3, 5, 12, 36, 37, 38, 39, 40, 41, 42, 43, 44, 60):
        base = "".join(rng.choice("abé") for _ in range(size))
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at, kind = rng.randint(0, len(t)), rng.choice("idr")
                if kind == "i":
                    t.insert(at, rng.choice("abé "))
                elif at < len(t):
                    t[at : at + 1] = [] if kind == "d" else [rng.choice("abé")]
            rows.append("".join(t))
    held = [(k, k % 2, t) for k, t in enumerate(rows)] + [(1000, 0, None), (1001, None, "abc")]
    df = spark.createDataFrame(held, "id long, block long, title string")
    got = {(r["probe_id"], r["known_id"]): r["distance"] for r in titles.edit_pairs(df, df).collect()}
    want = {}
    for i, x, a in held[:-2]:
        for j, y, b in held[:-2]:
            d = distance(a, b)
            if x == y and d <= (2 if len(a) <= 40 else 3):
                want[i, j] = d
    assert got == want
    assert titles.edit_pairs(df.where("false"), df).count() == 0


def looped(papers):
    """Group leader and reason of each paper, one after the other."""
    by_doi, by_title, leader, reasons = {}, {}, {}, {}
    for p in sorted(papers, key=lambda r: r["arrival"]):
        key = " ".join(sorted(re.sub(r"[^\w\s]|_", " ", p["title"].lower()).split()))
        doi = (p["doi"] or "").lower().strip()
        at, why = (by_doi[doi], "doi_match") if doi and doi in by_doi else (by_title[key], "title_exact") if key in by_title else (None, None)
        if at is None:
            near = [(d, k) for k, t in enumerate(by_title) if (d := distance(key, t)) <= (2 if len(key) <= 40 else 3)]
            if near:
                at, why = by_title[list(by_title)[min(near)[1]]], "title_fuzzy"
        leader[p["arrival"]] = p["arrival"] if at is None else at
        if why:
            reasons[p["arrival"]] = why
        by_title[key] = leader[p["arrival"]]
        if doi:
            by_doi[doi] = leader[p["arrival"]]
    return leader, reasons


def test_merge_against_a_plain_loop(spark, sf):
    papers = arriving(spark, sf).collect()
    leader, reasons = looped(papers)
    assert {r["arrival"]: r["reason"] for r in legacy_reasons(spark, sf).collect()} == reasons
    assert set(reasons.values()) == {"doi_match", "title_exact", "title_fuzzy"}
    got = {r["arrival"]: r for r in legacy_dedup(spark, sf).collect()}
    assert set(got) == set(leader.values())
    for at, row in got.items():
        group = sorted((p for p in papers if leader[p["arrival"]] == at), key=lambda p: p["arrival"])
        assert row["papers"] == len(group) and row["title"] == group[0]["title"] and row["citation_count"] == max(p["citation_count"] for p in group)
        assert row["doi"] == next((p["doi"] for p in group if p["doi"]), None)


def test_families_make_few_pairs(spark):
    """Titles that share their first or last words meet only where they are nearly alike."""
    rng = random.Random(3)
    numbers = rng.sample(range(10**6, 10**7), 1500)
    for rows in ([f"large ring trial {n}" for n in numbers], [f"{n} large ring trial" for n in numbers]):
        df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(rows)], "id long, block int, title string")
        backwards = titles._backwards(df)
        assert titles._by_tails(df, df, backwards).where("a < b").distinct().count() < 10 * len(rows)
        want = {(i, j) for i, a in enumerate(numbers) for j, b in enumerate(numbers) if sum(x != y for x, y in zip(str(a), str(b))) <= 2}
        got = {(r["probe_id"], r["known_id"]) for r in titles.edit_pairs(df, df).where("distance <= 2").collect()}
        assert want <= got


def test_nearest_before_against_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(11), set()
    for size in (0, 1, 2, 3, 4, 5, 8, 12, 20, 36, 37, 38, 39, 40, 41, 42, 43, 44, 60):
        for alphabet in ("abé", "a\x01\x02b"):
            base = "".join(rng.choice(alphabet) for _ in range(size))
            for _ in range(8):
                t = list(base)
                for _ in range(rng.randint(0, 4)):
                    at, kind = rng.randint(0, len(t)), rng.choice("idr")
                    if kind == "i":
                        t.insert(at, rng.choice(alphabet))
                    elif at < len(t):
                        t[at : at + 1] = [] if kind == "d" else [rng.choice(alphabet)]
                rows.add("".join(t))
    rows |= {f"{rng.randint(0, 12000)} {a} {b} trial" for a in ("old", "cold", "red") for b in ("bolt", "rod") for _ in range(25)}
    rows = sorted(rows)
    rng.shuffle(rows)
    # Once in tasks of their own, once with the keys of all but the smallest families dealt.
    for way, most in ((str, titles.FAMILY), (lambda t: t[::-1], 2)):
        monkeypatch.setattr(titles, "FAMILY", most)
        held = [(3 * k, k % 2 if len(t) < 10 else 0, way(t), rng.random() < 0.8) for k, t in enumerate(rows)]
        df = spark.createDataFrame([*held, (100000, 0, None, True), (100001, None, "abc", True)], "id long, block long, title string, asks boolean")
        want = {}
        for i, x, a, asks in held:
            near = [(d, j) for j, y, b, _ in held if asks and j < i and x == y and abs(len(a) - len(b)) <= 3 and (d := distance(a, b)) <= (2 if len(a) <= 40 else 3)]
            if near:
                want[i] = min(near)
        assert {r["id"]: (r["distance"], r["first"]) for r in titles.nearest_before(df).collect()} == want
    assert titles.nearest_before(df.where("false")).count() == 0


def test_families_are_not_paired(spark, monkeypatch):
    """All titles of a family are near each other; what is shuffled for them grows as their number does."""
    shuffled = []
    firsts, verified = titles._firsts, titles._verified
    monkeypatch.setattr(titles, "_firsts", lambda rows, *rest: shuffled.append(rows.count()) or firsts(rows, *rest))
    monkeypatch.setattr(titles, "_verified", lambda met, *rest: shuffled.append(met.count()) or verified(met, *rest))
    counts = []
    for copies in (50, 100):
        rows = [(k * 1000 + n, "large ring", f"{1000000 + 7000 * k + n} large ring trial") for n in range(20) for k in range(copies)]
        papers = spark.createDataFrame(rows, "arrival long, doi string, title string").withColumn("doi", F.lit(None).cast("string"))
        shuffled.clear()
        reasons = {r["arrival"]: r["reason"] for r in titles.arrival_parents(papers).collect()}
        assert [a for a, why in reasons.items() if why is None] == [0]
        counts.append(sum(shuffled))
    assert counts[0] < 10 * 50 * 20 and counts[1] < 2.2 * counts[0]


def test_merge_of_a_family_against_a_plain_loop(spark, monkeypatch):
    """A family is merged without pairs of its titles, whether one task makes its keys or many."""
    monkeypatch.setattr(titles, "edit_pairs", None)
    rng = random.Random(7)
    numbers = rng.sample(range(1, 40000), 250)
    rows = [{"arrival": 5 * k, "doi": f"10.1/{n % 40}" if n % 3 == 0 else None, "title": f"{rng.choice(['old', 'cold'])} ring {n}", "abstract": "x" * (n % 7), "citation_count": n % 11, "pubmed_id": None} for k, n in enumerate(numbers)]
    leader, _ = looped(rows)
    papers = spark.createDataFrame(rows, "arrival long, doi string, title string, abstract string, citation_count long, pubmed_id string")
    for most in (titles.FAMILY, 10):
        monkeypatch.setattr(titles, "FAMILY", most)
        got = {r["arrival"]: (r["papers"], r["title"], r["citation_count"]) for r in titles.arrival_merge(papers).collect()}
        want = {}
        for at in set(leader.values()):
            group = [p for p in rows if leader[p["arrival"]] == at]
            want[at] = (len(group), group[0]["title"], max(p["citation_count"] for p in group))
        assert got == want

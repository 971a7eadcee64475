"""Canonical papers against a plain loop over arrivals."""

import random

from quillspark.operators import canonical

STOP = set("a an and are as at by for from in is it of on or that the to with".split())


def tokens(text):
    return {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if len(w) > 2 and w not in STOP}


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def looped(papers):
    roots, index, out = [], {}, {}
    for p in sorted(papers, key=lambda r: r["arrival"]):
        ids = [(kind, v) for kind, v in (("doi", p["doi"]), ("pmid", p["pubmed_id"]), ("arxiv", p["arxiv_id"] or (p["paper_id"] if p["source"] == "arxiv" else None))) if v]
        at = next((index[i] for i in ids if i in index), None)
        if at is None:
            for k, r in enumerate(roots):
                near = not r["year"] or not p["year"] or abs(r["year"] - p["year"]) <= 1
                if near and share(tokens(r["title"]), tokens(p["title"])) >= 0.78 and share(tokens(" ".join(r["authors"])), tokens(" ".join(p["authors"]))) >= 0.2:
                    at = k
                    break
        if at is None:
            at = len(roots)
            roots.append(dict(p))
        roots[at]["year"] = roots[at]["year"] or p["year"]
        index.update(dict.fromkeys(ids, at))
        out[p["paper_id"]] = roots[at]["paper_id"]
    return out


def made(seed, n):
    rng, rows = random.Random(seed), []
    words = "sleep loss adult memory trial dose night review".split()
    for k in rng.sample(range(10 * n), n):
        title = " ".join(rng.choices(words, k=rng.choice([0, 2, 4, 5, 5, 6])))
        rows.append({"arrival": k, "paper_id": f"x{k:05d}", "source": rng.choice(["arxiv", "pubmed"]), "doi": rng.choice([None, None, None, f"10.1/{rng.randint(0, n // 4)}"]), "pubmed_id": rng.choice([None, None, "", f"{rng.randint(0, n // 3)}"]), "arxiv_id": rng.choice([None, None, None, f"{rng.randint(0, n)}"]),
                     "title": title, "authors": rng.choices(["Lee A", "Kim Bob", "Ito Cay", ""], k=rng.choice([0, 1, 2])), "year": rng.choice([None, None, 0, 2001, 2002, 2003, 2004]), "group_id_": "kept"})
    return rows


SCHEMA = "arrival long, paper_id string, source string, doi string, pubmed_id string, arxiv_id string, title string, authors array<string>, year int, group_id_ string"


def test_groups_against_a_plain_loop(spark):
    for seed, n in ((1, 60), (2, 150), (3, 150)):
        rows = made(seed, n)
        got = canonical.arrival_groups(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r["paper_id"]: r["group_id"] for r in got} == looped(rows) and len(got) == n


def test_no_papers(spark):
    assert canonical.arrival_groups(spark.createDataFrame([], SCHEMA)).count() == 0

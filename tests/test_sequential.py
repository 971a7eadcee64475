"""The two order-dependent operators against plain loops."""

import datetime

from quillspark.catalog.operations import rate_events, rate_limit_admitted
from quillspark.catalog.search import claims_greedy
from quillspark.operators import search
from quillspark.views import view


def test_admission_by_plain_loop(spark, sf):
    rows = sorted((f, c, int(t.replace(tzinfo=datetime.UTC).timestamp()), e) for f, c, t, e in ((r["function_name"], str(r["client"]), r["created_at"], r["event_id"]) for r in rate_events(spark, sf).collect()))
    passed, want = {}, {}
    for f, c, at, e in rows:
        recent = [t for t in passed.get((f, c), []) if t >= at - 6 * 3600]
        want[e] = len(recent) < 3
        passed[f, c] = recent + [at] if want[e] else recent
    assert {r["event_id"]: r["allowed"] for r in rate_limit_admitted(spark, sf).collect()} == want


def test_greedy_clusters_by_plain_loop(spark, sf):
    stop = set("a an and are as at by for from in is it of on or that the to with".split())
    tokens = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if len(w) > 2 and w not in stop}
    claims = sorted((r["study_id"] // 50, r["study_id"], r["at"], f"{r['outcome']} {r['sentence']}") for r in search.claims(view(spark, sf, "studies")).collect())
    held, want = {}, {}
    for batch, study, at, text in claims:
        own, groups = tokens(text), held.setdefault(batch, [])
        scores = [len(own & g) / len(own | g) for g in groups]
        best = max(scores, default=0)
        k = scores.index(best) if scores and best >= 0.42 else len(groups)
        if k == len(groups):
            groups.append(set())
        groups[k] |= own
        want[study, at] = k
    assert {(r["study_id"], r["at"]): r["cluster"] for r in claims_greedy(spark, sf).collect()} == want


def test_rate_counts_to_the_microsecond(spark):
    """Neither a request of the same second that comes later counts, nor one more than an hour ago by a fraction."""
    from quillspark.catalog.operations import ORACLE_SQL
    from quillspark.operators.operations import rate_counts

    times = ["2024-01-01 00:00:00.400000", "2024-01-01 00:00:00.600000", "2024-01-01 01:00:00.400000", "2024-01-01 01:00:00.500000", "2024-01-01 01:00:00.700000"]
    df = spark.createDataFrame([(k, "search", 1, t) for k, t in enumerate(times)], "event_id long, function_name string, client long, t string").selectExpr("*", "cast(t as timestamp_ntz) created_at")
    got = {r["event_id"]: r["in_window"] for r in rate_counts(df).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3}
    import duckdb

    con = duckdb.connect()
    con.execute("create table events as select * from (values " + ", ".join(f"({k}, 'search', 1, timestamp '{t}')" for k, t in enumerate(times)) + ") v(event_id, event_type, user_id, ts)")
    assert {k: n for k, n, _ in con.execute(ORACLE_SQL["rate_limit_counts"]).fetchall()} == got

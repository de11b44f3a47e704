import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.operators import investigations as I

T0 = datetime(2024, 1, 1)


def test_context_equals_a_plain_search_and_names_its_errors(spark):
    rng = random.Random(1)
    at = lambda: T0 + timedelta(minutes=rng.randrange(0, 600, 30))  # many equal times, also on the ends of blocks
    agent = lambda: rng.choice(["a", "b", None])
    anomalies = [(f"x{i % 37}" if i else None, agent(), at()) for i in range(40)] + [("late", "a", T0 + timedelta(days=9)), ("x0", "a", None)]
    errors = [(agent(), at() if i else None, f"e{i % 150}", "T", f"m{i % 150}") for i in range(200)]
    points = [(agent(), at(), rng.choice(["d", "c"]), rng.choice([None, 1.5, 2.0, 40.0])) for _ in range(200)]
    out = I.investigation_context(
        spark.createDataFrame(anomalies, "anomaly_id string, agent_id string, ts timestamp"),
        spark.createDataFrame(errors, "agent_id string, ts timestamp, error_id string, error_type string, error_message string"),
        spark.createDataFrame(points, "agent_id string, ts timestamp, measure_name string, measure_value double"),
        hours=2, n_errors=4,
    )
    got = [r for r in out.collect() if r["anomaly_id"] is not None]
    assert len(got) == len(anomalies) - 1

    def inside(a, rows, i):
        return [x for x in rows if None not in (a[1], a[2], x[i]) and x[1 - i] == a[1] and a[2] - timedelta(hours=2) <= x[i] <= a[2]]

    for r in got:
        same = [a for a in anomalies if a[0] == r["anomaly_id"]]
        hits = [e for a in same for e in inside(a, errors, 1)]
        hits.sort(key=lambda e: e[2])
        hits.sort(key=lambda e: e[1], reverse=True)
        assert r["error_count"] == len(hits)
        newest = r["recent_errors"] or []
        assert [(e["r"], e["ts"], e["error_id"], e["error_message"]) for e in newest] == [(i + 1, e[1], e[2], e[4]) for i, e in enumerate(hits[:4])]
        near = [p for a in same for p in inside(a, points, 1)]
        assert set(r["metrics"] or {}) == {p[2] for p in near}
        for name, s in (r["metrics"] or {}).items():
            values = [p[3] for p in near if p[2] == name and p[3] is not None]
            wanted = (sum(values) / len(values), max(values), min(values)) if values else (None, None, None)
            assert tuple(s) == wanted


def test_many_queries_find_what_a_plain_search_finds_without_pairs_in_a_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    message = lambda: rng.choice([None, "", f"Record 4266{rng.randrange(60):03d} not found", f"Timeout for job {rng.randrange(9)}"])
    cases = [(f"i{i:03d}", rng.choice(["A", "B", "C", None]), message(), "resolved") for i in range(120)] + [("z", "D", "unlike all", "resolved")]
    asks = [(f"q{i}", rng.choice(["A", "B", "D", "E", None]), message()) for i in range(60)]
    inv = spark.createDataFrame(cases, "investigation_id string, error_type string, error_message string, resolution_status string")
    queries = spark.createDataFrame(asks, "query_id string, error_type string, error_message string")
    monkeypatch.setattr(I, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(I, "BLOCK_QUERIES", 5)
    met = []
    nearest = I._nearest
    monkeypatch.setattr(I, "_nearest", lambda *a, **kw: met.append(nearest(*a, **kw)) or met[-1])
    rows = lambda df: sorted((r["query_id"], r["rank"], r["investigation_id"], round(r["similarity_score"], 12)) for r in df.collect())
    assert rows(I.similar_investigations(queries, inv, max_queries=0)) == rows(I.similar_investigations(queries, inv))
    # Of every block a query gets at most five texts, whatever it shares with the others.
    assert met and all(m.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5 * 18 for m in met if not m.isEmpty())

"""Search, similarity, privacy and question logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import privacy as V, text as X
from ...operators import investigations as I, privacy as J, querylog as L, search as Q
from .. import sample as S
from .registry import query

_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)"
_GRAMS = f"list_distinct(flatten(list_transform({_WORDS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a, b):
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce({shared} / nullif(len({a}) + len({b}) - {shared}, 0), 0.0)"


@query("F-21", f"""
SELECT investigation_id, len(g) AS grams, round({_sim('g', 'h')}, 6) AS similarity FROM (
  SELECT investigation_id, {_GRAMS.format(c="coalesce(error_message, '')")} AS g, {_GRAMS.format(c="'Request 7 failed after 3 retries'")} AS h FROM inv)""")
def trigram_similarity(spark, d):
    m = F.col("error_message")
    other = F.lit("Request 7 failed after 3 retries")
    return S.investigations(spark, d).select("investigation_id", F.size(X.trigrams(m)).alias("grams"), X.trigram_similarity(m, other).alias("similarity"))


_SIMILAR = f"""
WITH t AS (SELECT investigation_id, error_type, error_message, resolution_status, {_GRAMS.format(c="coalesce(error_message, '')")} AS g FROM inv)
SELECT query_id, investigation_id, round(s, 6) AS similarity_score, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, investigation_id) AS r FROM (
    SELECT q.investigation_id AS query_id, t.investigation_id, CASE WHEN coalesce(t.error_type = q.error_type, false) THEN 0.5 ELSE 0.0 END + {_sim('t.g', 'q.g')} * 0.5 AS s
    FROM t JOIN t q ON t.resolution_status = 'resolved' AND q.resolution_status = 'open' AND (coalesce(t.error_type = q.error_type, false) OR {_sim('t.g', 'q.g')} > 0.3)))
WHERE r <= 5"""


def _similar(spark, d, **kw):
    inv = S.investigations(spark, d)
    asks = inv.filter("resolution_status = 'open'").select(F.col("investigation_id").alias("query_id"), "error_type", "error_message")
    return I.similar_investigations(asks, inv, **kw).select("query_id", "investigation_id", "similarity_score", "rank")


@query("J-10 UD-05", _SIMILAR)
def similar_investigations(spark, d):
    return _similar(spark, d)


@query("J-10", _SIMILAR)
def similar_investigations_by_keys(spark, d):
    return _similar(spark, d, max_queries=0)


@query("F-25", r"""
SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS root_cause, '- from ' || source AS evidence, 'Language ' || lang AS impact, 'watch ' || source AS prevention,
  '1. check ' || source || '|- reload|* notify|4. close' AS steps
FROM documents""")
def analysis_sections(spark, d):
    texts = S.analyses(spark, d)
    out = I.split_sections(texts, "doc_id", "analysis")
    return out.select("doc_id", "root_cause", "evidence", "impact", "prevention", F.array_join("remediation", "|").alias("steps"))


@query("F-26", r"""
SELECT doc_id, CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '...' ELSE x END AS summary, '1. check ' || source || '|- reload|* notify' AS actions
FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM documents)""")
def analysis_notices(spark, d):
    texts = S.analyses(spark, d)
    note = I.investigation_notice(I.split_sections(texts, "doc_id", "analysis"), "doc_id")
    return note.select("doc_id", "summary", F.array_join("immediate_actions", "|").alias("actions"))


# ---- search ----


@query("P-21", """
SELECT trace_id, start_time, CAST(a + b AS DOUBLE) AS score FROM (SELECT *, CASE WHEN root_span_name LIKE 'run-_' THEN 2.0 ELSE 0.0 END AS a, CASE WHEN agent_id = 'agent-7' THEN 1.0 ELSE 0.0 END AS b FROM tr)
WHERE a + b > 0 ORDER BY start_time DESC, trace_id LIMIT 20""")
def searched_traces(spark, d):
    traces = S.traces(spark, d).withColumn("name", F.col("root_span_name"))
    return Q.search_traces(traces, "run 7", size=20)[0].select("trace_id", "start_time", "score")


@query("P-21", """
SELECT query_id, CAST(list_aggregate(list_transform(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: CASE WHEN levenshtein(t, 'latncy') <= 2 THEN 1 - levenshtein(t, 'latncy') * 0.1 END), 'max') AS DOUBLE) AS score
FROM qs WHERE list_aggregate(list_transform(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: levenshtein(t, 'latncy')), 'min') <= 2 ORDER BY score DESC, query_id LIMIT 50""")
def fuzzy_question_search(spark, d):
    return Q.best_matches(S.questions(spark, d), "latncy", {"query": 1.0}, "query_id", 50).select("query_id", "score")


@query("P-22", "SELECT span_id, start_time FROM sp WHERE trace_id = '7-20240101' AND span_type = 'tool' AND name LIKE 'call tool%' ORDER BY start_time, span_id LIMIT 50")
def searched_spans(spark, d):
    return Q.search_spans(S.spans(spark, d), "call", "7-20240101", "tool")[0].select("span_id", "start_time")


# ---- question log ----

_Q = "(SELECT *, lower(query) AS q FROM qs)"
_TAGS = r"""
SELECT query_id, CASE WHEN regexp_matches(q, 'error|fail|exception') THEN 'errors' WHEN regexp_matches(q, 'trace|execution|span') THEN 'traces' WHEN regexp_matches(q, 'agent|service') THEN 'agents'
    WHEN regexp_matches(q, 'trend|over time|history') THEN 'trend' WHEN regexp_matches(q, 'compare|versus|vs') THEN 'comparison' ELSE 'metrics' END AS query_type,
  CASE WHEN regexp_matches(q, 'last\s+(\d+)\s+hour') THEN regexp_extract(q, 'last\s+(\d+)\s+hour', 1) || 'h' WHEN regexp_matches(q, 'last\s+(\d+)\s+day') THEN regexp_extract(q, 'last\s+(\d+)\s+day', 1) || 'd'
    WHEN regexp_matches(q, 'past\s+hour') THEN '1h' WHEN regexp_matches(q, 'past\s+day|yesterday') THEN '24h' WHEN regexp_matches(q, 'past\s+week|last\s+week') THEN '7d'
    WHEN regexp_matches(q, 'past\s+month|last\s+month') THEN '30d' ELSE '24h' END AS time_range,
  array_to_string(list_filter([CASE WHEN contains(q, 'latency') THEN 'duration_ms' END, CASE WHEN contains(q, 'response time') THEN 'duration_ms' END, CASE WHEN contains(q, 'tokens') THEN 'total_tokens' END,
    CASE WHEN contains(q, 'cost') THEN 'cost' END, CASE WHEN contains(q, 'errors') THEN 'error_count' END, CASE WHEN contains(q, 'requests') THEN 'request_count' END], lambda x: x IS NOT NULL), ',') AS metrics,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(q, 'average|avg') THEN 'avg' END, CASE WHEN regexp_matches(q, 'total|sum') THEN 'sum' END, CASE WHEN regexp_matches(q, 'max') THEN 'max' END,
    CASE WHEN regexp_matches(q, 'min') THEN 'min' END, CASE WHEN contains(q, 'p95') THEN 'p95' END, CASE WHEN contains(q, 'p99') THEN 'p99' END], lambda x: x IS NOT NULL), ','), ''), 'avg') AS aggregations, result_count
FROM """ + _Q


@query("F-23", f"SELECT query_id, query_type, time_range, metrics, aggregations FROM ({_TAGS})")
def tagged_questions(spark, d):
    t = L.tag_questions(S.questions(spark, d))
    return t.select("query_id", "query_type", "time_range", F.array_join("metrics", ",").alias("metrics"), F.array_join("aggregations", ",").alias("aggregations"))


@query("F-24", f"""
SELECT query_id, CAST(CASE WHEN query_type IN ('metrics', 'errors', 'traces') THEN 3 ELSE 0 END + CASE WHEN time_range IN ('1h', '24h') THEN 1 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN result_count = 0 THEN 'No ' || query_type || ' data found for the specified time range (' || time_range || ').'
    WHEN query_type IN ('errors', 'traces') THEN 'Found ' || result_count || ' ' || query_type || ' in the last ' || time_range || '.' ELSE 'Query returned ' || result_count || ' results.' END AS summary
FROM ({_TAGS})""")
def question_followups(spark, d):
    t = L.summarise(L.suggest_followups(L.tag_questions(S.questions(spark, d))))
    return t.select("query_id", F.size("suggestions").alias("n"), "summary")


@query("P-24", "SELECT query_id, created_at FROM qs WHERE created_by = 'user-3' OR is_shared ORDER BY created_at DESC, query_id LIMIT 100")
def saved_queries(spark, d):
    return L.saved_queries(S.questions(spark, d), "user-3").select("query_id", "created_at")


# ---- privacy: regex engines differ on accented words, so matches are tested against brute force instead of SQL ----


@query("F-07")
def pii_matches(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", F.explode(V.detect_pii(F.col("text"))).alias("m")).select("doc_id", "m.type", "m.start", "m.end", "m.confidence")


@query("F-08 F-09")
def redacted_documents(spark, d):
    docs = S.table(spark, d, "documents")
    rules = V.Rules(strategy="type_mask", by_type={"email": "partial", "ip_address": "hash_prefix"})
    clean = V.redact_pii(F.col("text"), rules)
    return docs.select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("digest"))


@query("F-10 F-11 ST-05")
def redacted_records(spark, d):
    out = J.pii_job(S.records(spark, d), "redact", asof="2024-02-01 00:00:00")
    return out.select("conv_id", "turn", "pii_count", "result", F.md5("redacted_record").alias("digest"))


@query("F-11")
def validated_records(spark, d):
    return J.pii_job(S.records(spark, d), "validate").select("conv_id", "turn", "valid", "pii_count", "types_found")


@query("A-40")
def pii_statistics(spark, d):
    docs = S.table(spark, d, "documents").withColumn("matches", V.detect_pii(F.col("text"), V.Rules(0.7)))
    return J.pii_stats(docs)


@query("A-40")
def pii_totals(spark, d):
    docs = S.table(spark, d, "documents").withColumn("matches", V.detect_pii(F.col("text"), V.Rules(0.7)))
    return J.pii_totals(docs)


@query("F-12", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[REDACTED]', 'g'),
  '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED]', 'g'), '\b\d{16}\b', '[REDACTED]', 'g'), '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b', '[REDACTED]', 'g')) AS digest FROM documents""")
def scrubbed_documents(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(V.scrub(F.col("text"))).alias("digest"))


@query("F-09", """
SELECT id, substr('user' || k, 1, 1) || repeat('*', length('user' || k) - 1) || '@mail.example.com' AS email, repeat('*', 6) || lpad(CAST(k AS VARCHAR), 4, '0') AS phone,
  '***-**-' || lpad(CAST(k AS VARCHAR), 4, '0') AS ssn, '10.0.' || k || '.*' AS ip FROM b""")
def partial_masks(spark, d):
    k = F.col("k").cast("string")
    four = F.lpad(k, 4, "0")
    return S.base_rows(spark, d).select(
        "id",
        V.partial_mask(F.concat(F.lit("user"), k, F.lit("@mail.example.com")), "email").alias("email"),
        V.partial_mask(F.concat(F.lit("(555) 123-"), four), "phone_number").alias("phone"),
        V.partial_mask(F.concat(F.lit("123-45-"), four), "ssn").alias("ssn"),
        V.partial_mask(F.concat(F.lit("10.0."), k, F.lit(".7")), "ip_address").alias("ip"),
    )

"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare, scratch_path
from . import chat, curve, decontaminate, html, minhash, mtree, negatives, packing, pii, quality, spelling, suffix, tokenfile

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@register("op4_best_fit_packing")
def best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), word_bpe())


@register("op7_token_orc")
def token_orc(spark, d):
    path = scratch_path(spark, "token-orc")
    tokenfile.write_tokens(table(spark, d, "documents"), path, word_bpe(), end_id=2)
    return tokenfile.with_checksum(tokenfile.read_tokens(spark, path))


@register("op1_chat_format", """
WITH t AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_logs FROM t GROUP BY l),
k AS (
  SELECT * FROM w WHERE NOT EXISTS (
    SELECT 1 FROM w o WHERE len(o.l) > len(w.l) AND list_slice(o.l, 1, len(w.l)) = w.l)),
e AS (SELECT conv_id, n_logs, unnest(l) AS x, unnest(range(len(l))) AS i FROM k)
SELECT conv_id, CAST(i // 256 AS INTEGER) AS chunk, n_logs, count(*) AS n_turns,
  string_agg('<|im_start|>' || replace(coalesce(x.role, ''), '<|', '< |') || chr(10)
    || replace(coalesce(x.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM e GROUP BY ALL""")
def chat_format(spark, d):
    return chat.format_chats(table(spark, d, "conversations"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@register("op10_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(0, greatest(1, len(w) - 12)), lambda s: list_slice(w, s + 1, s + least(13, len(w))))) AS x FROM i WHERE len(w) > 0),
p AS (SELECT doc_id, n, s, list_slice(w, s + 1, s + n) AS x FROM (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, v.n AS n FROM p JOIN v ON p.x = v.x),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""")
def decontaminate_documents(spark, d):
    rows = decontaminate.score_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", F.col("n_hit").cast("long"), F.col("n_items").cast("long"), listed.alias("items_sha256"), "contaminated")


@register("op9_quality_pu")
def quality_pu(spark, d):
    docs = table(spark, d, "documents")
    rows = quality.score(docs, quality.train(docs, table(spark, d, "labels")))
    return rows.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


@register("op3_pii_boosted")
def pii_boosted(spark, d):
    docs = table(spark, d, "documents")
    found = pii.detect(docs.select("doc_id", "text"), pii.train(docs))
    counts = [pii.count_of("__base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE_KINDS])]
    digest = F.sha2(pii.listed(F.col("__base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.listed(F.col("__spans")).alias("spans"))


@register("op5_hyperminhash")
def hyperminhash(spark, d):
    rows = minhash.near_duplicates(table(spark, d, "documents"), threshold=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@register("op8_html_crf")
def html_crf(spark, d):
    pages = table(spark, d, "pages")
    return html.extract(pages, html.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


@register("op6_mtree_topk", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def mtree_topk(spark, d):
    return mtree.top_k(table(spark, d, "embeddings"))


@register("op2_suffix_repeats")
def suffix_repeats(spark, d):
    rows = suffix.remove_repeats(table(spark, d, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op13_curve_packing")
def curve_packing(spark, d):
    return curve.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op12_spelling_variants")
def spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@register("op11_bond_negatives", """
WITH d AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, row_number() OVER () AS a FROM d),
s AS (
  SELECT q.a, q.vec_id AS anchor_id, v.vec_id, v.label = q.label AS same, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k
  FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY a, k ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def bond_negatives(spark, d):
    return negatives.hard_negatives(table(spark, d, "embeddings"))

"""Benchmark decontamination as a prefix-filtered set join, with built-in functions only.

A document is searched for every window of 13 consecutive words of a benchmark item (a shorter item is one window).
Tokens are hashed shingles of five words.  A window can only occur where all its shingles occur, so a prefix of one
shingle is necessary: its rarest one, by the counts over the whole corpus.  Candidates come from the join on these
prefix tokens; position and length bounds give the only possible place of the window; it counts if all its shingles
stand at their places there.

Defined cases: null has no words, as has a text of separators; an item of fewer than 13 words, but not none, is one
window (below five words it is one shingle itself); windows shared by items count for each item; repeated document
rows get the same result each; a null item_id is listed as an empty string; empty tables give no rows, or no hits;
other columns are kept by ``remove_contaminated`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, join_sized, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    found = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))))


def _doc_key() -> Column:
    """Equal for repeated rows only, never null."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("mix"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (wid, item_id, length, shingles) of all items; wid is the window itself."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("length", F.least(F.lit(window), F.size("w")))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at")
    cut = items.select("item_id", "length", "w", starts).withColumn("v", F.slice("w", F.col("at"), F.col("length")))
    by_size = shingles(F.col("v"), SHINGLE)
    for k in range(1, SHINGLE):
        by_size = F.when(F.col("length") == k, shingles(F.col("v"), k)).otherwise(by_size)
    return cut.select(F.array_join("v", " ").alias("wid"), "item_id", "length", by_size.alias("grams")).distinct()


def postings(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, n_words, pos, gram): where the shingles of any item stand in the corpus."""
    w = docs.select(_doc_key().alias("doc"), words(F.col("text")).alias("w"))
    grams = F.concat(*(F.transform(shingles(F.col("w"), k), lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))) for k in sizes))
    rows = w.select("doc", F.size("w").alias("n_words"), F.inline(grams))
    return join_sized(rows, wanted, ["gram"], "inner")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """((doc, wid, start, length) of every occurrence, (wid, item_id)); documents' words count from 0."""
    windows = stored(item_windows(benchmark, window), "item-windows")
    wanted = stored(windows.select(F.explode("grams").alias("gram")).distinct(), "item-shingles")
    sizes = sorted({min(SHINGLE, r["length"]) for r in windows.select("length").distinct().collect()}) or [SHINGLE]
    posted = stored(postings(docs, wanted, sizes), "postings")

    seen = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    offsets = windows.select("wid", "length", "grams").distinct()
    ranked = (
        offsets.select("wid", "length", "grams", F.posexplode("grams").alias("offset", "gram"))
        .join(seen, "gram", "left")
        .groupBy("wid")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "gram", "length", "grams")).alias("p"))
    )
    # A window whose rarest shingle never occurs cannot occur.
    prefix = stored(ranked.filter("p.seen > 0").select("wid", "p.offset", "p.gram", "p.length", "p.grams"), "prefix")
    found = (
        join_sized(posted, prefix, ["gram"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .filter("start >= 0 and start + length <= n_words")
    )
    asked = found.select("doc", "wid", "start", "length", F.size("grams").alias("n"), F.posexplode("grams").alias("o", "gram"))
    there = posted.select("doc", "pos", "gram").distinct()
    hits = (
        asked.withColumn("pos", F.col("start") + F.col("o"))
        .distinct()
        .join(there, ["doc", "pos", "gram"], "left_semi")
        .groupBy("doc", "wid", "start", "length", "n")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m = n")
        .select("doc", "wid", "start", "length")
    )
    return hits, windows.select("wid", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc, n_hit, n_items, item_ids) of the documents with a hit, stored."""
    hits, members = occurrences(docs, benchmark, window)
    hits = stored(hits, "hits")
    covered = (
        hits.select("doc", "start", "length").distinct()
        .select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct()
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        hits.select("doc", "wid").distinct().join(members, "wid").select("doc", "item_id").distinct()
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    )
    return stored(covered.join(items, "doc"), "contaminated")


def score_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated of all rows.

    Contaminated: a hit, and at least one word in twenty is hit.
    """
    found = contamination(docs, benchmark, window)
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS.replace(r"\x60", r"\x40\x5B-\x60")), ""))
    rows = join_sized(docs.select(_doc_key().alias("doc"), n_words.cast("long").alias("n_words")), found, ["doc"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        "doc.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    found = contamination(docs, benchmark, window)
    texts = docs.withColumn("__doc", _doc_key()).withColumn("__hit", F.lit(True))
    rows = join_sized(texts, found.select(F.col("doc").alias("__doc"), F.col("n_hit").alias("__n_hit")), ["__doc"], "left")
    few = 20 * F.col("__n_hit") < F.size(words(F.col("text")))
    return rows.filter(F.isnull("__n_hit") | few).select(*docs.columns)

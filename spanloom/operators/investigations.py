"""Investigations: context, similar cases, feedback, text sections, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import executive_summary, jaccard, map_status, safe_ratio, trigrams
from ..session import cut_lineage, fits, written
from .nearest import nearest_sets
from .ordered import top_per


def similar_investigations(
    queries: DataFrame, investigations: DataFrame, top_n: int = 5, min_sim: float = 0.3, max_queries: int = 2000
) -> DataFrame:
    """Best resolved investigations for each query error.

    Score = 0.5 for the same error type + 0.5 * trigram similarity of the
    messages; a case qualifies by the same type or by a similarity above
    ``min_sim``.  ``queries`` has query_id, error_type, error_message.

    Equal (type, message) texts are scored once; of each text only the first
    ``top_n`` ids can ever be returned, so copies never multiply.  A checked,
    bounded number of queries is sent to the scan of the investigations; more
    queries than that meet the texts block by block.
    """
    done = investigations.filter(F.col("resolution_status") == "resolved").select(
        "investigation_id", "error_type", "error_message"
    )
    text_key = ["error_type", "error_message"]
    heads = top_per(done, text_key, [F.asc("investigation_id")], top_n)
    texts = heads.groupBy(*text_key).agg(F.array_sort(F.collect_list("investigation_id")).alias("ids"))
    texts = texts.withColumn("grams", trigrams(F.col("error_message")))
    asks = queries.select(
        "query_id", F.col("error_type").alias("q_type"), F.col("error_message").alias("q_message"),
        trigrams(F.col("error_message")).alias("q_grams"),
    )
    forms = asks.select("q_type", "q_message", "q_grams").distinct()
    if fits(forms, max_queries):
        pairs = _scan_pairs(texts, forms, min_sim)
    else:
        pairs = _keyed_pairs(texts, forms, min_sim, top_n)
    best = top_per(
        pairs.withColumn("investigation_id", F.explode("ids")).drop("ids"),
        ["q_type", "q_message"],
        [F.desc("similarity_score"), F.asc("investigation_id")],
        top_n,
        rank="rank",
    )
    asks = asks.select("query_id", "q_type", "q_message")
    same = best["q_type"].eqNullSafe(asks["q_type"]) & best["q_message"].eqNullSafe(asks["q_message"])
    return asks.join(best, same).select(
        "query_id", "investigation_id", "error_type", "error_message", "similarity_score", "rank"
    )


def _score(min_sim: float) -> tuple[Column, Column]:
    sim = jaccard(F.col("grams"), F.col("q_grams"))
    typed = F.coalesce(F.col("error_type") == F.col("q_type"), F.lit(False))
    return typed | (sim > min_sim), F.when(typed, 0.5).otherwise(0.0) + sim * 0.5


_PAIR = ["q_type", "q_message", "error_type", "error_message", "ids", "similarity_score"]


def _scan_pairs(texts: DataFrame, forms: DataFrame, min_sim: float) -> DataFrame:
    """Each distinct text is compared with the few query texts shipped to it."""
    hit, score = _score(min_sim)
    # Few bytes but much work per row, so the texts are spread over all cores.
    spread = texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism)
    # ``forms`` passed the row-count check, so the broadcast is bounded.
    return spread.join(F.broadcast(forms), hit).withColumn("similarity_score", score).select(_PAIR)


# Rows of a side that one task compares with as many of the other side.
BLOCK_TEXTS = 40_000
BLOCK_QUERIES = 20_000
SPREAD = 16  # blocks of queries, also of few, so that cores have work
_NEAR = "qid long, tid long, similarity double"


def _nearest(queries: DataFrame, texts: DataFrame, kind: list[str], top_n: int, min_sim: float | None) -> DataFrame:
    """(qid, tid, similarity): of every block of texts the ``top_n`` most similar ones of each query.

    ``queries`` and ``texts`` have grams as one string, texts ``ids``; ``kind`` names columns that must be equal.  Both
    sides are cut into blocks and every pair of blocks meets in one group, so a row travels once per block of the other
    side, a group's size is bounded, and no pair of rows is shuffled.  Without ``min_sim`` unlike texts count as well.
    """
    n = F.count(F.lit(1))
    nq = F.greatest(F.ceil(n / BLOCK_QUERIES), F.least(F.ceil(n / 500), F.lit(SPREAD))).cast("int")
    grid = texts.groupBy(*kind).agg(F.ceil(n / BLOCK_TEXTS).cast("int").alias("nt")).join(queries.groupBy(*kind).agg(nq.alias("nq")), kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    keys = [*kind, "bt", "bq"]
    t = texts.join(grid, kind).select(*kind, "tid", "grams", F.size("ids").alias("n"), F.col("ids")[0].alias("first"), own("tid", "nt").alias("bt"), every("nq").alias("bq"))
    q = queries.join(grid, kind).select(*kind, "qid", "grams", own("qid", "nq").alias("bq"), every("nt").alias("bt"))

    def nearest(texts: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(nearest_sets(texts, queries, top_n, min_sim)), columns=["qid", "tid", "similarity"])

    # Few bytes but much work per group, so groups are spread over all cores.
    tasks = 4 * texts.sparkSession.sparkContext.defaultParallelism
    t, q = (df.repartition(tasks, *keys).groupBy(*keys) for df in (t, q))
    return t.cogroup(q).applyInPandas(nearest, _NEAR)


def _keyed_pairs(texts: DataFrame, forms: DataFrame, min_sim: float, top_n: int) -> DataFrame:
    """Form for many queries: the best cases of each query's own type, and of any type where those might not do.

    A case of the same type that shares anything scores above 0.5, any other at most 0.5.  So a query that finds
    ``top_n`` such cases is finished.
    """
    joined = F.array_join("grams", ",")
    t = cut_lineage(texts.filter(F.size("ids") > 0).withColumns({"tid": F.monotonically_increasing_id(), "grams": joined}))
    q = cut_lineage(forms.withColumns({"qid": F.monotonically_increasing_id(), "grams": F.array_join("q_grams", ",")}).drop("q_grams"))
    ranked = lambda near, score: top_per(
        near.join(t.select("tid", "ids"), "tid").withColumn("similarity_score", score), ["qid"], [F.desc("similarity_score"), F.asc(F.col("ids")[0])], top_n
    )
    typed_q = q.filter("q_type IS NOT NULL").select(F.col("q_type").alias("kind"), "qid", "grams")
    typed_t = t.filter("error_type IS NOT NULL").select(F.col("error_type").alias("kind"), "tid", "grams", "ids")
    same = cut_lineage(ranked(_nearest(typed_q, typed_t, ["kind"], top_n, None), 0.5 + F.col("similarity") * 0.5))
    have = same.filter("similarity_score > 0.5").groupBy("qid").agg(F.sum(F.size("ids")).alias("have"))
    todo = q.join(have.filter(F.col("have") >= top_n), "qid", "left_anti").withColumn("kind", F.lit(0))
    near = _nearest(todo, t.withColumn("kind", F.lit(0)), ["kind"], top_n, min_sim)
    # Those of the same type were found above.
    other = near.join(q.select("qid", "q_type"), "qid").join(t.select("tid", "error_type"), "tid")
    other = other.filter("q_type IS NULL OR error_type IS NULL OR q_type <> error_type").select("qid", "tid", "similarity")
    found = same.unionByName(ranked(other, F.lit(0.0) + F.col("similarity") * 0.5))
    return found.drop("ids").join(t.drop("grams"), "tid").join(q.drop("grams"), "qid").select(_PAIR)


def similar_incidents(anomalies: DataFrame, investigations: DataFrame, top_n: int = 5) -> DataFrame:
    """Newest resolved investigations of the same agent and anomaly type per anomaly.

    The newest ``top_n`` per (agent, type) are picked before the join, so the
    join adds at most ``top_n`` rows per anomaly.
    """
    key = ["agent_id", "anomaly_type"]
    done = investigations.filter(F.col("resolution_status") == "resolved")
    newest = top_per(done, key, [F.desc("created_at"), F.asc("investigation_id")], top_n, rank="rank").select(
        *key, "rank", "investigation_id",
        F.coalesce("root_cause", F.lit("Unknown")).alias("root_cause"),
        F.coalesce("resolution_notes", F.lit("Unknown")).alias("resolution"),
        "resolved_at",
    )
    return anomalies.select("anomaly_id", *key).join(newest, key)


def _ends(asks: DataFrame, span: int) -> DataFrame:
    """Both ends of each question's range: (agent_id, at, block, t, upper).

    Time is cut into blocks as long as a range, so that a range is the end of one block and the start of the next.
    """
    upper = F.explode(F.array(F.lit(True), F.lit(False))).alias("upper")
    t = F.when(F.col("upper"), F.unix_micros("at")).otherwise(F.unix_micros("at") - span)
    return asks.select("agent_id", "at", upper).withColumn("t", t).withColumn("block", F.floor(F.col("t") / span))


def _blocked(df: DataFrame, span: int) -> DataFrame:
    at = F.unix_micros("ts")
    return df.filter("ts IS NOT NULL AND agent_id IS NOT NULL").withColumns({"t": at, "block": F.floor(at / span)})


def _upto_end(rows: DataFrame, ends: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
    """``ends`` with each fact over the rows of their block up to (upper) or from (lower) their time, inclusive.

    Rows and ends are ordered together and pass one exchange; running facts cost the same at any number of rows.
    """
    both = rows.withColumn("upper", F.lit(None).cast("boolean")).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = w.orderBy("t", F.asc_nulls_first("upper")), w.orderBy(F.desc("t"), F.asc_nulls_first("upper"))
    found = both.select("*", *[e.over(up).alias(f"__up_{k}") for k, e in facts.items()], *[e.over(down).alias(f"__down_{k}") for k, e in facts.items()])
    of = lambda k: F.when(F.col("upper"), F.col(f"__up_{k}")).otherwise(F.col(f"__down_{k}")).alias(k)
    return found.filter("upper IS NOT NULL").select("at", "upper", *keys, *[of(k) for k in facts])


def _metrics_of(asks: DataFrame, points: DataFrame, span: int) -> DataFrame:
    """(agent_id, at, stats): per measure with points in the range their number, sum, maximum and minimum."""
    keys = ["agent_id", "block", "measure_name"]
    rows = _blocked(points.select("agent_id", "ts", "measure_name", "measure_value"), span).drop("ts")
    # Ends only where the block has points of the measure at all; a handful of measures.
    ends = _ends(asks, span).join(rows.select(*keys).distinct(), ["agent_id", "block"])
    is_row, v = F.col("upper").isNull(), F.col("measure_value")
    facts = {"rows": F.count_if(is_row), "n": F.count(v), "sum": F.sum(v), "max": F.max(v), "min": F.min(v)}
    found = _upto_end(rows, ends, keys, facts).filter("rows > 0")
    per = found.repartition("agent_id", "at").groupBy("agent_id", "at", "measure_name").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("max").alias("max"), F.min("min").alias("min")
    )
    return per.groupBy("agent_id", "at").agg(F.collect_list(F.struct("measure_name", "n", "sum", "max", "min")).alias("stats"))


def _errors_of(asks: DataFrame, errors: DataFrame, span: int, n_errors: int) -> DataFrame:
    """(agent_id, at, n, items): how many errors the range holds, and the newest ``n_errors`` of them."""
    keys = ["agent_id", "block"]
    rows = _blocked(errors.select("agent_id", "ts", "error_id", "error_type", "error_message"), span)
    # Oldest first, of equal times the larger id, so that the newest have the largest numbers.
    own = Window.partitionBy(*keys).orderBy("t", F.desc("error_id"))
    rows = written(rows.withColumn("seq", F.row_number().over(own)), "numbered-errors")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    ends = _ends(asks, span).join(sizes.select(*keys), keys)
    found = _upto_end(rows.select(*keys, "t"), ends, keys, {"n": F.count_if(F.col("upper").isNull())}).filter("n > 0")
    # In the earlier block the newest are the last of all, in the later one the last up to the range's end.
    found = found.join(sizes, keys).withColumn("last", F.when(F.col("upper"), F.col("n")).otherwise(F.col("size")))
    later = F.coalesce(F.max(F.when(F.col("upper"), F.col("n"))).over(Window.partitionBy("agent_id", "at")), F.lit(0))
    found = found.withColumn("take", F.least(F.col("n"), F.when(F.col("upper"), F.lit(n_errors)).otherwise(F.greatest(n_errors - later, F.lit(0)))))
    places = F.when(F.col("take") > 0, F.sequence(F.col("last") - F.col("take") + 1, F.col("last")))
    wanted = found.select(*keys, "at", F.explode(places).alias("seq"))
    item = F.struct("ts", "error_id", "error_type", "error_message")
    lists = wanted.join(rows.withColumn("seq", F.col("seq").cast("long")), [*keys, "seq"]).groupBy("agent_id", "at").agg(F.collect_list(item).alias("items"))
    counts = found.groupBy("agent_id", "at").agg(F.sum("n").alias("n"))
    return counts.join(lists, ["agent_id", "at"], "left")


def _newest_first(items: Column) -> Column:
    def order(a: Column, b: Column) -> Column:
        newer = (a["ts"] > b["ts"]) | ((a["ts"] == b["ts"]) & (a["error_id"] < b["error_id"]))
        equal = (a["ts"] == b["ts"]) & a["error_id"].eqNullSafe(b["error_id"])
        return F.when(equal, 0).when(newer, -1).otherwise(1)

    return F.array_sort(items, order)


def investigation_context(anomalies: DataFrame, errors: DataFrame, points: DataFrame, hours: int = 1, n_errors: int = 10) -> DataFrame:
    """One row per anomaly: latest errors and metric statistics of its agent in the hours before it.

    No pair of an anomaly and a row in its range is made: each end of a range takes running facts over its block, and
    the newest errors are looked up by their numbers within a block.  So work and shuffles grow with the rows, however
    many of them a range holds.
    """
    span = hours * 3_600_000_000
    asks = anomalies.select("agent_id", F.col("ts").alias("at")).filter("agent_id IS NOT NULL AND at IS NOT NULL").distinct()
    found = _errors_of(asks, errors, span, n_errors).join(_metrics_of(asks, points, span), ["agent_id", "at"], "full")
    rows = anomalies.select("anomaly_id", "agent_id", F.col("ts").alias("at")).join(found, ["agent_id", "at"])
    # Rows of one id share what they find.
    whole = rows.groupBy("anomaly_id").agg(
        F.sum("n").alias("error_count"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("stats")).alias("stats")
    )
    latest = F.transform(
        F.slice(_newest_first(F.col("items")), 1, n_errors),
        lambda e, i: F.struct((i + 1).alias("r"), e["error_type"].alias("error_type"), e["error_message"].alias("error_message"), e["ts"].alias("ts"), e["error_id"].alias("error_id")),
    )
    names = F.array_sort(F.array_distinct(F.transform("stats", lambda x: x["measure_name"])))

    def entry(name: Column) -> Column:
        mine = F.filter("stats", lambda x: x["measure_name"] == name)
        total = F.aggregate(mine, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["sum"], a, x["sum"]))
        n = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        of = lambda k: F.transform(mine, lambda x: x[k])
        return F.struct(name.alias("measure_name"), F.struct((total / F.nullif(n, F.lit(0))).alias("avg"), F.array_max(of("max")).alias("max"), F.array_min(of("min")).alias("min")).alias("s"))

    whole = whole.select(
        "anomaly_id", "error_count",
        F.when(F.size("items") > 0, latest).alias("recent_errors"),
        F.when(F.size("stats") > 0, F.map_from_entries(F.transform(names, entry))).alias("metrics"),
    )
    out = anomalies.join(whole, "anomaly_id", "left")
    return out.withColumn("error_count", F.coalesce("error_count", F.lit(0)))


def apply_feedback(known: DataFrame, feedback: DataFrame, investigations: DataFrame, patterns: DataFrame) -> DataFrame:
    """Known resolutions after helpful / not helpful votes on linked investigations.

    A vote counts for every resolution whose error pattern shares agent and
    error type with the investigation.  All votes of a batch are folded at once,
    which equals applying them one after the other.
    """
    votes = feedback.join(investigations.select("investigation_id", "agent_id", "error_type"), "investigation_id")
    per_pair = votes.groupBy("agent_id", "error_type").agg(
        F.count(F.lit(1)).alias("votes"), F.count_if("was_helpful").alias("helpful")
    )
    marks = patterns.select("error_fingerprint", "agent_id", "error_type").distinct()
    folded = marks.join(per_pair, ["agent_id", "error_type"]).groupBy("error_fingerprint").agg(
        F.sum("votes").alias("votes"), F.sum("helpful").alias("helpful")
    )
    n = F.col("times_applied")
    merged = (F.col("success_rate").cast("double") * n + F.col("helpful")) / (n + F.col("votes"))
    out = known.join(folded, "error_fingerprint", "left")
    voted = F.coalesce("votes", F.lit(0)) > 0
    return out.withColumns(
        {
            "success_rate": F.when(voted, merged).otherwise(F.col("success_rate").cast("double")),
            "times_applied": n + F.coalesce("votes", F.lit(0)),
        }
    ).drop("votes", "helpful")


def sync_external_status(webhooks: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """Internal status per mapped item from ticket events; the latest event wins.

    Events are folded to one per external id before the join.
    """
    status = map_status(F.col("status"), kind, "in")
    mine = webhooks.filter(F.col("integration_type") == kind).withColumn("internal_status", status)
    latest = mine.filter("internal_status IS NOT NULL").groupBy("external_id").agg(
        F.max_by("internal_status", F.struct("ts", "webhook_id")).alias("internal_status"), F.max("ts").alias("updated_at")
    )
    ids = mapping.filter(F.col("integration_type") == kind).select("external_id", "internal_id")
    return ids.join(latest, "external_id")


# Header words of the sections, first hit wins.
SECTIONS = [
    ("root cause", "root_cause"),
    ("evidence", "evidence"),
    ("impact", "impact"),
    ("remediation", "remediation"),
    ("prevention", "prevention"),
    ("similar", "similar_incidents_analysis"),
]
LIST_MARK = r"^([1-5]\.|-|\*)"


def split_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One column per section of an analysis text; remediation is an array of list items.

    A text is split inside its own row by array expressions, so nothing is
    exploded or shuffled.
    """
    lines = F.split(F.col(text), "\n", -1)
    header = lambda line: F.coalesce(
        *[F.when(F.contains(F.lower(line), F.lit(word)), F.lit(name)) for word, name in SECTIONS]
    )
    heads = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("at"), header(line).alias("section"))),
        lambda h: h["section"].isNotNull(),
    )
    # The lines of a part run from its header to the next one.
    stop = lambda j: F.coalesce(F.try_element_at("heads", j + 2)["at"], F.size("lines"))
    parts = F.transform(
        "heads",
        lambda h, j: F.struct(
            h["section"].alias("section"), F.slice("lines", h["at"] + 2, stop(j) - h["at"] - 1).alias("lines")
        ),
    )

    def of(name: str) -> Column:
        return F.flatten(F.transform(F.filter("parts", lambda x: x["section"] == name), lambda x: x["lines"]))

    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    columns = [strip(F.array_join(of(name), "\n")).alias(name) for _, name in SECTIONS if name != "remediation"]
    steps = F.filter(F.transform(of("remediation"), strip), lambda s: s.rlike(LIST_MARK)).alias("remediation")
    staged = texts.withColumn("lines", lines).withColumn("heads", heads).withColumn("parts", parts)
    return staged.select(key, *columns, steps)


def investigation_notice(sections: DataFrame, key: str, actions_shown: int = 3) -> DataFrame:
    """Summary (first 500 characters of the root cause), the first actions and, next to them, all."""
    return sections.select(
        key, executive_summary(F.col("root_cause")).alias("summary"), "impact",
        F.slice("remediation", 1, actions_shown).alias("immediate_actions"), "prevention", "root_cause", "remediation",
    )


def investigation_stats(investigations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Daily totals, resolution times, costs, severities and accuracy from feedback."""
    day = F.to_date("created_at")
    resolved = F.col("resolution_status") == "resolved"
    minutes = F.when(resolved, (F.unix_micros("resolved_at") - F.unix_micros("created_at")) / 60_000_000.0)
    of = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}_investigations")
    base = investigations.groupBy(day.alias("date")).agg(
        F.count(F.lit(1)).alias("total_investigations"),
        F.count_if(resolved & F.col("auto_resolved")).alias("auto_resolved"),
        F.count_if(resolved & ~F.col("auto_resolved")).alias("manual_resolved"),
        F.avg(minutes).alias("avg_resolution_time_minutes"),
        F.avg("cost_usd").alias("avg_investigation_cost_usd"),
        F.sum("cost_usd").alias("total_investigation_cost_usd"),
        of("critical"), of("high"), of("medium"), of("low"),
    )
    votes = feedback.join(investigations.select("investigation_id", day.alias("date")), "investigation_id")
    rates = votes.groupBy("date").agg(
        safe_ratio(F.count_if("root_cause_correct"), F.count("root_cause_correct")).alias("root_cause_accuracy_rate"),
        safe_ratio(F.count_if("was_helpful"), F.count("was_helpful")).alias("recommendation_helpfulness_rate"),
    )
    return base.join(rates, "date", "left")

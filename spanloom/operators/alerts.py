"""Alerts: deduplication, routing, rules and notification rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import alert_fingerprint
from ..functions.text import fmt_pct, fmt_ts, map_severity, rule_threshold, safe_ratio, truncate
from ..functions.times import as_ts, ttl_epoch
from ..schema import lookup
from ..session import written
from .events import filter_by
from .ordered import ordered_scan


def with_fingerprint(alerts: DataFrame) -> DataFrame:
    mark = alert_fingerprint(F.col("agent_id"), F.col("anomaly_type"), F.col("metrics"))
    return alerts.withColumn("alert_fingerprint", mark)


def with_topic(alerts: DataFrame) -> DataFrame:
    """Topic by severity (unknown -> info) and whether the pager is called."""
    return alerts.withColumns(
        {
            "topic": map_severity(F.coalesce("severity", F.lit("info")), "topic"),
            "page": F.coalesce(F.lower("severity").isin("critical", "warning"), F.lit(False)),
        }
    )


# ---- deduplication: send, then suppress for a window counted from the last one sent ----


def _next_sends(slots: DataFrame) -> DataFrame:
    """``slots`` (fp, w, t) with nxt: the time that is sent next if t is sent, the first at least w later.

    Questions (t + w) and times are put in one descending order; a question's answer is the last time before it.
    """
    both = slots.select("fp", "w", "t", F.explode(F.array(F.lit(False), F.lit(True))).alias("asks"))
    both = both.withColumn("back", F.timestamp_micros(-(F.col("t") + F.when(F.col("asks"), F.col("w")).otherwise(F.lit(0)))))
    # Of a question and a time at one moment the time comes first.
    rows = ordered_scan(both, ["fp", "w"], "back", "asks", last_value={"nxt": F.when(~F.col("asks"), F.col("t"))}, piece_seconds=3600)
    return rows.filter("asks").select("fp", "w", "t", "nxt")


def _sends(slots: DataFrame, seen: DataFrame) -> DataFrame:
    """(fp, w, sent): the first time of each fingerprint and width that is free, and from there the path along _next_sends.

    The path is found by pointer doubling: each round every reached time reaches its pointer's target as well, and every
    pointer is replaced by its target's.  Rounds grow with the logarithm of the longest path, whatever the width.
    """
    begun = slots.join(seen, "fp", "left").filter(F.col("last").isNull() | (F.col("t") - F.col("last") >= F.col("w")))
    first = begun.groupBy("fp", "w").agg(F.min("t").alias("first"))
    steps = written(_next_sends(slots).join(first, ["fp", "w"]).select("fp", "w", "t", "nxt", (F.col("t") == F.col("first")).alias("sent")), "next-sends")
    while not steps.filter("sent AND nxt IS NOT NULL").isEmpty():
        # One row for each target: whether a sent time points to it.
        hit = steps.filter("nxt IS NOT NULL").groupBy("fp", "w", F.col("nxt").alias("t")).agg(F.max("sent").alias("hit")).filter("hit")
        beyond = steps.select("fp", "w", F.col("t").alias("nxt"), F.col("nxt").alias("then"))
        moved = steps.join(hit, ["fp", "w", "t"], "left").join(beyond, ["fp", "w", "nxt"], "left")
        steps = written(moved.select("fp", "w", "t", F.col("then").alias("nxt"), (F.col("sent") | F.coalesce("hit", F.lit(False))).alias("sent")), "next-sends")
    return steps.filter("sent").select("fp", "w", F.col("t").alias("sent"))


def dedup_alerts(
    alerts: DataFrame, hours: float | Column = 24, cache: DataFrame | None = None, ts: str = "ts", tie: str = "alert_id"
) -> DataFrame:
    """Each alert with ``sent`` and, if suppressed, the send that suppressed it.

    ``hours`` may be a column that is constant per fingerprint.  ``cache``
    (alert_fingerprint, last_sent) carries state from earlier runs.  An alert
    exactly one window after the last send is sent again.

    An alert older than the cached last send is ``late``.  Less than a window older,
    it is suppressed by that send.  Otherwise it is decided among the late ones alone,
    as it would have been without the cache, and doesn't move the cache.
    """
    spark = alerts.sparkSession
    span = hours if isinstance(hours, Column) else F.lit(float(hours))
    window = F.greatest((span * 3_600_000_000).cast("bigint"), F.lit(1).cast("bigint"))
    rows = alerts.withColumns({"fp": F.col("alert_fingerprint"), "t": F.unix_micros(ts), "w": window})
    if cache is None:
        seen = spark.range(0).select(F.lit("").alias("fp"), F.col("id").alias("last"))
        rows = rows.withColumns({"late": F.lit(False), "covered_by": F.lit(None).cast("bigint")})
    else:
        seen = cache.groupBy(F.col("alert_fingerprint").alias("fp")).agg(F.max(F.unix_micros("last_sent")).alias("last"))
        late = F.coalesce(F.col("t") < F.col("last"), F.lit(False))
        apart = late & (F.col("last") - F.col("t") >= F.col("w"))
        rows = rows.join(seen, "fp", "left").withColumns({
            "late": late,
            "covered_by": F.when(late & ~apart, F.col("last")),
            "fp": F.when(apart, F.concat("fp", F.lit("|late"))).otherwise(F.col("fp")),
        }).drop("last")
    slots = written(rows.filter("covered_by IS NULL").select("fp", "t", "w").distinct(), "alert-times")
    return _mark_sent(rows, _sends(slots, seen), seen, tie).drop("fp", "t", "w")


def _mark_sent(rows: DataFrame, sends: DataFrame, seen: DataFrame, tie: str) -> DataFrame:
    """Assign every alert the latest send not after it.

    That send lies less than one window back, so an equality join on window-sized
    slices finds it; a cached last send can only cover the first window after it.
    """
    widths = rows.select("fp", "w").distinct()
    carried = seen.join(widths, "fp").select("fp", "w", F.col("last").alias("sent"))
    slice_of = lambda c: F.floor(F.col(c) / F.col("w"))
    slots = sends.unionByName(carried).select(
        "fp", "w", "sent", F.explode(F.array(slice_of("sent"), slice_of("sent") + 1)).alias("slice")
    )
    # At most three sends touch a slice: its own, the one before and a cached one.
    per_slice = slots.groupBy("fp", "w", "slice").agg(F.array_sort(F.collect_set("sent")).alias("near"))
    joined = rows.withColumn("slice", slice_of("t")).join(per_slice, ["fp", "w", "slice"], "left")
    marked = joined.withColumn("by", F.array_max(F.filter("near", lambda s: s <= F.col("t"))))
    # Of alerts at the very moment of a send, the first by id is the one sent.
    first = marked.filter(F.col("by") == F.col("t")).groupBy("fp", "t").agg(F.min(tie).alias("winner"))
    out = marked.join(first, ["fp", "t"], "left")
    sent = F.coalesce(F.col("winner") == F.col(tie), F.lit(False)) & F.isnull("covered_by")
    by = F.timestamp_micros(F.coalesce("covered_by", "by"))
    return out.withColumns({"sent": sent, "sent_by": by}).drop("slice", "near", "by", "winner", "covered_by")


def alert_cache(deduped: DataFrame, days: int = 7) -> DataFrame:
    """Last send, alerts counted since then, last occurrence and expiry per fingerprint."""
    latest = deduped.groupBy("alert_fingerprint", "sent_by").agg(
        F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_occurrence")
    )
    newest = latest.groupBy("alert_fingerprint").agg(
        F.max_by(F.struct("count", "last_occurrence"), "sent_by").alias("s"), F.max("sent_by").alias("last_sent")
    )
    return newest.select(
        "alert_fingerprint", "last_sent", "s.count", "s.last_occurrence",
        ttl_epoch(F.col("last_sent"), days).alias("ttl"),
    )


# ---- joins and counts ----


def open_alert_counts(alerts: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    return alerts.filter(F.col("status") == "open").agg(n.alias("total"), of("critical"), of("warning"), of("info"))


def alerts_with_investigation(alerts: DataFrame, investigations: DataFrame) -> DataFrame:
    """Alerts with their newest investigation, if any, and a flag."""
    newest = investigations.groupBy("alert_id").agg(
        F.max_by(F.struct("investigation_id", "root_cause", "resolution_status"), F.struct("created_at", "investigation_id")).alias("investigation")
    )
    out = alerts.join(newest, "alert_id", "left")
    return out.withColumn("has_investigation", F.col("investigation").isNotNull())


def _exact(agent: Column) -> Column:
    return F.concat(F.lit("="), agent)


CHUNKS = 16  # lists of an audience
GROUPS, SLICE = 256, 1000  # lists of the messages with one key, and the most a list holds when lists meet


def addressed(messages: DataFrame) -> DataFrame:
    """Messages with each key under which they are asked for: their own agent and the wildcard, or, without an agent, any."""
    agent = F.col("agent_id")
    asks = F.when(agent.isNull(), F.array(F.lit("?"))).otherwise(F.array(_exact(agent), F.lit("*")))
    return messages.select("message_id", "message_type", "agent_id", F.explode(asks).alias("match"))


def audiences(subscriptions: DataFrame) -> DataFrame:
    """(message_type, match, connections): who takes messages of a type and key, as several lists."""
    only = F.col("agent_filter")
    takes = F.array(F.when(only.isNull(), F.lit("*")).otherwise(_exact(only)), F.lit("?"))
    s = subscriptions.select("connection_id", F.col("subscription_type").alias("message_type"), F.explode(takes).alias("match"))
    # Null ids stay: a list would leave them out unless they are wrapped.
    one = F.collect_list(F.struct("connection_id")).alias("connections")
    chunk = F.pmod(F.xxhash64("connection_id"), F.lit(CHUNKS)).alias("chunk")
    return s.groupBy("message_type", "match", chunk).agg(one).drop("chunk")


def _slices(lists: DataFrame, name: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.size(name), F.lit(SLICE))).alias("at")
    return lists.select("*", at).withColumn(name, F.slice(name, F.col("at"), F.lit(SLICE)))


def deliveries(messages: DataFrame, audience: DataFrame, *more: str) -> DataFrame:
    """(message, subscription) pairs of addressed messages; ``more`` are further columns that must be equal.

    Lists of messages meet lists of connections.  Rows come out as one list of connections again and again, once for each
    message of a list, which files keep in a few bits a row; over all messages the connections of a key would not repeat
    closely enough.  Few keys hold most pairs, so message lists are dealt to parts and lists of connections go to every part.
    """
    keys, cores = ["message_type", "match", *more], messages.sparkSession.sparkContext.defaultParallelism
    group = F.pmod(F.xxhash64("message_id", "agent_id"), F.lit(GROUPS)).alias("group")
    grouped = messages.groupBy(*keys, group).agg(F.collect_list(F.struct("message_id", "agent_id")).alias("messages"))
    part = F.pmod(F.xxhash64("group", "at"), F.lit(4 * cores)).alias("part")
    asked = _slices(grouped, "messages").select(*keys, part, "messages").repartition(8 * cores, *keys, "part")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4 * cores - 1).cast("long"))).alias("part")
    takers = _slices(audience, "connections").select(*keys, parts, "connections").repartition(8 * cores, *keys, "part")
    # This way round a list of connections meets all lists of messages before the next one comes.
    lists = takers.join(asked, [*keys, "part"])
    each = lists.select("message_type", F.explode("messages").alias("m"), "connections")
    pairs = each.select("m.message_id", "message_type", "m.agent_id", F.explode("connections").alias("c"))
    return pairs.select("message_id", "message_type", "agent_id", "c.connection_id")


def route_to_subscriptions(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(message, subscription) pairs: same type, and the same agent or no agent filter.

    A message without an agent goes to every subscription of its type.  The
    three cases become match keys, so one equality join covers them and no theta
    join over a whole type is needed.  Lists of messages are joined with lists of connections;
    only then are these spread to rows, of which there are as many as pairs.
    """
    return deliveries(addressed(messages), audiences(subscriptions))


def route_notifications(alerts: DataFrame, routes: DataFrame, salts: int = 32) -> DataFrame:
    """(alert, team, channel) rows: severity equal, agent id fully matching the route's pattern.

    Patterns are tested against distinct (severity, agent) pairs only.  Few
    severities would mean few join keys, so pairs are spread over ``salts`` and
    the (configuration-sized) routes repeated per salt.
    """
    channel = F.explode("channels").alias("channel")
    pairs = alerts.select("severity", "agent_id").distinct().withColumn(
        "salt", F.pmod(F.xxhash64("agent_id"), F.lit(salts)).cast("int")
    )
    live = routes.filter("active").select(
        F.col("severity_level").alias("severity"), "team_name", "agent_pattern", "channels",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    whole = F.concat(F.lit("^(?:"), F.col("agent_pattern"), F.lit(")$"))
    hits = pairs.join(live, ["severity", "salt"]).filter(F.rlike("agent_id", whole))
    hits = hits.select("severity", "agent_id", "team_name", channel)
    return alerts.join(hits, ["severity", "agent_id"])


# ---- rules ----


def evaluate_rules(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule breaches: (window_start, agent_id, rule_type, value) against thresholds.

    A rule without an agent applies to all agents: each window row asks under
    its own agent and under the wildcard, in one equality join.
    """
    limit = rule_threshold(F.col("rule_type"), F.col("threshold"))
    key = F.when(F.col("agent_id").isNull(), F.lit("*")).otherwise(_exact(F.col("agent_id")))
    live = rules.filter("is_active").select(
        "rule_id", "rule_type", key.alias("match"), "severity", "cooldown_minutes", limit.alias("threshold")
    )
    asks = windows.withColumn("match", F.explode(F.array(_exact(F.col("agent_id")), F.lit("*"))))
    cols = ["rule_id", "rule_type", "agent_id", "window_start", "value", "threshold", "severity", "cooldown_minutes"]
    return asks.join(live, ["rule_type", "match"]).filter(F.col("value") > F.col("threshold")).select(cols)


def rule_windows(events: DataFrame, width: str = "300 seconds") -> DataFrame:
    """Long form (window_start, agent_id, rule_type, value) for the rule types on one scan."""
    ended = F.col("duration_ms").isNotNull()
    stats = events.groupBy(F.window("ts", width), "agent_id").agg(
        safe_ratio(F.count_if(F.col("status") == "error"), F.count_if(F.col("status").isNotNull())).alias("error_rate"),
        F.avg(F.when(ended, F.col("duration_ms"))).alias("latency"),
        F.sum("total_tokens").cast("double").alias("token_usage"),
    )
    cells = [x for k in ("error_rate", "latency", "token_usage") for x in (F.lit(k), F.col(k))]
    long = stats.select(
        F.col("window.start").alias("window_start"), "agent_id", F.explode(F.create_map(*cells)).alias("rule_type", "value")
    )
    return long.filter("value IS NOT NULL")


def rule_alerts(breaches: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Breaches with ``sent``: a rule stays silent for its cooldown after firing for an agent."""
    # Breaches are few next to the events they come from: compute them once.
    rows = written(breaches, "breaches").withColumns(
        {
            "alert_fingerprint": F.sha2(F.concat_ws("|", "rule_id", "agent_id"), 256),
            "ts": F.col("window_start"),
            "alert_id": F.concat_ws("|", "rule_id", "agent_id", F.unix_seconds("window_start").cast("string")),
        }
    )
    return dedup_alerts(rows, F.coalesce("cooldown_minutes", F.lit(0)) / 60, cache)


# ---- notification rows ----

# Look of the chat, card and mail notifications.
EMOJI = {"critical": ":rotating_light:", "warning": ":warning:", "info": ":information_source:"}
CHAT_COLORS = {"critical": "#FF0000", "warning": "#FFA500", "info": "#0000FF"}
CARD_STYLES = {"CRITICAL": "attention", "HIGH": "attention", "MEDIUM": "warning", "LOW": "good", "INFO": "accent"}
MAIL_MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "INFO": "🔵"}


def _metric_lines(bullet: str) -> Column:
    lines = F.transform(
        F.array_sort(F.map_entries("metrics")),
        lambda e: F.concat(F.lit(bullet), e["key"], F.lit(": "), F.format_string("%.2f", e["value"])),
    )
    return F.array_join(lines, "\n")


def _text_block(text: Column) -> Column:
    body = F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))
    return F.struct(F.lit("section").alias("type"), body.alias("text"))


def notification_payloads(
    alerts: DataFrame, channel: str, dashboard_url: str = "", source: str = "agent telemetry", head_chars: int = 150, cause_chars: int = 500, actions_shown: int = 3
) -> DataFrame:
    """(alert_id, channel, payload JSON) rows for ``slack``, ``pagerduty``, ``teams`` or ``email``.

    Uses agent_id, anomaly_type, severity, ts, metrics and, where the frame has
    them, root_cause and immediate_actions.  A chat message shows ``head_chars`` of
    its head, ``cause_chars`` of the cause and ``actions_shown`` actions.
    """
    has = set(alerts.columns)
    cause = F.col("root_cause") if "root_cause" in has else F.lit(None).cast("string")
    actions = F.col("immediate_actions") if "immediate_actions" in has else F.array().cast("array<string>")
    agent = F.coalesce("agent_id", F.lit("unknown"))
    kind = F.coalesce("anomaly_type", F.lit("Alert"))
    sev = F.coalesce("severity", F.lit("info"))
    links = F.struct(
        F.concat(F.lit(f"{dashboard_url}/agents/"), agent).alias("agent"), F.lit(dashboard_url).alias("dashboard")
    )
    if channel == "slack":
        head = F.concat(lookup(EMOJI, sev, ":bell:"), F.lit(" "), F.upper(sev), F.lit(": "), kind)
        blocks = F.array(
            _text_block(F.substring(head, 1, head_chars)),
            _text_block(F.concat(F.lit("*Agent:*\n"), agent, F.lit("\n*Time:*\n"), fmt_ts(F.col("ts")))),
            F.when(F.size("metrics") > 0, _text_block(F.concat(F.lit("*Metrics:*\n"), _metric_lines("• ")))),
            F.when(F.length(cause) > 0, _text_block(F.concat(F.lit("*Root Cause:*\n"), truncate(cause, cause_chars)))),
            F.when(
                F.size(actions) > 0,
                _text_block(F.concat(F.lit("*Immediate Actions:*\n• "), F.array_join(F.slice(actions, 1, actions_shown), "\n• "))),
            ),
        )
        payload = F.struct(lookup(CHAT_COLORS, sev, "#808080").alias("color"), F.array_compact(blocks).alias("blocks"))
    elif channel == "pagerduty":
        alerts = alerts.filter(F.col("severity").isin("critical", "warning"))
        details = F.struct(
            agent.alias("agent_id"), kind.alias("anomaly_type"), "metrics",
            F.coalesce(cause, F.lit("Under investigation")).alias("root_cause"), actions.alias("immediate_actions"),
        )
        body = F.struct(
            F.concat(F.upper(sev), F.lit(": "), kind, F.lit(" - "), agent).alias("summary"),
            F.lit(source).alias("source"),
            map_severity(sev, "pager").alias("severity"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            details.alias("custom_details"),
        )
        payload = F.struct(
            F.lit("trigger").alias("event_action"), F.concat_ws("-", agent, kind).alias("dedup_key"), body.alias("payload")
        )
    elif channel == "teams":
        m = F.col("metrics")
        fact = lambda title, value: F.struct(F.lit(title).alias("title"), value.alias("value"))
        facts = F.array(
            fact("Severity", F.upper(sev)),
            fact("Alert Type", kind),
            fact("Agent", agent),
            fact("Time", fmt_ts(F.col("ts"))),
            F.when(m["error_rate"].isNotNull(), fact("Error Rate", fmt_pct(m["error_rate"], 2))),
            F.when(m["latency_p95"].isNotNull(), fact("P95 Latency", F.concat(F.format_string("%.0f", m["latency_p95"]), F.lit("ms")))),
            F.when(m["token_usage"].isNotNull(), fact("Token Usage", F.format_number(m["token_usage"], 0))),
        )
        payload = F.struct(
            F.lit("AdaptiveCard").alias("type"), lookup(CARD_STYLES, F.upper(sev), "default").alias("style"),
            F.array_compact(facts).alias("facts"), links.alias("links"),
            F.concat(F.lit("**Root Cause:** "), cause).alias("investigation"),
        )
    elif channel == "email":
        subject = F.concat(lookup(MAIL_MARKS, F.upper(sev), "⚪"), F.lit(" ["), F.upper(sev), F.lit("] "), kind, F.lit(" - "), agent)
        text = F.concat_ws(
            "\n", F.concat(F.lit("Agent: "), agent), F.concat(F.lit("Time: "), fmt_ts(F.col("ts"))),
            F.when(F.size("metrics") > 0, F.concat(F.lit("Metrics:\n"), _metric_lines("  "))),
            F.concat(F.lit("Root Cause: "), cause),
        )
        payload = F.struct(subject.alias("subject"), text.alias("text_body"), links.alias("links"))
    else:
        raise ValueError(f"unknown channel: {channel}")
    return alerts.select("alert_id", F.lit(channel).alias("channel"), F.to_json(payload).alias("payload"))


def list_alerts(alerts: DataFrame, limit: int = 100, **filters) -> DataFrame:
    return filter_by(alerts, **filters).orderBy(F.desc("ts"), "alert_id").limit(limit)


def live_cache(cache: DataFrame, asof) -> DataFrame:
    """Cache rows still alive at ``asof``."""
    return cache.filter(F.col("ttl") > F.unix_seconds(as_ts(asof)))

"""Chat formatting: collapse logged snapshots of one conversation, then render the maximal ones.

A chat service that logs the whole history with every request leaves, for one conversation, logs of 2, 4, 6, ... turns.
Rolling hashes of the turn prefixes find them: a log whose last prefix hash is an inner prefix hash of another log is a
snapshot and goes (anti-join); of equal logs the smallest conv_id stays.  The prefix hash is the exclusive-or of hashes
of (position, role, text), twice 64 bits, so it can be carried over pieces of a conversation: no conversation is ever
sorted or gathered as a whole.  Only built-in functions are used.

Defined cases: rows equal in all four columns count once; turns sort by turn (nulls first), then role, then text; null
conv_id is a conversation of its own; a null role or text differs from an empty one when comparing and is rendered as an
empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = 256  # turns per piece, and rendered turns per chunk


def _carried(rows: DataFrame, facts: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Attach to each row what the earlier pieces of its conversation add up to."""
    sums = rows.groupBy("c", "piece").agg(*(e.alias(n) for n, e in facts.items()))
    return rows.join(sums.select("c", "piece", *(e.alias(n) for n, e in carry.items())), ["c", "piece"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c = struct(conv_id), role, text, idx (from 0), n (turns of the conversation), and the prefix hash p1, p2."""
    rows = (
        conversations.select(F.struct("conv_id").alias("c"), "turn", "role", "text")
        .dropDuplicates()
        .withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 60))))
    )
    own = Window.partitionBy("c", "piece").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    pieces = Window.partitionBy("c").orderBy("piece")
    before = pieces.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.row_number().over(own))
    rows = _carried(
        rows,
        {"size": F.count(F.lit(1))},
        {"base": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("c"))},
    ).withColumn("idx", F.col("base") + F.col("i") - 1)
    parts = ["idx", F.isnull("role"), "role", F.isnull("text"), "text"]
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), *parts), "h2": F.xxhash64(F.lit(2), *parts)})
    upto = Window.partitionBy("c", "piece").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto)})
    rows = _carried(
        rows,
        {"x1": F.bit_xor("h1"), "x2": F.bit_xor("h2")},
        {f"b{k}": F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")) for k in (1, 2)},
    )
    return rows.select("c", "role", "text", "idx", "n", *(F.col(f"b{k}").bitwiseXOR(F.col(f"r{k}")).alias(f"p{k}") for k in (1, 2)))


def maximal(turns: DataFrame) -> DataFrame:
    """c of the conversations that are no prefix of another one; of equal ones the smallest, with their number."""
    key = ["length", "p1", "p2"]
    prefixes = turns.withColumn("length", F.col("idx") + 1)
    whole = prefixes.filter("length = n").groupBy(*key).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_logs"))
    inner = prefixes.filter("length < n").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("c", "n_logs")


def rendered(role: Column, text: Column) -> Column:
    """One turn between control marks; marks that occur in the text are broken up by a space."""
    safe = [F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |")) for c in (role, text)]
    return F.concat(F.lit("<|im_start|>"), safe[0], F.lit("\n"), safe[1], F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, n_logs, n_turns, text: the maximal conversations, rendered in chunks of at most 256 turns."""
    turns = numbered_turns(conversations)
    kept = turns.join(maximal(turns), "c", "inner")
    said = F.struct("idx", rendered(F.col("role"), F.col("text")).alias("said"))
    return (
        kept.groupBy("c", F.floor(F.col("idx") / PIECE).cast("int").alias("chunk"))
        .agg(F.first("n_logs").alias("n_logs"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(said)).alias("said"))
        .select("c.conv_id", "chunk", "n_logs", "n_turns", F.array_join("said.said", "").alias("text"))
    )

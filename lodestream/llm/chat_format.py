"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of messages: ``message`` starts one (role and first text),
``delta`` appends, ``edit`` replaces the text, ``regenerate`` drops it so that
later deltas fill it anew. Events of a message are folded in the order of
``seq``; a fold of a range of ``seq`` is a fold again, so long messages and long
conversations are folded range by range, and no group holds more than a range.

Template, one turn: ``<s>`` role ``[INST]`` text ``[/INST]`` ``</s>``, each mark on
lines of its own. A control string inside a role or text gets a backslash in
front, as does one that already has backslashes; marks never have one. Null
roles and texts count as empty. Events with the same ``seq`` are taken by kind,
role and text; messages that start at the same ``seq`` by role and text; null
``seq`` comes first. Repeated rows are messages of their own. An empty log gives
no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
OPEN, MIDDLE, CLOSE = "<s>\n", "\n[INST]\n", "\n[/INST]\n</s>\n"
#: Events, or turns, that are folded in one group.
RANGE = 256
PART = 64


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<!\\)(\\*+(?:{CONTROL}))", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<!\\)\\(\\*+(?:{CONTROL}))", "$1")


def _from_last_reset(items: Column) -> Column:
    """Text of the items (seq, kind, role, text or at, resets, text) from the last that resets on."""
    last = F.array_max(F.transform(items, lambda x, i: F.when(x["resets"], i).otherwise(F.lit(0))))
    return F.array_join(F.transform(F.slice(items, last + 1, F.size(items)), lambda x: x["text"]), "")


def fold_events(events: DataFrame) -> DataFrame:
    """One row for each message: conv_id, message, seq, role, text."""
    resets = F.col("kind").isin("message", "edit", "regenerate")
    e = events.select("conv_id", "message", "seq", F.floor(F.col("seq") / RANGE).alias("at"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("resets", resets)
    ranges = (
        e.groupBy("conv_id", "message", "at")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text", "resets"))).alias("items"))
        .select("conv_id", "message", "at", F.col("items")[0]["seq"].alias("seq"), F.element_at(F.filter(F.concat(F.transform("items", lambda x: x["role"]), F.array(F.lit(""))), lambda r: r.isNotNull()), 1).alias("role"), F.exists("items", lambda x: x["resets"]).alias("resets"), _from_last_reset(F.col("items")).alias("text"))
    )
    return (
        ranges.groupBy("conv_id", "message")
        .agg(F.sort_array(F.collect_list(F.struct("at", "seq", "role", "resets", "text"))).alias("items"))
        .select("conv_id", "message", F.col("items")[0]["seq"].alias("seq"), F.element_at(F.concat(F.filter(F.transform("items", lambda x: x["role"]), lambda r: r != ""), F.array(F.lit(""))), 1).alias("role"), _from_last_reset(F.col("items")).alias("text"))
    )


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Parts of formatted conversations: conv_id, part, formatted, loss_spans (start, length; code points within the part)."""
    turn = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE))
    parts = (
        messages.withColumn("part", F.coalesce(F.floor(F.col("seq") / PART), F.lit(-(2**62))))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
        .select("conv_id", "part", F.transform("turns", lambda t: F.struct(turn(t).alias("out"), (t["role"] == trained).alias("trained"), F.length(escaped(t["role"])).alias("head"))).alias("turns"))
        .withColumn("sizes", F.transform("turns", lambda t: F.length(t["out"])))
    )
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b)
    head = len(OPEN) + len(MIDDLE)
    span = lambda t, i: F.struct(t["trained"].alias("trained"), (before(i) + t["head"] + head).alias("start"), (F.length(t["out"]) - t["head"] - head - len(CLOSE)).alias("length"))
    spans = F.transform(F.filter(F.transform("turns", span), lambda s: s["trained"]), lambda s: F.struct(s["start"], s["length"]))
    return parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, part, turns (role, text) and the texts under the loss mask, from the formatted text alone."""
    quoted = CLOSE.replace("[", r"\[").replace("]", r"\]")
    pieces = F.filter(F.split("formatted", quoted, -1), lambda p: p != "")
    turn = lambda p: F.struct(unescaped(F.substring(F.substring_index(p, MIDDLE, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"), unescaped(F.substring_index(p, MIDDLE, -1)).alias("text"))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return parts.select("conv_id", "part", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.llm.store import stored

    probe = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    events = rows.select("conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    parts = stored(render(fold_events(events)), "chat")
    back = read_back(parts).select(
        "conv_id",
        "part",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("loss", "").alias("loss"),
        F.length("formatted").alias("chars"),
    )
    whole = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return (
        back.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("part", "all", "loss"))).alias("parts"))
        .select("conv_id", "n_turns", F.sha2(whole("all"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars")
    )


_ESC = r"regexp_replace({}, '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>))', '\\\1', 'g')"
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(OPEN + MIDDLE + CLOSE)} + length({_ESC.format("role")}) + length({_ESC.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

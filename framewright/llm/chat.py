"""Chat formatting: cumulative snapshots collapse into maximal conversations, which are rendered.

A log often holds a conversation after every turn, so that most logged
conversations are prefixes of longer ones.  Each turn has a digest of its role
and text; a rolling digest over the turns identifies every prefix.  A
conversation stays if its whole digest is no proper prefix of any other
(an anti-join against the distinct prefix digests), and of equal conversations
the one with the smallest id stays (nulls count as larger).  Only digests are
compared; texts are read again for what stays.

Turns are in order of their number (null first), then role and text.  A null role
counts as ``user``, a null text as empty.  A row with a null conversation id belongs to no
other: it is a conversation of one turn, however many such rows there are.  Repeated rows are turns of their own.  An empty table gives an
empty result.  Very long texts are hashed and rendered whole.  A conversation is one
row of the result, so its turns meet in one task; texts do so only for what stays.  Extra
columns are not read, so their names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, write_table


def _turns(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return table.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def rolling(turns: Column) -> Column:
    """The digest of every prefix of a sorted array of turns with ``d``, shortest first."""
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc, t):
        d = F.md5(F.concat(acc["last"], t["d"]))
        return F.struct(d.alias("last"), F.concat(acc["all"], F.array(d)).alias("all"))

    return F.aggregate(turns, zero, step, lambda acc: acc["all"])


def _digest() -> Column:
    """Of one turn, by its role and text."""
    return F.md5(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"))


def maximal(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation id, n_turns, copies, digest) of the conversations that stay; copies: how many are equal to it, itself included."""
    rows = _turns(table, conv, turn, role, text).select("c", F.struct("n", "role", _digest().alias("d")).alias("turn"))
    ordered = rows.where("c is not null").groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    single = rows.where("c is null").select("c", F.array("turn").alias("turns"))
    logged = write_table(ordered.unionByName(single).select("c", rolling(F.col("turns")).alias("prefixes")), "prefixes")
    whole = logged.select("c", F.size("prefixes").cast("long").alias("n_turns"), F.element_at("prefixes", -1).alias("d"))
    # equal conversations meet after partial aggregation, so a group of copies is one row of each task
    one = whole.groupBy("d", "n_turns").agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    parts = logged.where(F.size("prefixes") > 1).select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("d")).distinct()
    out = write_table(one.join(parts, "d", "left_anti").select(F.col("c").alias(conv), "n_turns", "copies", F.col("d").alias("digest")), "maximal")
    drop_table(logged)
    return out


def render(turns: Column) -> Column:
    """One text from sorted turns with ``role`` and ``text``."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def format_chats(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation id, n_turns, copies, rendered) for each maximal conversation."""
    stay = maximal(table, conv, turn, role, text).select(F.col(conv).alias("id"), "n_turns", "copies", "digest")
    rows = _turns(table, conv, turn, role, text)
    named, nameless = stay.where("id is not null"), stay.where("id is null")
    texts = rows.join(named.select("id"), F.col("c") == F.col("id"), "left_semi").groupBy("c").agg(render(F.sort_array(F.collect_list(F.struct("n", "role", "text")))).alias("rendered"))
    # equal turns meet after partial aggregation
    turns = rows.where("c is null").groupBy(rolling(F.array(F.struct(_digest().alias("d"))))[0].alias("digest")).agg(F.min(F.struct("role", "text")).alias("turn"))
    lone = turns.join(nameless, "digest").select(F.col("id").alias("c"), "n_turns", "copies", render(F.array("turn")).alias("rendered"))
    out = texts.join(named, F.col("c") == F.col("id")).select("c", "n_turns", "copies", "rendered").unionByName(lone)
    return out.withColumnRenamed("c", conv)

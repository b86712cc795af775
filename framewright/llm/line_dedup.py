"""Lines that many documents share, dropped from all of them.

A text is split at line feeds.  A line's key is the line without white space
(U+0020, U+0009 to U+000D) at both ends and with A-Z lower-cased.  Keys are
hashed to 128 bits.  Each document gives each of its hashes once, so the count
of rows for a hash is its number of documents, added up before the shuffle; a
line that every document has is one row of each task.  Hashes of enough
documents meet the lines again by a join that carries places, not texts: the
dropped places of a text become one row, which the text is joined with, and the
other lines are put together in their order.

Every row is a document of its own, also one that equals another: equal rows
count one each and have the same result.  They are known by 128 bits of their
text, so equal texts share their row of dropped places.  Null and empty texts
have one empty line, which stays; empty keys are never dropped.  Very long texts
are handled whole, in time proportional to their lines.  A null id is passed on.
An empty table gives an empty one.  Extra columns of any name are not read;
``deduplicated`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import WHITE, drop_table, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; a text of ASCII alone takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(WHITE)))


def hashed(value: Column, name: str) -> list[Column]:
    """Two columns of 64 bits that stand for the value."""
    return [F.xxhash64(F.lit(seed), value).alias(f"{name}{seed}") for seed in (1, 2)]


def shared_lines(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the keys of at least ``min_chars`` code points that at least ``min_docs`` rows of (text) have."""
    each = texts.select(F.explode(F.array_distinct(keys(F.col("text")))).alias("key")).where(F.char_length("key") >= min_chars)
    return each.select(*hashed(F.col("key"), "h")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def dropped_places(texts: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """(t1, t2, dropped): the places, from 0, of the lines that go, one row for each different text that has any."""
    lines = texts.select(*hashed(F.col("text"), "t"), F.posexplode(keys(F.col("text"))).alias("place", "key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("t1", "t2", "place", *hashed(F.col("key"), "h"))
    return lines.join(shared, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines at the given places; the lines are bound once, not for each place."""

    def joined(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(dropped.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), joined)[0])


def _deduped(docs: DataFrame, text: str, carried: list[str], min_docs: int, min_chars: int) -> DataFrame:
    """(text, n_lines, n_dropped, row) for every row; ``row`` has the carried columns, whose names may be any."""
    min_chars, whole = max(1, min_chars), F.coalesce(docs[text], F.lit(""))
    texts = docs.select(whole.alias("text"))
    shared = write_table(shared_lines(texts, min_docs, min_chars), "shared_lines")
    # a table of its own, so that the join's only needs are its two exchanges and the copies of one text can be split
    places = write_table(dropped_places(texts, shared, min_chars), "dropped_places")
    rows = docs.select(whole.alias("text"), *hashed(whole, "t"), F.struct(*[docs[c] for c in carried]).alias("row"))
    both = rows.join(places, ["t1", "t2"], "left")
    drop_table(shared)
    n_lines, n_dropped = F.size(F.split("text", "\n")), F.coalesce(F.array_size("dropped"), F.lit(0))
    return both.select(without(F.col("text"), F.col("dropped")).alias("text"), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), "row")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(id, text without the shared lines, n_lines, n_dropped) for every row; ``min_chars`` is at least 1."""
    return _deduped(docs, text, [id_col], min_docs, min_chars).select(F.col("row")[id_col].alias(id_col), "text", "n_lines", "n_dropped")


def deduplicated(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs``, with all their columns, and the text without the shared lines."""
    rows = _deduped(docs, text, docs.columns, min_docs, min_chars)
    return rows.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])

"""URL filters: fixed rules, and association rules mined by FP-growth.

Fixed rules (host and path) decide first: a rule fits its host and all
subdomains if the path starts with the rule's, and the longest fitting rule
wins.  Other URLs are judged by association rules: the tokens of labelled URLs
(host labels, path segments, query keys) form transactions.  FP-growth finds the
combinations that are frequent among the bad ones, by an absolute number, so
that a small host is found among many pages as among few.  Nothing but this number leaves out a token or a combination; tokens that
hold for the same labelled URLs are one (the first in order of text stands for them), and one that holds for all of them
says nothing, so neither multiplies combinations.  How many labelled URLs hold
a combination is counted by the inverted index over all of them.  Rules that conclude "bad"
are kept if confidence and lift are high enough, if so many bad URLs would hardly be bad
by chance (a bound on the binomial tail, divided by the number of combinations), and if no
rule with a part of their tokens is as confident.  The inverted index lists each rule under its rarest
token; a distinct URL looks up its tokens there, and a rule matches if all of
its tokens are present.

A null URL, or one without ``://``, has an empty host and path, fits no rule and
has no tokens: it is allowed.  Labels without a page, and null labels, teach
nothing; without labelled pages there are no rules.  Rows are judged by their URL
alone, so repeated rows get equal verdicts; of rules that match equally well the
last in order of text is named; an empty table gives an empty result.  Very long URLs are
read whole.  Columns other than the named ones are not read, so their names may be any.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, write_table

#: Fixed rules: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u, parts = F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, parts, 1), CAPITALS, CAPITALS.lower()), F.regexp_extract(u, parts, 2)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments (numbers are one token), query keys."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    named = lambda kind, x: F.transform(F.array_remove(x, ""), lambda t: F.concat(F.lit(kind), t))
    segments = F.transform(F.split(F.lower(path), "/"), lambda s: F.regexp_replace(s, r"^\d+", "#"))
    keys = F.transform(F.split(query, "&"), lambda s: F.substring_index(s, "=", 1))
    return F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", segments), named("q:", keys)))


def mine(labelled: DataFrame, least: int = 8, confidence: float = 0.6, lift: float = 1.5, doubt: float = 0.05) -> DataFrame:
    """(antecedent, anchor, confidence, lift, bad, total) from rows (tokens, bad).

    A combination is frequent if at least ``least`` bad URLs hold it.
    """
    spark = labelled.sparkSession
    rows = write_table(labelled.select(F.monotonically_increasing_id().alias("r"), "tokens", "bad"), "labelled")
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if bad < least:  # no combination can be frequent
        return spark.createDataFrame([], "antecedent array<string>, anchor string, confidence double, lift double, bad long, total long")
    usual = bad / n
    each = rows.select("r", "bad", F.explode("tokens").alias("token"))
    # which URLs hold a token, as 128 bits that don't depend on their order
    held = [F.bit_xor(F.xxhash64(F.lit(seed), "r")).alias(f"x{seed}") for seed in (1, 2)]
    counted = each.groupBy("token").agg(F.count("*").alias("of_all"), F.count_if("bad").alias("of_bad"), *held)
    known = write_table(counted.where((F.col("of_bad") >= least) & (F.col("of_all") < n)).groupBy("of_all", "x1", "x2").agg(F.min("token").alias("token")).select("token", "of_all"), "tokens")
    items = write_table(each.where("bad").join(known, "token").groupBy("r").agg(F.collect_list("token").alias("items")), "transactions")
    # half a URL less, so that rounding never asks for one more
    least_share = (least - 0.5) / max(least, items.count())
    model = FPGrowth(itemsCol="items", minSupport=least_share).fit(items)
    frequent = model.freqItemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("bad"))
    # each combination stands under its rarest token, where every labelled URL that may hold it looks it up
    rarest = frequent.select("*", F.explode("antecedent").alias("token")).join(known, "token").groupBy("antecedent", "bad").agg(F.min(F.struct("of_all", "token"))["token"].alias("anchor"))
    index = write_table(rarest, "combinations")
    looked = rows.select("tokens", F.explode("tokens").alias("anchor")).join(index.select("antecedent", "anchor"), "anchor")
    whole = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    totals = whole.groupBy("antecedent").agg(F.count("*").alias("total"))
    scored = index.join(totals, "antecedent").withColumn("confidence", F.col("bad") / F.col("total")).withColumn("lift", F.col("confidence") / usual)
    c, rest = F.col("confidence"), 1 - F.col("confidence")
    # a bound on the chance of so many bad ones: exp(-total * divergence)
    divergence = c * F.log(c / usual) + F.when(rest > 0, rest * F.log(rest / max(1 - usual, 1e-12))).otherwise(0.0)
    sure = F.col("total") * divergence >= math.log(max(1, index.count()) / doubt)
    rules = write_table(scored.where((c >= confidence) & (F.col("lift") >= lift) & sure), "rules")
    # a rule goes if one with a part of its tokens is as confident; that one is found under one of its tokens
    shorter = rules.select(F.col("antecedent").alias("some"), F.col("confidence").alias("sure"), F.col("anchor").alias("token"))
    longer = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    beaten = longer.join(shorter, "token").where((F.size("some") < F.size("antecedent")) & (F.size(F.array_except("some", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence"))).select("antecedent").distinct()
    out = write_table(rules.join(beaten, "antecedent", "left_anti").select("antecedent", "anchor", "confidence", "lift", "bad", "total"), "rules")
    for table in (rows, known, items, index, rules):
        drop_table(table)
    return out


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, matched): the most confident rule, as text, for each distinct URL that some rule matches."""
    each = urls.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    index = rules.select("antecedent", "confidence", F.col("anchor").alias("token"))
    hit = each.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("antecedent", " & ").alias("t")))["t"].alias("matched"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url: str = "url", label_id: str = "doc_id", rules: list[tuple[str, str, str]] | None = None, **options) -> DataFrame:
    """(id, host, path, rule, verdict, matched) for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    bad = labels.select(F.col(label_id).alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("id is not null and bad is not null")
    mined = mine(rows.join(bad, "id").select(tokens(F.col("url")).alias("tokens"), "bad"), **options)
    host, path = host_and_path(F.col("url"))
    named = rows.join(matching(rows, mined).withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    own = F.when(F.col("matched").isNotNull(), "block").otherwise("allow")
    return named.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "matched")

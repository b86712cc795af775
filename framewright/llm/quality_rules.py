"""Quality rules: a learned decision list over text statistics.

``statistics`` computes per-document counts with built-in expressions only;
``learn`` runs sequential covering over the labelled rows: each rule is a
conjunction of up to three threshold conditions, grown by information gain on
two thirds of the rows, pruned on the other third, and kept only if it is
precise there on enough rows; the rows it covers leave, and the next rule is
learned.  A rule that isn't kept gives way to the next best start.  All
counting is grouped aggregation over threshold bins; the driver sees one row
for each feature and bin.  ``as_expression`` renders the list as one ordered
CASE expression.

Null text counts as empty.  Documents without words have ratios of 0.  Labels
that are null, or whose document is missing, teach nothing; with no usable
labels the list is empty and only the base rule decides.  Rows with the same
id are judged one by one, and repeated rows alike; an empty table gives an empty result.
Of conditions with the same gain the first in the order of the features and thresholds is taken.  Very
long texts count whole, in one row's memory.  Extra columns of any name are not read, and
pass through whole where rows are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import WHITE, drop_table, write_table

# Rows of ``[#*$%&|<>]``, as plain text.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Each feature with its fixed grid of thresholds, so that a list doesn't depend on the partitioning of the data.
RATIOS = [0.001, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.125, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0]
FEATURES: dict[str, list[float]] = {
    "n_words": [5, 10, 20, 30, 40, 50, 75, 100, 200, 400, 1000, 3000, 10000],
    "mean_word": [2.0, 2.5, 3.0, 3.5, 4.0, 4.25, 4.5, 4.75, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 12.0],
    "symbol_ratio": RATIOS,
    "dup_line_ratio": RATIOS,
    "repeat_ratio": RATIOS,
    "distinct_ratio": RATIOS,
    "capital_ratio": RATIOS,
}

#: So many starts of rules are grown in one count.
BEAM = 16


def repeat_words(words: str) -> str:
    """SQL for the number of words in 3-word windows that stand twice or more in the text; ``words`` names an array of them.

    A window is a long of hash bits above and word position below; sorted, equal
    windows stand side by side.  Neighbours whose hash bits agree count only if
    their words agree too.  One-element arrays bind values to names.
    """
    packed = "transform(sequence(0L, size(W) - 3L), i -> shiftleft(xxhash64(W[int(i)], W[int(i) + 1], W[int(i) + 2]), k) | i)"
    words_agree = "exists(array(Y), y -> W[int(x & m)] = W[int(y & m)] and W[int(x & m) + 1] = W[int(y & m) + 1] and W[int(x & m) + 2] = W[int(y & m) + 2])"
    agree = f"(shiftrightunsigned(x ^ Y, k) = 0 and {words_agree})"
    marked = f"filter(s, (x, j) -> (j > 0 and {agree.replace('Y', 's[j - 1]')}) or (j < size(s) - 1 and {agree.replace('Y', 's[j + 1]')}))"
    fold = f"""aggregate(sort_array(transform({marked}, x -> x & m)), named_struct('n', 0L, 'end', 0L),
        (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.end), 'end', p + 3), a -> a.n)"""
    let = f"transform(array(sort_array({packed})), s -> {fold})[0]"
    let = f"transform(array(shiftleft(1L, k) - 1), m -> {let})[0]"
    return f"if(size(W) < 4, 0L, transform(array(cast(ceil(log2(size(W) + 1)) as int)), k -> {let})[0])".replace("W", words)


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(id, counts and ratios) for each row, in one pass without a shuffle; with ``carry`` also the whole row as ``_row``."""
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), *[F.struct(*docs.columns).alias("_row")] * carry)
    kept = ["_row"] * carry
    words = F.array_remove(F.split(F.translate(t, WHITE, " " * len(WHITE)), " "), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lengths = lambda s: F.length(t) - F.length(F.translate(t, s, ""))
    # one-element arrays bind a value to a name: each is computed once for a row
    of_words = F.expr(f"transform(array(w0), w -> named_struct('n_words', cast(size(w) as long), 'word_chars', cast(length(array_join(w, '')) as long), 'n_distinct', cast(size(array_distinct(w)) as long), 'n_repeat_words', {repeat_words('w')}))[0]")
    of_lines = F.expr("transform(array(l0), l -> named_struct('n_lines', cast(size(l) as long), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as long)))[0]")
    counted = rows.select(
        "id", words.alias("w0"), F.when(t.contains("\n"), lines).alias("l0"), t.alias("t"), *kept
    ).select(
        "id", of_words.alias("w"), of_lines.alias("l"),
        F.when(t.rlike(r"[#*$%&|<>]"), lengths(SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        lengths(CAPITALS).cast("long").alias("n_capitals"), *kept,
    )
    n = F.col("w.n_words")
    of = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return counted.select(
        F.col("id").alias(id_col), "w.n_words", "w.word_chars", "n_symbols", F.coalesce("l.n_dup_lines", F.lit(0)).alias("n_dup_lines"), "w.n_repeat_words",
        of(F.col("w.word_chars")).alias("mean_word"), of(F.col("n_symbols")).alias("symbol_ratio"),
        F.when(F.col("l.n_lines") > 0, F.col("l.n_dup_lines") / F.col("l.n_lines")).otherwise(F.lit(0.0)).alias("dup_line_ratio"),
        of(F.col("w.n_repeat_words")).alias("repeat_ratio"), of(F.col("w.n_distinct")).alias("distinct_ratio"),
        F.when(F.col("w.word_chars") > 0, F.col("n_capitals") / F.col("w.word_chars")).otherwise(F.lit(0.0)).alias("capital_ratio"), *kept,
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]


def condition(c: Condition) -> Column:
    """``>=`` or ``<`` a threshold of the grid."""
    name, op, value = c
    return F.col(name) >= value if op == ">=" else F.col(name) < value


def conjunction(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition(c)
    return out


def _binned(labelled: DataFrame) -> DataFrame:
    """Distinct vectors of bins with their numbers of rejected and accepted rows, apart for growing and pruning."""
    bins = [sum((F.when(F.col(f) >= x, 1).otherwise(0) for x in grid), F.lit(0)).cast("byte").alias(f) for f, grid in FEATURES.items()]
    fold = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) < 2, "grow").otherwise("prune").alias("fold")
    return labelled.select(*bins, fold, F.col("bad").cast("long").alias("bad")).groupBy(*FEATURES, "fold").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))


def _in_bins(rule: list[Condition]) -> Column:
    """The rule over bins: bin b holds the values from threshold b - 1 up to below threshold b."""
    out = F.lit(True)
    for name, op, value in rule:
        at = FEATURES[name].index(value) + 1
        out = out & (F.col(name) >= at if op == ">=" else F.col(name) < at)
    return out


Counts = dict[tuple[str, int], tuple[int, int]]


def _counts(rows: DataFrame, rules: list[list[Condition]]) -> list[dict[str, Counts]]:
    """For each rule and fold, the rejected and accepted rows that it covers by feature and bin; all in one aggregation."""
    out: list[dict[str, Counts]] = [{"grow": {}, "prune": {}} for _ in rules]
    fitting = F.filter(F.array(*[F.when(_in_bins(rule), i) for i, rule in enumerate(rules)]), lambda x: x.isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
    known = rows.select(F.explode(fitting).alias("i"), *FEATURES, "fold", "bad", "good").select("i", "fold", each, "bad", "good")
    for r in known.groupBy("i", "fold", "x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        out[r.i][r.fold][r.f, r.b] = (r.bad, r.good)
    return out


def _covered(counts: Counts, c: Condition | None = None) -> tuple[int, int]:
    """The rejected and accepted rows in the counts, all or those that the condition holds for."""
    name, op, value = c or (next(iter(FEATURES)), ">=", None)
    at = FEATURES[name].index(value) + 1 if c else 0
    of_bins = [v for (f, b), v in counts.items() if f == name and (b >= at) == (op == ">=")]
    return sum(v[0] for v in of_bins), sum(v[1] for v in of_bins)


def _extensions(counts: Counts, least: int) -> list[Condition]:
    """The conditions that add information about the rejected rows, those that add most first."""
    bad0, good0 = _covered(counts)
    gains = []
    for f, grid in FEATURES.items() if bad0 else ():
        for value in grid:
            for op in (">=", "<"):
                bad, good = _covered(counts, (f, op, value))
                if bad >= least:
                    gain = bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))
                    if gain > 1e-9:
                        gains.append((-round(gain, 9), len(gains), (f, op, value)))
    return [c for _, _, c in sorted(gains)]


def _by_chance(bad: int, good: int, share: float) -> float:
    """The probability of at most ``good`` accepted rows among these if each is rejected with probability ``share``."""
    if share >= 1:
        return 1.0
    n, of = bad + good, math.lgamma
    return math.fsum(math.exp(of(n + 1) - of(k + 1) - of(n - k + 1) + (n - k) * math.log(share) + k * math.log1p(-share)) for k in range(good + 1))


def learn(labelled: DataFrame, most_conditions: int = 3, precision: float = 0.995, least: int = 4, doubt: float = 0.05) -> list[list[Condition]]:
    """An ordered list of rejecting rules from rows (id, features, bad 0/1).

    Every condition with gain is tried as the start of a rule, by falling gain, ``BEAM`` starts in one count.  A
    start whose rule isn't precise on the pruning rows is set aside and the next one is tried; covering ends when no
    start is left.  The more starts were tried, the more pruning rows a rule needs: rows of which no more than the
    usual share (or half) are rejected would look as precise with a probability of at most ``doubt`` / tried.
    """
    table = write_table(_binned(labelled), "bins")
    rules: list[list[Condition]] = []
    left, failed, tried = table, set(), 0
    while True:
        [first] = _counts(left, [[]])
        rejected, accepted = _covered(first["prune"])
        usual = max(0.5, rejected / max(1, rejected + accepted))
        starts = [c for c in _extensions(first["grow"], least) if c not in failed]
        accept = None
        for at in range(0, len(starts), BEAM):
            grown = [[c] for c in starts[at : at + BEAM]]
            sums = [[_covered(first["prune"], c)] for c in starts[at : at + BEAM]]
            open_ = [i for i, [c] in enumerate(grown) if _covered(first["grow"], c)[1]]
            while open_:
                longer = []
                for i, counts in zip(open_, _counts(left, [grown[i] for i in open_])):
                    found = _extensions(counts["grow"], least)
                    if found:
                        grown[i].append(found[0])
                        sums[i].append(_covered(counts["prune"], found[0]))
                        if _covered(counts["grow"], found[0])[1] and len(grown[i]) < most_conditions:
                            longer.append(i)
                open_ = longer
            for rule, of_rule in zip(grown, sums):
                tried += 1
                scored = [
                    ((bad - good) / (bad + good), -i) for i, (bad, good) in enumerate(of_rule, 1)
                    if bad and bad >= precision * (bad + good) and _by_chance(bad, good, usual) <= doubt / tried
                ]
                if scored:
                    accept = rule[: -max(scored)[1]]
                    break
                failed.add(rule[0])
            if accept:
                break
        if not accept:
            break
        rules.append(accept)
        left = left.where(~_in_bins(accept))
    drop_table(table)
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """Position of the first rule that fires (from 1), else 0: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(conjunction(rule), i) if out is None else out.when(conjunction(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label_id: str = "doc_id", quality: str = "quality", carry: bool = False, **options) -> DataFrame:
    """Statistics, ``base_failed``, the number of the rule that rejects (0: none) and ``kept`` for each row."""
    stats = write_table(statistics(docs, id_col, text, carry), "statistics")
    wanted = labels.select(F.col(label_id).alias("id"), (F.col(quality) == 0).cast("int").alias("bad")).where("id is not null and bad is not null")
    labelled = stats.select(F.col(id_col).alias("id"), *FEATURES).join(wanted, "id")
    rules = learn(labelled, **options)
    return stats.withColumns({"base_failed": base_failed(), "rule": as_expression(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rule and the learned list keep."""
    return judge(docs, labels, carry=True, **options).where("kept").select("_row.*")

"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts.  Sources in code-point order (null last) weigh 5, 2, 1,
repeating; together they share 150 % of all sizes.  No target exceeds twice its
source's size: what is above is shared again by weight until none is above.

A source first takes whole copies of all its documents (none or one), then a
subset for the remaining budget, which comes as near to it as any subset can from below.  Documents are counted by
exact size, sizes are divided by their greatest common divisor, and a bounded knapsack runs over the counts.  First over
what a share of each size, rounded down, leaves of the budget, a small part of it; that nearly always fills it exactly.  If it
doesn't, few documents or few sizes are gone through whole, and else the knapsack runs over the whole budget.
Only a budget above 16,777,216 (after the division) with three sizes or more and over four million combinations of counts is filled from
its last 16,777,216 words alone; what it may then miss is less than the smallest document left.  Only counts by size enter this:
one row for each source and size.  Which documents of a size are taken follows
a seeded hash of id and text.

A size's documents fall into hash slices whose numbers are added up first; only
the slice that holds the last document taken is ordered, by one row for each hash,
so the documents of a hot size never meet in one task, and texts are not shuffled.
Equal rows (same id, source and text) share a hash: if only some of them are
taken, they are numbered, again in slices, and the exact number is taken; as they
are equal, it makes no difference which.

Null text has size 0; documents of size 0 are taken once.  A
null id is an id of its own.  An empty table gives an empty result.  Very long
texts count whole and are never more than twice in the mix.  Extra columns of any name are not
read, and pass through whole in ``mixed``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, word_array, write_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
SLICES = 1024
#: Parts of the budget over which the knapsack runs, the next if the one before leaves some; combinations of counts that are gone through one by one; steps between kept states.
WINDOWS, COMBINATIONS, KEPT = (1 << 17, 1 << 20, 1 << 24), 1 << 22, 64


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources reach their limits in order of limit per weight.  With the first j
    at theirs, the rest share what is left by weight: the right j is the first
    at which nobody else is above the limit.  Later ones give lower levels.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    named = totals.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = named.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    target = F.when(F.col("free"), F.col("w") * final).otherwise(F.col("cap"))
    return leveled.select("source", "source_size", target.alias("target"))


def knapsack(counts: list[tuple[int, int]], budget: int) -> tuple[int, dict[int, int]]:
    """The largest total up to ``budget`` of sizes taken at most ``count`` times each, and how many of each.

    Reachable totals are the bits of one integer; each binary split of a count
    is one shift.  It stops as soon as the budget itself is reachable.  Every ``KEPT``-th state is
    kept; those between are made again on the way back.
    """
    full = (1 << budget + 1) - 1
    steps = []
    for size, count in counts:
        part = 1
        while count > 0 and size * (take := min(part, count)) <= budget:
            steps.append((size, take))
            count, part = count - take, part * 2
    reach, states = 1, []
    for k, (size, take) in enumerate(steps):
        if k % KEPT == 0:
            states.append(reach)
        reach |= reach << size * take & full
        if reach >> budget & 1:
            del steps[k + 1 :]
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for k in range((len(steps) - 1) // KEPT, -1, -1):
        part = steps[k * KEPT : (k + 1) * KEPT]
        before = [states[k]]
        for size, take in part[:-1]:
            before.append(before[-1] | before[-1] << size * take & full)
        for (size, take), state in zip(reversed(part), reversed(before)):
            if not state >> at & 1:
                taken[size] = taken.get(size, 0) + take
                at -= size * take
    return best, taken


def _every(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """The best of all combinations of counts."""
    sums = np.zeros(1, np.int64)
    for s, c in zip(sizes, counts):
        sums = (sums[:, None] + s * np.arange(c + 1)[None]).reshape(-1)
    at = int(np.argmax(np.where(sums <= budget, sums, -1)))
    taken = []
    for c in reversed(counts):
        at, t = divmod(at, c + 1)
        taken.append(t)
    return taken[::-1]


def _two(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """The best of two sizes, however many documents: what the first leaves for the second repeats after as many documents as the second size says."""
    (a, b), (n, m) = sizes, counts
    least = max(0, -(-(budget - m * b) // a) - 1)
    first = np.arange(least, min(n, budget // a, least + b + 1) + 1)
    second = np.minimum(m, (budget - first * a) // b)
    k = int(np.argmax(first * a + second * b))
    return [int(first[k]), int(second[k])]


def _windowed(sizes: list[int], counts: list[int], budget: int, window: int) -> list[int]:
    """A share of every size for all but the last part of the budget, and the knapsack for the rest; one document of each size at least is left for that, if it has any."""
    total = sum(s * c for s, c in zip(sizes, counts))
    taken = [max(0, min(c - 1, c * (budget - window) // total)) if budget > window else 0 for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if left <= window:
            break
        more = min(counts[i] - taken[i] - 1, (left - window // 2) // sizes[i])
        if more > 0:
            taken[i] += more
            left -= more * sizes[i]
    while left > window:  # what is left for the knapsack alone is more than its part: the largest of it go first
        i = max((i for i in range(len(sizes)) if taken[i] < counts[i] and sizes[i] <= left), key=lambda i: sizes[i], default=None)
        if i is None:
            break
        taken[i] += 1
        left -= sizes[i]
    at = {s: i for i, s in enumerate(sizes)}
    spare = [(s, c - t) for s, c, t in zip(sizes, counts, taken) if c > t and s <= left]
    for s, t in knapsack(sorted(spare, reverse=True), min(left, window))[1].items() if spare else ():
        taken[at[s]] += t
    return taken


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their total comes as near ``budget`` as it can from below."""
    there = [i for i in range(len(sizes)) if sizes[i] > 0 and counts[i] > 0]
    out = [0] * len(sizes)
    if not there or budget <= 0:
        return out
    unit = math.gcd(*(sizes[i] for i in there))
    s, c = [sizes[i] // unit for i in there], [counts[i] for i in there]
    budget = min(budget // unit, sum(a * b for a, b in zip(s, c)))
    sum_of = lambda taken: sum(a * t for a, t in zip(s, taken))
    best = _windowed(s, c, budget, WINDOWS[0])
    if sum_of(best) < budget:
        if math.prod(n + 1 for n in c) <= COMBINATIONS:
            best = _every(s, c, budget)
        elif len(s) == 2:
            best = _two(s, c, budget)
        else:
            for window in WINDOWS[1:]:
                best = max(best, _windowed(s, c, budget, window), key=sum_of)
                if sum_of(best) == budget or window >= budget:
                    break
    for i, t in zip(there, best):
        out[i] = t
    return out


def _sized(docs: DataFrame, id_col: str, source: str, text: str, seed: int, carry: bool) -> DataFrame:
    """(id, source, size, h, slice) of each row; h orders the documents of a size by the seed."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("h"), *[F.struct(*docs.columns).alias("_row")] * carry,
    )
    return rows.withColumn("slice", F.pmod(F.shiftrightunsigned("h", 32), F.lit(SLICES)).cast("int"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Both have the same source (null is one) and the same values of the other columns."""
    out = a["source"].eqNullSafe(b["source"])
    for n in names:
        out = out & (a[n] == b[n])
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, carry: bool = False, **options) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row; with ``carry`` also the whole row as ``_row``."""
    sized = write_table(_sized(docs, id_col, source, text, seed, False), "sized")
    slices = write_table(sized.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "slices")
    counts = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = write_table(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), **options), "targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        base = min(MOST, int(target // size)) if size else 1
        extra = fit(pdf["size"].tolist(), pdf.n.tolist(), math.floor(target - base * size + 0.5)) if base < MOST and size else [0] * len(pdf)
        return pdf[["source", "size", "source_size", "target"]].assign(base=[base if s else 1 for s in pdf["size"]], extra=extra)

    of_source = counts.join(goals, _same(counts, goals)).select(goals["source"], "size", "n", "source_size", "target")
    planned = write_table(of_source.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, base long, extra long"), "plan")

    # the last document of each size that is taken once more: in which slice it is, its hash, and how many rows with that hash are taken
    in_order = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    last = offsets.join(planned, _same(offsets, planned, "size")).where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("n")))
    last = write_table(last.select(offsets["source"], offsets["size"], "slice", (F.col("extra") - F.col("before")).alias("place")), "last")
    there = sized.join(last, _same(sized, last, "size", "slice")).groupBy(sized["source"], sized["size"], sized["slice"], "place", "h").agg(F.count("*").alias("alike"))
    to_here = Window.partitionBy("source", "size", "slice").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cuts = there.withColumn("upto", F.sum("alike").over(to_here)).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("alike") < F.col("place")))
    cuts = cuts.select("source", "size", F.col("slice").alias("cut_slice"), F.col("h").alias("cut_h"), (F.col("place") - F.col("upto") + F.col("alike")).alias("some"), "alike")
    final = write_table(planned.join(cuts, _same(planned, cuts, "size"), "left").select(planned["source"], planned["size"], "source_size", "target", "base", "cut_slice", "cut_h", "some", "alike"), "mix")

    rows = _sized(docs, id_col, source, text, seed, True) if carry else sized
    both = rows.join(final, _same(rows, final, "size")).select(rows["id"], rows["source"], rows["size"], "slice", "h", "source_size", "target", "base", "cut_slice", "cut_h", "some", "alike", *["_row"] * carry)
    tied = F.coalesce((F.col("h") == F.col("cut_h")) & (F.col("some") < F.col("alike")), F.lit(False))
    once_more = (F.col("slice") < F.col("cut_slice")) | (F.col("slice") == F.col("cut_slice")) & (F.col("h") <= F.col("cut_h"))
    kept = ["id", "size", "source_size", "target", *["_row"] * carry]
    out = both.where(~tied).select(*kept, (F.col("base") + F.coalesce(once_more, F.lit(False)).cast("long")).alias("copies"))
    if not final.where("some < alike").isEmpty():
        out = out.unionAll(_numbered(both.where(tied)).select(*kept, (F.col("base") + F.col("more")).alias("copies")))
    for table in (slices, goals, planned, last, *([sized] if carry else [])):
        drop_table(table)
    return out.select(F.col("id").alias(id_col), *kept[1:4], "copies", *kept[4:]).withColumn("taken", F.col("copies") * F.col("size"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows with ``more``: 1 for as many of them as ``some`` says, else 0."""
    number = F.monotonically_increasing_id()
    written = write_table(rows.withColumn("m", number).withColumn("part", F.pmod(F.xxhash64("m"), F.lit(SLICES))), "tied")
    sums = written.groupBy("source", "size", "some", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = sums.withColumn("room", F.col("some") - F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("part").alias("q_part"), "room", F.col("n").alias("of_part"))
    dealt = written.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("part") == F.col("q_part"))).drop("q_source", "q_size", "q_part")
    # only the part in which the number is reached is numbered row by row
    whole = dealt.where("room <= 0 or room >= of_part").withColumn("more", (F.col("room") > 0).cast("long"))
    cut = dealt.where("room > 0 and room < of_part").withColumn("at", F.row_number().over(Window.partitionBy("source", "size").orderBy("m")))
    return whole.unionAll(cut.withColumn("more", (F.col("at") <= F.col("room")).cast("long")).drop("at"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken."""
    rows = mix(docs, carry=True, **options).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")

"""Stages of the pipeline against computations that share no code with them, and very long input."""

from __future__ import annotations

import re

import numpy as np
import pytest

from framewright.llm import chat, quality_rules
from tests.llm.test_operators import counts_by_hand

# --- quality rules: statistics and the list's verdict by hand


def statistics_by_hand(text):
    t = text or ""
    n, chars, symbols, dup, repeated = counts_by_hand(t)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda x, of: x / of if of else 0.0
    return {"n_words": n, "mean_word": share(chars, n), "symbol_ratio": share(symbols, n), "dup_line_ratio": share(dup, len(lines)) if "\n" in t else 0.0, "repeat_ratio": share(repeated, n), "distinct_ratio": share(len(set(words)), n), "capital_ratio": share(len(re.findall("[A-Z]", t)), chars)}


def covered(rule, row):
    return all(row[name] >= value if op == ">=" else row[name] < value for name, op, value in rule)


def test_quality_stage_by_hand(spark):
    """The list is learned from statistics made by hand; what it then rejects is told by hand as well."""
    import corpus_pipeline

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    stats = {r.doc_id: statistics_by_hand(r.text) for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id is not None and r.quality is not None}
    learned = quality_rules.learn(spark.createDataFrame([{"id": i, "bad": int(labels[i] == 0), **{k: float(v) if k != "n_words" else v for k, v in stats[i].items()}} for i in sorted(labels) if i in stats]))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, data).collect()}
    want = {i for i, s in stats.items() if s["n_words"] >= 50 and 2 * s["repeat_ratio"] <= 1 and not any(covered(rule, s) for rule in learned)}
    assert kept == want and learned and len(want) < len(stats)
    # the rules are precise on all labelled rows, and without them more of the rejected rows stay
    fired = [labels[i] for i in labels if i in stats and any(covered(rule, stats[i]) for rule in learned)]
    assert fired and sum(fired) <= 0.05 * len(fired)


# --- decontamination: edit distance row by row, after the lemma of shared grams


def normalized(text):
    return " ".join((text or "").lower().split())


def fewest_edits(item, text):
    """Of turning any substring of the text into the item: one row of the table for each of the item's characters."""
    codes = np.array([ord(c) for c in text], np.int64)
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def leaks(item, text, q=4):
    k = len(item) // 12
    if len(item) < 24:
        return re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text) is not None
    grams = {text[i : i + q] for i in range(len(text) - q + 1)}
    if sum(item[i : i + q] in grams for i in range(len(item) - q + 1)) < len(item) - q + 1 - k * q:
        return False  # k edits spoil k * q grams at most
    return fewest_edits(item, text) <= k


def edited(rnd, item, edits):
    out = list(item)
    for _ in range(edits):
        at = rnd.integers(len(out))
        kind = rnd.integers(3)
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            out.insert(at, "z")
        else:
            del out[at]
    return "".join(out)


def test_decontamination_stage_by_edit_distance(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [x for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if (x := normalized(r.text))]
    rnd = np.random.default_rng(4)
    planted = []
    for n, item in enumerate(items):
        k = len(item) // 12
        planted += [(10_000 + 2 * n, f"before that {edited(rnd, item, k)} and after"), (10_001 + 2 * n, f"before that {edited(rnd, item, 2 * k + 3)} and after")]
    small = docs.where("n_chars < 3000").select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, small, data).collect()}
    want = {r.doc_id for r in small.collect() if not any(leaks(x, normalized(r.text)) for x in items)}
    assert kept == want
    assert not any(10_000 + 2 * n in kept for n in range(len(items))) and any(i >= 10_000 for i in kept)


# --- very long input


def test_very_long_conversation_and_turn(spark):
    """A conversation of many turns, of which another is all but the last, and a turn of millions of characters."""
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000)]
    turns += [(2, k, role, text) for _, k, role, text in turns[:-1]]
    long = "word " * 600_000
    turns += [(3, 0, "user", long), (4, 0, "user", long), (4, 1, "assistant", "yes")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 4} and got[1].n_turns == 3000 and got[4].rendered == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_ranked_search", "op13_vector_codes"])
def test_query_against_sql(spark, data, name):
    from framewright.llm.queries import ORACLES, QUERIES
    from tests.compare import same_rows

    same_rows(QUERIES[name](spark, data), ORACLES[name], data)

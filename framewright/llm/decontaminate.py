"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and each run of white space becomes one space.
An item of m characters may be found with up to k = m // 12 edits (``per``).
Cut into k + 1 pieces, at least one piece of any such occurrence is unedited:
an Aho-Corasick automaton over the pieces finds those, and each hit is
verified around its place by Myers' bit-parallel edit distance (an occurrence
may start and end anywhere).  The items are the query set: they are taken in
blocks of bounded size, and every block is matched against every document.

An item under ``min_chars`` normalized characters has no budget: it is found
wherever it stands exactly, at the start and end of words, since a few letters
within others say nothing.  An empty or null item or document matches nothing.  A null document
id is passed on.  One row results per document row and item, with the fewest
edits and the leftmost end among those.  Very long texts are searched whole, in
time that grows with their length; repeated rows give repeated results, empty
tables empty ones.  Extra columns are not read, those of ``decontaminate`` pass through under any name.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import on_worker

BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
#: An edit for so many characters of an item.
PER = 12


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` consecutive pieces of near-equal length, each with its offset."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """Fewest edits that turn a substring of ``text`` into ``item`` (at most ``most``) and where that substring ends.

    Myers' bit-vector recurrence; a Python integer holds the whole column.
    """
    m = len(item)
    if masks is None:
        masks = item_masks(item)
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, None
    get = masks.get
    for end, ch in enumerate(text, 1):
        eq = get(ch, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        h = minus | (~(d | plus) & every)
        v = plus & d
        if h & top:
            score += 1
        elif v & top:
            score -= 1
        h = (h << 1) & every
        plus = ((v << 1) & every) | (~(d | h) & every)
        minus = d & h
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
            if not score:
                break
    return best


def item_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def merged(spans: list[list[int]]) -> list[list[int]]:
    """The union of the spans, as disjoint ones by ascending start."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], per: int, min_chars: int):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normalize(t)) for i, t in items) if t]
        self.budget = [len(t) // per if len(t) >= min_chars else 0 for _, t in self.items]
        self.short = [len(t) < min_chars for _, t in self.items]
        self.masks = [item_masks(t) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, self.budget[k] + 1):
                found.setdefault(piece, []).append((k, at + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def match(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Index of each item found, with its edits and the end in the normalized text."""
        text = normalize(text)
        out: dict[int, tuple[int, int]] = {}
        if not self.any or not text:
            return out
        # where an occurrence that holds a hit can lie; hits come by ascending end, so those of a repeated piece may go back in start
        windows: dict[int, list[list[int]]] = {}
        for end, where in self.automaton.iter(text):
            for k, within in where:
                start, most = end - within, self.budget[k]
                if k in out and not out[k][0]:
                    continue
                item = self.items[k][1]
                if self.short[k]:
                    inner, after = item[0].isalnum() and text[max(0, start - 1) : start].isalnum(), start + len(item)
                    if not (inner or item[-1].isalnum() and text[after : after + 1].isalnum()):
                        out[k] = (0, after)
                    continue
                if text.startswith(item, start) if start >= 0 else False:
                    out[k] = (0, start + len(item))
                    continue
                low, high = max(0, start - most), start + len(item) + most
                spans = windows.setdefault(k, [])
                if spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    spans[-1] = [min(low, spans[-1][0]), max(high, spans[-1][1])]
                else:
                    spans.append([low, high])
        for k, spans in windows.items():
            if k in out:
                continue
            for low, high in merged(spans):
                got = best_match(self.items[k][1], text[low:high], self.budget[k], self.masks[k])
                if got and (k not in out or got[0] < out[k][0]):
                    out[k] = (got[0], low + got[1])
        return out


def item_blocks(items: DataFrame, id_col: str, text: str):
    """The query set in blocks of bounded size, in id order."""
    block, chars = [], 0
    for i, t in items.select(id_col, text).where(F.col(text).isNotNull()).orderBy(id_col, text).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(t) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((i, t))
        chars += len(t)
    if block:
        yield block


def on_workers(spark, block: list, per: int, min_chars: int):
    """A function that gives a worker's one matcher of the block."""
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def get() -> Matcher:
        return on_worker(("matcher", key), lambda: Matcher(shared.value, per, min_chars))

    return get


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", per: int = PER, min_chars: int = 24) -> DataFrame:
    """(id, item id, edits, budget, match_end) for each document row that holds an item; clean documents give no row.

    Blocks of items are broadcast one by one, each at most ``BLOCK_CHARS`` characters or one item.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = {"string": pa.string(), "int": pa.int32()}.get(item_kind, pa.int64())
    schema = f"{id_col} {doc_kind}, {item_col} {item_kind}, edits int, budget int, match_end long"
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    found = None
    for block in item_blocks(items, item_col, item_text):
        matcher_of = on_workers(spark, block, per, min_chars)

        def match(batches, matcher_of=matcher_of):
            matcher = matcher_of()
            for batch in batches:
                rows = []
                for j, t in enumerate(batch.column(1).to_pylist()):
                    rows += [(j, k, *got) for k, got in sorted(matcher.match(t).items())]
                at = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array([matcher.items[r[1]][0] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([matcher.budget[r[1]] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
                ], names=[id_col, item_col, "edits", "budget", "match_end"])

        one = source.mapInArrow(match, schema)
        found = one if found is None else found.unionAll(one)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", per: int = PER, min_chars: int = 24) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item: a filter row by row, without a join."""
    at = docs.columns.index(text)
    for block in item_blocks(items, item_col, item_text):
        matcher_of = on_workers(docs.sparkSession, block, per, min_chars)

        def clean(batches, matcher_of=matcher_of):
            matcher = matcher_of()
            for batch in batches:
                yield batch.filter(pa.array([not matcher.match(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

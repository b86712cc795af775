"""Ranked search by words: an index of posting blocks with maximum impacts, searched by Block-Max WAND.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.
Documents are cut into segments of bounded size within the partitions they are read in, so
no posting is shuffled.  A segment's row for a term has its postings, in order of document, in blocks of 128:
differences of document numbers and occurrences, each as narrow as the block
allows, and outside the compressed bytes each block's first and last document and its largest
impact.  A segment numbers its documents in order of id, so ties need no ids.

A search moves over the blocks of its terms by these heads alone: between two neighbouring
block ends of any of its terms, each term has one block at most, and the sum of their largest impacts bounds every score there.
The stretches with the highest bounds are opened first; a stretch whose bound is below
the score of the k-th best so far is skipped, and its blocks stay compressed unless another stretch or
query opens them.  Scores are whole numbers and exact, whatever is skipped.  Each segment gives
its best k; the best k of all segments are ranked.

Queries reach the segments in blocks of bounded size (``MOST_ITEMS``, ``MOST_CHARS``), each with
the document counts of its terms; a segment's task gets the rows of these terms alone.

A null or empty text has no terms: as a document it doesn't count and is never found; as an item
it has no rows.  Very long texts count whole; one is a segment of its own if it must be.  Equal scores are ranked by
ascending id, null ids last; rows with equal ids, repeated rows too, are documents of their own.  Repeated items
each have their rows.  An empty table on either side gives an empty one.  Extra columns of any name are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import write_table

BLOCK = 128
#: A segment ends when it has so many documents or terms, repeats included; documents are taken in by so many bytes at a time, or one.
SEGMENT_DOCS, SEGMENT_TERMS, AT_ONCE = 32_768, 2_000_000, 2 << 20
#: Items that are searched for at once.
MOST_ITEMS, MOST_CHARS = 5_000, 4_000_000
#: Weights of length in a document's score, in hundredths, and what a posting's impact is scaled by.
LENGTH_SHARE, IMPACT, SATURATION = 25, 1_000_000_000, 12

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_SPACED).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return IMPACT * tf // (1000 * tf + SATURATION * m)


@dataclass
class Stats:
    """Documents with a term, and all their terms."""

    docs: int
    terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        """What a document's number of terms adds to the denominator of its impacts."""
        return 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.docs // max(1, self.terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


# --- index


def corpus_stats(texts: DataFrame) -> Stats:
    """Of (text: binary): one row of each task."""

    def count(batches):
        docs = total = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms(text.as_py()))
                docs, total = docs + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([total], pa.int64())})

    row = texts.mapInArrow(count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return Stats(row.docs or 0, row.terms or 0)


class Segment:
    """Documents and their postings while a segment grows."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        """A batch of documents; those without terms are left out."""
        found = [(i, w) for i, w in zip(ids, map(terms, texts)) if w]
        if not found:
            return
        n = np.array([len(w) for _, w in found])
        words = np.empty(int(n.sum()), object)
        words[:] = [x for _, w in found for x in w]
        codes, fresh = pd.factorize(words)
        numbers = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in fresh], np.int64)
        pairs, tf = np.unique(numbers[codes] << 32 | np.repeat(np.arange(len(found)) + len(self.ids), n), return_counts=True)
        self.parts.append((pairs >> 32, pairs & 0xFFFFFFFF, tf))
        self.ids += [i for i, _ in found]
        self.lengths += n.tolist()
        self.size += len(words)

    def rows(self, number: int, kind: pa.DataType, stats: Stats) -> pa.RecordBatch:
        """The segment's rows: one for its documents, without a term, and one for each term."""
        ids = pa.array(self.ids, kind)
        order = pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths)[order]
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts))
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        df = np.bincount(term, minlength=len(self.numbers))
        begin = np.cumsum(df) - df
        within = np.arange(len(term)) - begin[term]
        starts = np.flatnonzero(within % BLOCK == 0)
        data, sizes = packed(doc, tf, starts)
        first, last, peak = doc[starts], doc[np.append(starts[1:], len(doc)) - 1], np.maximum.reduceat(impacts(tf, stats.length(lengths)[doc]), starts)
        blocks = np.concatenate(([0, 0], np.cumsum(-(-df // BLOCK))))
        ends = np.concatenate(([0], np.cumsum(sizes)))[blocks[1:]]
        listed = lambda x: pa.ListArray.from_arrays(pa.array(blocks.astype(np.int32)), pa.array(x.astype(np.int32)))
        bytes_ = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_pydict({
            "segment": pa.array(np.full(len(df) + 1, number)), "term": pa.array([None, *self.numbers], pa.binary()), "df": pa.array(np.concatenate(([0], df))),
            "first": listed(first), "last": listed(last), "peak": listed(peak), "data": pa.concat_arrays([pa.array([lengths.astype(np.int64).tobytes()], pa.binary()), bytes_]),
            "ids": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), pa.nulls(len(df), pa.list_(kind))]),
        })


def widths(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes that the largest value of each block takes: 1, 2 or 4."""
    most = np.maximum.reduceat(x, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def offsets(starts: np.ndarray, lengths: np.ndarray, wide: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each posting of blocks that start at the given bytes: where its document and its occurrences are."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + within * np.repeat(wide, lengths), np.repeat(starts + lengths * wide, lengths) + within * np.repeat(narrow, lengths)


def packed(doc: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blocks and each block's size: two widths, differences of documents, occurrences."""
    lengths = np.diff(np.append(starts, len(doc)))
    step = np.diff(doc, prepend=0)
    step[starts] = 0
    wide, narrow = widths(step, starts), widths(tf, starts)
    sizes = 2 + lengths * (wide + narrow)
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[at], out[at + 1] = wide, narrow
    for value, where, width in zip((step, tf), offsets(at + 2, lengths, wide, narrow), (wide, narrow)):
        each = np.repeat(width, lengths)
        for k in range(4):
            there = each > k
            out[where[there] + k] = value[there] >> 8 * k & 255
    return out, sizes


def unpacked(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, occurrences) of the blocks that start at the given bytes."""
    wide, narrow = data[at].astype(np.int64), data[at + 1].astype(np.int64)
    got = []
    for where, width in zip(offsets(at + 2, lengths, wide, narrow), (wide, narrow)):
        each, value = np.repeat(width, lengths), np.zeros(int(lengths.sum()), np.int64)
        for k in range(4):
            there = each > k
            value[there] |= data[where[there] + k].astype(np.int64) << 8 * k
        got.append(value)
    total = np.cumsum(got[0])
    begin = np.cumsum(lengths) - lengths
    return total - np.repeat(total[begin] - first, lengths), got[1]


@dataclass
class Index:
    """``rows``: (segment, term, df, first, last, peak, data, ids); the row of a segment without a term has its documents."""

    rows: DataFrame
    stats: Stats
    id_col: str


def _by_size(batch: pa.RecordBatch):
    """The rows of (id, text) in parts of about ``AT_ONCE`` bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(upto // AT_ONCE)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """Every document, in segments, as a table in the shared folder."""
    texts = docs.select(docs[id_col].alias("id"), docs[text].cast("binary").alias("text"))
    stats = corpus_stats(texts.select("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches):
        segment, number = Segment(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in _by_size(whole):
                segment.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if len(segment.ids) >= SEGMENT_DOCS or segment.size >= SEGMENT_TERMS:
                    yield segment.rows(number, whole.schema.field(0).type, stats)
                    segment, number = Segment(), number + 1
        if segment.ids:
            yield segment.rows(number, whole.schema.field(0).type, stats)

    schema = f"segment long, term binary, df long, first array<int>, last array<int>, peak array<int>, data binary, ids array<{kind}>"
    return Index(write_table(texts.mapInArrow(index, schema), "segments"), stats, id_col)


# --- search


class Postings:
    """A segment's blocks of the terms that are searched for; blocks are opened when a query first needs them."""

    def __init__(self, rows: pa.Table, stats: Stats):
        whole = rows.filter(pc.is_null(rows["term"]))
        words = rows.filter(pc.is_valid(rows["term"]))
        self.ids = whole["ids"][0].values
        self.m = stats.length(np.frombuffer(whole["data"][0].as_py(), np.int64))
        self.number = {t: k for k, t in enumerate(words["term"].to_pylist())}
        joined = lambda c: pc.list_flatten(words[c]).to_numpy().astype(np.int64)
        self.first, self.last, self.peak = joined("first"), joined("last"), joined("peak")
        data, df = words["data"].to_pylist(), words["df"].to_numpy()
        count = -(-df // BLOCK)
        self.begin = np.concatenate(([0], np.cumsum(count)))
        self.lengths = np.full(len(self.first), BLOCK)
        self.lengths[self.begin[1:] - 1] = df - (count - 1) * BLOCK
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.at = self._bytes(np.cumsum([0, *map(len, data)]))
        self.opened = np.zeros(len(self.first), bool)
        self.doc, self.impact = np.zeros(self.starts[-1], np.int64), np.zeros(self.starts[-1], np.int64)

    def _bytes(self, term_at: np.ndarray) -> np.ndarray:
        """Where each block's bytes begin: blocks follow one another, each as long as its two widths say."""
        at = np.zeros(len(self.first), np.int64)
        here = term_at[:-1].copy()
        left = np.diff(self.begin)
        k = 0
        while (some := np.flatnonzero(left > k)).size:
            block = self.begin[some] + k
            at[block] = here[some]
            here[some] += 2 + self.lengths[block] * (self.data[here[some]].astype(np.int64) + self.data[here[some] + 1])
            k += 1
        return at

    def postings(self, blocks: np.ndarray) -> np.ndarray:
        """Where the postings of the blocks are, all of them opened."""
        new = blocks[~self.opened[blocks]]
        if len(new):
            doc, tf = unpacked(self.data, self.at[new], self.lengths[new], self.first[new])
            where = self._places(new)
            self.doc[where], self.impact[where] = doc, impacts(tf, self.m[doc])
            self.opened[new] = True
        return self._places(blocks)

    def _places(self, blocks: np.ndarray) -> np.ndarray:
        n = self.lengths[blocks]
        return np.repeat(self.starts[blocks] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def best(self, query: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """(document, score) of the k best, by descending score and ascending document, for (term, weight)."""
        known = [(self.number[t], w) for t, w in query if w and t in self.number]
        if not known:
            return []
        blocks = np.concatenate([np.arange(self.begin[t], self.begin[t + 1]) for t, _ in known])
        ends = np.unique(self.last[blocks])
        # pointers move over the heads: for each stretch up to an end, each term's block there (-1: none), and the bound of all
        heads, bound = np.full((len(known), len(ends)), -1), np.zeros(len(ends), np.int64)
        for row, (t, w) in enumerate(known):
            block = self.begin[t] + np.searchsorted(self.last[self.begin[t] : self.begin[t + 1]], ends)
            there = block < self.begin[t + 1]
            there[there] = self.first[block[there]] <= ends[there]
            heads[row, there] = block[there]
            bound[there] += w * self.peak[block[there]]
        weight = np.zeros(len(self.first), np.int64)
        for t, w in known:
            weight[self.begin[t] : self.begin[t + 1]] = w
        scores, added = np.zeros(len(self.ids), np.int64), np.zeros(len(self.first), bool)
        order = np.argsort(-bound, kind="stable")
        top_doc = top_score = np.empty(0, np.int64)
        at, step = 0, 8
        while at < len(order) and (len(top_doc) < k or bound[order[at]] >= top_score[-1]):
            chosen = order[at : at + step]
            if len(top_doc) == k:
                chosen = chosen[bound[chosen] >= top_score[-1]]
            need = np.unique(heads[:, chosen])
            need = need[need >= 0]
            need = need[~added[need]]
            added[need] = True
            where = self.postings(need)
            np.add.at(scores, self.doc[where], np.repeat(weight[need], self.lengths[need]) * self.impact[where])
            # the documents of these stretches now have all their terms
            low = np.where(chosen > 0, ends[chosen - 1] + 1, 0)
            n = ends[chosen] + 1 - low
            docs = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            docs = np.concatenate((top_doc, docs[scores[docs] > 0]))
            keep = np.lexsort((docs, -scores[docs]))[:k]
            top_doc, top_score = docs[keep], scores[docs[keep]]
            at, step = at + step, step * 2
        return list(zip(top_doc.tolist(), top_score.tolist()))


def _in_blocks(items: DataFrame, item_id: str, text: str):
    """Items with their terms, in lists of bounded size; items are a given set of queries and are read one partition at a time."""
    block, chars = [], 0
    for r in items.select(items[item_id].alias("item"), items[text].cast("binary").alias("text")).toLocalIterator():
        block.append((r.item, Counter(terms(bytes(r.text) if r.text is not None else None))))
        chars += len(r.text or b"")
        if len(block) >= MOST_ITEMS or chars >= MOST_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """(item, rank, id, score) of the ``k`` documents with the highest scores above 0 for each row of ``items``."""
    spark, ids = items.sparkSession, index.rows.schema["ids"].dataType.elementType.simpleString()
    kind = items.schema[item_id].dataType.simpleString()
    found = spark.createDataFrame([], f"`{item_id}` {kind}, rank int, `{index.id_col}` {ids}, score long")
    for block in _in_blocks(items, item_id, text):
        named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"n int, item {kind}")
        # Spark keeps the best k of each task before it ranks them
        by = Window.partitionBy("n").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = _hits(index, [c for _, c in block], k).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        found = found.unionAll(best.join(F.broadcast(named), "n").select("item", "rank", "id", "score"))
    return found


def _hits(index: Index, counts: list[Counter], k: int) -> DataFrame:
    """(n, id, score): the best k of each segment for each item, by its number in the block."""
    spark, stats = index.rows.sparkSession, index.stats
    ids = index.rows.schema["ids"].dataType.elementType.simpleString()
    # a row for each term of a block of items, whose characters are bounded
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in sorted(set().union(*counts))], "term binary"))
    ours = index.rows.where("term is not null").join(wanted, "term", "left_semi").select(*index.rows.columns)
    weight = {bytes(r.term): stats.weight(r.df) for r in ours.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    queries = spark.sparkContext.broadcast([[(t, c * weight[t]) for t, c in sorted(count.items()) if t in weight] for count in counts])

    def look(rows: pa.Table) -> pa.Table:
        postings = Postings(rows, stats)
        hits = [(n, d, s) for n, query in enumerate(queries.value) for d, s in postings.best(query, k)]
        n, d, s = (np.array(x, np.int64) for x in (zip(*hits) if hits else ((), (), ())))
        return pa.table({"n": pa.array(n.astype(np.int32)), "id": postings.ids.take(pa.array(d)), "score": pa.array(s)})

    return ours.unionAll(index.rows.where("term is null")).groupBy("segment").applyInArrow(look, f"n int, id {ids}, score long")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """The index of ``docs`` and its search for ``items``."""
    return search(build_index(docs, id_col, text), items, item_id, text, k)

"""Line dedup, ranked search and vector codes against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import lexical_search, line_dedup, vector_codes
from tests.llm.test_operators import LOWER, ODD, docs

WHITE = " \t\n\x0b\x0c\r"

# --- 11


def deduped_by_hand(rows, least=10):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(WHITE).translate(LOWER)
    n = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for i, lines in split:
        stay = [x for x in lines if n[key(x)] < least]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


def lined(n=120, seed=3):
    rnd = random.Random(seed)
    common = ["Share this page", " share THIS page\t", "É à", "é à", "", " ", "\r", "\xa0", "x\x85"] + [f"line {k}" for k in range(30)]
    return [(k, "\n".join(rnd.choice(common) if rnd.random() < 0.4 else f"own {rnd.random()}" for _ in range(rnd.randrange(12)))) for k in range(n)]


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(spark, least):
    # repeated rows are documents of their own, one text has very many lines, and one line is in all copies
    rows = ODD + lined() + [(500, "\n".join(f"line {k % 40}" for k in range(60_000)))] + [(None, "only line")] * 12 + [(7, "same id"), (7, "same id")]
    got = line_dedup.dedup_lines(docs(spark, rows), min_docs=least).collect()
    assert Counter(map(tuple, got)) == deduped_by_hand(rows, least)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    rows = [(k, "the\ntwo lines") for k in range(4)]
    got = line_dedup.deduplicated(docs(spark, rows), min_docs=4)
    assert got.columns == docs(spark, rows).columns and {r.text for r in got.collect()} == {""} and got.where("source is not null").count() == 4
    assert {r.text for r in line_dedup.deduplicated(docs(spark, rows), min_docs=4, min_chars=5).collect()} == {"the"}


# --- 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(rows, items, k=20):
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    found = [(i, Counter(w), len(w)) for i, t in rows if (w := words(t))]
    n_docs, n_terms, df = len(found), sum(n for _, _, n in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            scored += [(-score, i is None, i, score)] * (score > 0)
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def searched(n=900, seed=4):
    """Words of very different frequency, equal texts, and some very short ones, so that many scores are equal."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 400}"
    texts = [" ".join(word() for _ in range(rnd.choice([1, 3, 20, 60]))) for _ in range(n)]
    rows = [(rnd.randrange(10 * n), rnd.choice(texts)) for _ in range(n)]
    return rows, [(k, " ".join(word() for _ in range(rnd.randrange(1, 30)))) for k in range(25)]


ITEM = "item_id long, text string, n int, item int, rank int, score int, term string"


def items_of(spark, items):
    return spark.createDataFrame([(i, t, *(None,) * 5) for i, t in items], ITEM)


def test_ranked_search(spark):
    rows, items = searched()
    rows += ODD + [(None, "w1 w2 w3")] * 3 + [(77, "W1-w2_w3 \u00e9\u00df")] * 4
    items += [(100, None), (101, ""), (102, "..."), (103, "nowhere"), (None, "one word"), (3, "w1 w1 w1 W2"), (3, "w1 w1 w1 W2"), (104, "\u00e9\u00df"), (105, "w1 " * 5000)]
    got = Counter(map(tuple, lexical_search.rank(docs(spark, rows), items_of(spark, items)).collect()))
    assert got == ranked_by_hand(rows, items)
    assert Counter(map(tuple, lexical_search.rank(docs(spark, rows), items_of(spark, items), k=3).collect())) == ranked_by_hand(rows, items, 3)


def test_ranked_search_edges(spark, monkeypatch):
    assert lexical_search.rank(docs(spark, []), items_of(spark, [(1, "a")])).count() == 0
    assert lexical_search.rank(docs(spark, [(1, "a"), (2, None)]), items_of(spark, [])).count() == 0
    assert [tuple(r) for r in lexical_search.rank(docs(spark, [(1, "a"), (2, None), (3, "b")]), items_of(spark, [(1, "a")])).collect()] == list(ranked_by_hand([(1, "a"), (3, "b")], [(1, "a")]))
    monkeypatch.setattr(lexical_search, "MOST_ITEMS", 4)  # several blocks of items
    rows, items = searched(200, 9)
    assert Counter(map(tuple, lexical_search.rank(docs(spark, rows), items_of(spark, items)).collect())) == ranked_by_hand(rows, items)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_posting_blocks(monkeypatch, block):
    """A segment's best for each query, whatever the size of its blocks; and blocks stay closed."""
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    rows, items = searched(600, block)
    segment = lexical_search.Segment()
    for at in range(0, len(rows), 100):
        segment.add([r[0] for r in rows[at : at + 100]], [r[1].encode() for r in rows[at : at + 100]])
    stats = lexical_search.Stats(len(segment.ids), segment.size)
    table = pa.Table.from_batches([segment.rows(5, pa.int64(), stats)])
    words = lambda t: sorted(Counter(lexical_search.terms(t.encode())).items())
    df = dict(zip(table["term"].to_pylist(), table["df"].to_pylist()))
    whole = ranked_by_hand(rows, items, 5)
    got, opened = Counter(), []
    for item, text in items:
        postings = lexical_search.Postings(table, stats)
        best = postings.best([(t, c * stats.weight(df[t])) for t, c in words(text) if t in df], 5)
        got.update((item, r + 1, postings.ids[d].as_py(), s) for r, (d, s) in enumerate(best))
        ours = [postings.number[t] for t, _ in words(text) if t in df]
        opened.append(postings.opened.sum() / max(1, sum(postings.begin[t + 1] - postings.begin[t] for t in ours)))
    assert got == whole and min(opened) < 0.5


def test_blocks_hold_wide_values():
    doc, tf = np.array([0, 5, 70_000, 70_001, 3, 9_000_000]), np.array([1, 300, 2, 70_000, 1, 1])
    data, sizes = lexical_search.packed(doc, tf, np.array([0, 4]))
    back = lexical_search.unpacked(data, np.array([0, sizes[0]]), np.array([4, 2]), np.array([0, 3]))
    assert back[0].tolist() == doc.tolist() and back[1].tolist() == tf.tolist()


# --- 13


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, label, v) for i, v, label in rows if v and None not in v and all(map(math.isfinite, v)) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in kept if len(v) == len(kept[0][2])]
    d = len(kept[0][2]) // parts
    cut = [[v[p * d : (p + 1) * d] for _, _, v in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q, book: min((far(q, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for q in cut[p]:
                members[near(q, books[p])[1]].append(q)
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if members[e] else c for e, c in enumerate(books[p])]
    best = [[near(cut[p][k], books[p]) for p in range(parts)] for k in range(len(kept))]
    out = [(i, label, "".join(f"{e:02x}" for _, e in b), sum(x for x, _ in b)) for (i, label, _), b in zip(kept, best)]
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    return Counter((*r, sums[r[1]]) for r in out), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, id int, v int, code string, error int, _label int, n int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *(None,) * 7) for i, v, label in rows], VECTORS)


def coded(spark, rows, **options):
    codes = vector_codes.compress(vectors(spark, rows), **options)
    return Counter(map(tuple, vector_codes.label_errors(codes).collect())), codes.digest()


def embedded(n, dims=32, seed=1, spread=3):
    """Vectors on a coarse lattice, so that many distances are equal."""
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.integers(-spread, spread + 1, dims) / 256).tolist(), int(rng.integers(4)) or None) for i in rng.permutation(n)]


def test_vector_codes(spark):
    rows = embedded(700) + [(9999, None, 1), (0, None, 1), (5, [0.1] * 31 + [None], 2), (6, [float("nan")] * 32, 2), (7, [float("inf")] + [0.0] * 31, 2), (8, [], 3), (None, [0.25] * 32, None), (None, [0.5] * 32, 3), (800, [0.1] * 16, 1), (801, [0.1] * 5, 1)]
    rows += [(17, [3.0 - k / 8 for k in range(32)], 1)] * 40 + [(18, [1e3, -1e3] * 16, 2)]
    assert coded(spark, rows) == codes_by_hand(rows)
    assert coded(spark, rows, entries=5, rounds=3) == codes_by_hand(rows, entries=5, rounds=3)


def test_vector_codes_blocks_do_not_matter(spark, monkeypatch):
    rows = embedded(300, 16, 2, 40)
    want = codes_by_hand(rows)
    for block, leaf in ((7, 2), (64, 3), (8192, 16)):
        monkeypatch.setattr(vector_codes, "BLOCK", block)
        monkeypatch.setattr(vector_codes, "LEAF", leaf)
        total, n = np.zeros((64, 1), np.int64), np.zeros(64, np.int64)
        points = np.array([[math.floor(256 * v[0])] for _, v, _ in rows], np.int32)
        order = vector_codes.tree_order(points)
        tree = vector_codes.Tree.of(points[order], *vector_codes.leaves(points[order]))
        book = points[:64].astype(np.int64)
        seen = np.zeros(len(rows), int)
        for at, entry, whole in vector_codes.filtered(tree, book):
            seen[order[at]] += 1
            assert (((points[order[at]] - book[entry]) ** 2).sum(1) == ((points[order[at]][:, None] - book[None]) ** 2).sum(2).min(1)).all()
            np.add.at(total, entry, points[order[at]] if whole is None else whole)
            np.add.at(n, entry, 1 if whole is None else at.stop - at.start)
        assert (seen == 1).all() and total.sum() == points.sum() and n.sum() == len(rows)
        assert coded(spark, rows) == want


def test_vector_codes_edges(spark):
    assert coded(spark, []) == (Counter(), hashlib.sha256(b"").hexdigest())
    assert coded(spark, [(1, None, None)])[0] == Counter()
    few = embedded(3)
    assert coded(spark, few) == codes_by_hand(few)
    huge = [(1, [3e38] * 32, 1), (2, [-3e38] * 32, 1), (3, [0.0] * 32, 1)]
    assert {r[3] for r in coded(spark, huge)[0]} == {0}
    assert {len(r[2]) for r in coded(spark, [(1, [0.5] * 4096, 1), (2, [0.25] * 4096, 1)])[0]} == {32}
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, few), entries=257)

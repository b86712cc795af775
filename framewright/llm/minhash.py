"""MinHash near-duplicate detection, confirmed on full shingle sets.

Texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``, and a document's
set holds its distinct 5-word shingles; with fewer words the whole sequence is
one shingle, and without words the set is empty and linked with nothing.
Documents are linked when 100 * |A & B| >= 75 * |A | B|.

1. One vectorised pass makes for each document the set's size, a 128-bit key of
   the set, 128 minima of multiply-shift hashes in 32 bands of four, two
   bits of each minimum as a compact signature, and a bitmap of the set.  At similarity 0.75 two
   documents share no band with probability 5e-6.
2. Documents with the same set are one class, stood for by its smallest id;
   only these representatives go on.
3. Representatives that share a band bucket with another have their sorted
   shingle hashes written once, by id: the one time that texts are shuffled.
4. In each bucket every member is paired with the smallest id of its slice of
   the bucket, and these with the smallest id of the bucket: fewer pairs
   than members, and no member has many.  Pairs that sizes or signatures rule out go (84 of 128
   two-bit agreements are asked for, 4.5 deviations below the mean at 0.75); the
   rest is confirmed on full sets.  Components of the links follow.
5. Buckets that still hold several components are looked at again: one round
   confirms pairs of neighbours in a seeded order of the bucket, the most alike
   for each two components, which joins the stragglers of large groups.  At last
   members outside a bucket's largest component are compared with members of
   other components (sizes, signatures and bitmaps first, in cells of bounded
   sides), so no pair that shares a bucket is left undecided.  A bucket whose
   members are all linked costs nothing more.

The steps are the same at every size.  Sets of one centre's pairs meet in groups
of a bounded number of pairs, sorted so that the centre comes first; a task holds
one centre's set at a time.

Null text is empty text.  Rows with a null id link with nothing, and have a
null component; they are kept.  Rows that share an id count as one node.  Ties
are settled by the smaller id.  Very long texts are taken whole, a chunk of texts
at a time.  Only the two named columns are read; others may have any name, that of
a result column too.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, forget_kept, small_batches, tasks_of, write_table
from framewright.llm.components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
AGREE = 84
CHUNK = 1 << 20
BITS = 2048
#: Pairs of one centre that are confirmed in one group, and members of a bucket that one cell or slice holds, about.
PAIRS_AT_ONCE, SLICE_MEMBERS = 64, 1000

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_draw = lambda n: _rng.integers(0, 1 << 64, n, dtype=np.uint64)
_BYTES = _draw(256)
_BYTES[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE, _SHORT = _draw(SHINGLE) | np.uint64(1), _draw(SHINGLE)
_A, _B = (_draw(HASHES) | np.uint64(1))[:, None], _draw(HASHES)[:, None]
_BAND, _BAND_ADD = _draw(ROWS) | np.uint64(1), _draw(BANDS)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_SHIFTS = (2 * np.arange(32)).astype(np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and a 64-bit hash of it: polynomial prefix sums over the bytes."""
    b = np.frombuffer(data, np.uint8)
    white = _WHITE[b]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts = edge[white[edge - 1]] if len(edge) else edge
    ends = edge[~white[edge - 1]] if len(edge) else edge
    if not white[0]:
        starts = np.concatenate(([0], starts))
    if not white[-1]:
        ends = np.concatenate((ends, [len(b)]))
    up, down = _powers_to(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    chunk, size = [], 0
    for t in texts:
        t = (t or "").encode("utf-8", "surrogatepass")
        if chunk and size + len(t) > CHUNK:
            out += _sets_of(chunk)
            chunk, size = [], 0
        chunk.append(t)
        size += len(t) + 1
    return out + (_sets_of(chunk) if chunk else [])


def _sets_of(chunk: list[bytes]) -> list[np.ndarray]:
    data = b"\n".join(chunk) + b"\n"
    starts, h = _word_hashes(data)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in chunk])))
    at = np.searchsorted(starts, offsets)
    n = len(h) - SHINGLE + 1
    s = mix(sum(h[j : j + n] * _PLACE[j] for j in range(SHINGLE))) if n > 0 else h[:0]
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            x = np.sort(s[a : b - SHINGLE + 1])
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            sets.append(mix(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _SHORT[b - a]], np.uint64)))
        else:
            sets.append(s[:0])
    return sets


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function, upper 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        x = s[i : i + 512] * _A
        x += _B
        np.minimum(low, x.min(axis=1), out=low)
    return low >> np.uint64(32)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each value's low bits: a bit of A that B lacks is a shingle of A that B lacks."""
    flags = np.zeros(BITS, bool)
    flags[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<i8")


_SIGNED = "id long, n long, k1 long, k2 long, keys array<bigint>, bits array<bigint>, s0 long, s1 long, s2 long, s3 long"


def _sign(batches):
    forget_kept()
    with np.errstate(over="ignore"):
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column(1).to_pylist())
            n = np.array([len(s) for s in sets], np.int64)
            low = np.stack([minima(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint64)
            keys = mix((low.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + _BAND_ADD).view(np.int64)
            two = ((low & np.uint64(3)).reshape(-1, 4, 32) << _SHIFTS).sum(axis=2, dtype=np.uint64).view(np.int64)
            k = [np.array([mix(s ^ c).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in (np.uint64(0), np.uint64(0x5DEECE66D5DEECE6))]
            lists = lambda flat, each: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * each), pa.array(flat))
            maps = np.concatenate([bitmap(s) for s in sets]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n), *(pa.array(x) for x in k), lists(keys.reshape(-1), BANDS), lists(maps, BITS // 64), *(pa.array(np.ascontiguousarray(two[:, i])) for i in range(4)),
            ], names=["id", "n", "k1", "k2", "keys", "bits", "s0", "s1", "s2", "s3"])


def _differences(a: str, b: str) -> Column:
    """How many of the two-bit minima of the rows differ."""
    even = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for i in range(4):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even))
    return differ


def _alike(a: str, b: str, least: int) -> Column:
    """Sizes and two-bit signatures of the rows allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= least * F.greatest(n, m)) & (_differences(a, b) <= HASHES - AGREE)


def _possible(a: str, b: str, least: int) -> Column:
    """As ``_alike``, and the bitmaps allow the similarity too: they bound the common shingles from above, without error."""
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    # both counts in one sum, and outside generated code: an unrolled sum makes the join's method too large to compile
    either = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))).cast("long") + F.bit_count(q.bitwiseAND(F.bitwise_not(p))).cast("long") * 65536)
    counts = F.aggregate(either, F.lit(0).cast("long"), lambda acc, v: acc + v)
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = F.least(n - counts.bitwiseAND(F.lit(65535)), m - F.shiftright(counts, 16))
    return _alike(a, b, least) & F.coalesce(100 * both >= least * (n + m - both), F.lit(True))


_SETS = "id long, s binary"


def _write_sets(batches):
    """(id, sorted shingle hashes as bytes) of (id, text)."""
    forget_kept()
    with np.errstate(over="ignore"):
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s"])


def confirm(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough; ``sets`` has (id, s)."""
    # centres with more pairs than one group takes: few, and known before the pairs meet them, so no centre's pairs are brought together for it
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    wanted = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id")).unionAll(dealt.select("a", "part").distinct().select("a", "part", F.lit(0), "a"))

    def compare(batches):
        group, centres = None, []
        forget_kept()
        for batch in small_batches(batches):
            a, b = [], []
            for x, part, role, i, s in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if group != (x, part):
                    group, centres = (x, part), []
                s = np.frombuffer(s, np.uint64)
                if not role:
                    centres.append(s)
                    continue
                for c in centres:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if both and 100 * both >= least * (len(c) + len(s) - both):
                        a.append(x)
                        b.append(i)
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = sets.join(wanted.hint("shuffle_hash"), "id").select("a", "part", "role", "id", "s")
    return met.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(compare, "a long, b long")


def _stars(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): members with the smallest id of their slice, and these with the smallest of the bucket.

    A bucket has about as many slices as each of them has members, a power of two so that the buckets of one group
    of copies are cut alike.
    """
    slices = F.pow(F.lit(2.0), F.floor(F.log2("members") / 2)).cast("long")
    rows = shared.withColumn("slice", F.pmod(F.xxhash64("id"), F.when(F.col("members") > PAIRS_AT_ONCE, slices).otherwise(1)))
    tasks = tasks_of(shared)
    of_slice = write_table(rows.groupBy("key", "slice").agg(F.min("id").alias("c")), "slices", tasks=tasks)
    inner = rows.join(of_slice, ["key", "slice"]).select(F.col("c").alias("a"), F.col("id").alias("b"))
    outer = of_slice.join(of_slice.groupBy("key").agg(F.min("c").alias("a")), "key").select("a", F.col("c").alias("b"))
    out = write_table(inner.unionAll(outer).where("a < b").distinct(), "stars", tasks=tasks)
    drop_table(of_slice)
    return out


def _undecided(shared: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the bucket's largest component, and the numbers of members and of stragglers outside it."""
    member = shared.select("key", "id").join(found, F.col("id") == F.col("node"), "left")
    member = write_table(member.select("key", "id", F.coalesce("component", "id").alias("comp")), "members", tasks=tasks_of(shared))
    parts = member.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key")
    main = F.max(F.struct("size", "comp"))
    mixed = parts.agg(main["comp"].alias("main"), F.sum("size").alias("members"), (F.sum("size") - main["size"]).alias("stragglers")).where("stragglers > 0")
    out = write_table(member.join(mixed, "key").join(reps.drop("keys"), "id"), "undecided", tasks=tasks_of(member, reps))
    drop_table(member)
    return out


def _neighbours(left: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of members that stand next to each other in a seeded order of their bucket and belong to different components.

    Buckets are ordered in slices.  Of the pairs between the same two components only the most alike stays: one link joins them.
    """
    slices = F.ceil(F.col("members") / SLICE_MEMBERS)
    rows = left.select("key", F.pmod(F.xxhash64("id", F.lit(1)), slices).alias("slice"), F.xxhash64("id", F.lit(2)).alias("h"), F.struct("id", "comp", "n", "s0", "s1", "s2", "s3", "bits").alias("x"))
    order = Window.partitionBy("key", "slice").orderBy("h", "x.id")
    near = rows.select("x", F.lag("x").over(order).alias("y")).where((F.col("x.comp") != F.col("y.comp")) & _possible("x", "y", least))
    pair = F.struct((-_differences("x", "y")).alias("agree"), F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return near.groupBy(F.least("x.comp", "y.comp"), F.greatest("x.comp", "y.comp")).agg(F.max(pair).alias("p")).select("p.a", "p.b")


def _rest(left: DataFrame, least: int) -> DataFrame:
    """Distinct possible pairs (a, b) of a straggler and any other member of its bucket in another component.

    A bucket is a grid of cells, each a bounded number of stragglers by a bounded number of members; both are dealt to all cells of their row or column.
    """
    across, down = F.ceil(F.col("stragglers") / SLICE_MEMBERS), F.ceil(F.col("members") / SLICE_MEMBERS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n)
    x = left.where("comp <> main").select("*", own(across).alias("i")).withColumn("j", every(down)).alias("x")
    y = left.select("*", own(down).alias("j")).withColumn("i", every(across)).alias("y")
    cell = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    near = x.join(y, cell).where((F.col("x.comp") != F.col("y.comp")) & once & _possible("x", "y", least))
    return near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``; ``least`` is the similarity in hundredths."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    signed = write_table(source.mapInArrow(_sign, _SIGNED), "signed")
    named = signed.where("id is not null and n > 0")
    classes = write_table(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes", tasks=tasks_of(signed))
    reps = write_table(named.drop("k1", "k2").join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "representatives", tasks=tasks_of(signed))
    points = reps.select("id", F.explode("keys").alias("key"))
    buckets = points.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = write_table(points.join(buckets, "key"), "shared", tasks=tasks_of(reps))
    met = shared.select("id").distinct().hint("shuffle_hash")
    sets = write_table(source.join(met, "id").select("id", "t").mapInArrow(_write_sets, _SETS), "sets")

    def links_of(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """The components after the pairs are confirmed and their links added to the known components."""
        links = write_table(confirm(pairs, sets, least), "confirmed", tasks=tasks_of(sets, pairs))
        edges = links if known is None else links.unionAll(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        out = components(edges, tasks_of(links, shared))
        drop_table(links)
        return out

    stars = _stars(shared)
    slim = reps.drop("keys", "bits")
    x, y = slim.alias("x"), slim.alias("y")
    near = stars.join(x, F.col("b") == F.col("x.id")).join(y, F.col("a") == F.col("y.id")).where(_alike("x", "y", least))
    first = write_table(near.select("a", "b").distinct(), "pairs", tasks=tasks_of(stars, reps))
    found = links_of(first, None)

    left = _undecided(shared, found, reps)
    second = write_table(_neighbours(left, least).join(first, ["a", "b"], "left_anti"), "pairs", tasks=tasks_of(left))
    drop_table(left)
    found = links_of(second, found)

    left = _undecided(shared, found, reps)
    tried = first.unionAll(second)
    third = write_table(_rest(left, least).join(tried, ["a", "b"], "left_anti"), "pairs")
    drop_table(left)
    found = links_of(third, found)

    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    of_class = write_table(of_class, "components", tasks=tasks_of(classes))
    for table in (reps, shared, stars, sets, first, second, third, classes):
        drop_table(table)
    # texts without words are no class, so they don't meet at one key
    rows = signed.select("id", "n", "k1", "k2")
    out = rows.where("n > 0").join(of_class, ["k1", "k2", "n"], "left").select("id", "n", "component").unionAll(rows.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group: those whose id is the smallest of its component.

    Rows that share an id stay or go together.
    """
    gone = near_duplicates(docs, id_col, text, **options).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["_gone"], "left_anti")

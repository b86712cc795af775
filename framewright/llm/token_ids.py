"""Token ids as ORC: stripes, run-length integers, row indexes, Bloom filters.

Texts are dealt out by ranges of the document id, sorted, encoded and written
in one pass: a row holds the id, the file part, where its ids start within the
part, their number, and the ids as an integer array, which ORC stores by runs.
Row indexes and a Bloom filter on the document id let a reader skip stripes;
every stripe can be read by a task of its own.

Only the text crosses the shuffle, never the ids.  Where a document starts in
the whole sequence is the part's start (a sum over one row for each part)
plus its place in the part.

Texts in the plain alphabet (ASCII and composed Latin letters) are split into the
tokenizer's pre-tokens here and looked up in a bounded cache of each worker; only
misses reach its merge model.  Other texts are split at spaces and line feeds,
which the tokenizer drops and never merges across, and pieces beyond the alphabet
are encoded by the tokenizer as a whole.

Null text counts as empty and gives the end id alone.  Ids of documents need
not be unique: equal ones stand next to each other, in no fixed order unless
their texts are equal.  A null document id sorts first.  Empty tables give
an empty folder of files and an empty result.  Very long texts are encoded whole; a batch of output
closes after a bounded number of bytes or one text.  Extra columns are not read, so their names may be any.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import on_worker, work_dir
from framewright.llm.token_counts import Recent, model_file

#: Entries of each of a worker's two cache generations.
CACHE_ENTRIES = 300_000
ROW_BYTES = 8 << 20


#: Letters of the plain alphabet: composed, with one lower-case letter each.
_LETTERS = "a-zß-öø-ÿ" + "".join(chr(c) for c in range(0x100, 0x17F) if c not in (0x130, 0x131, 0x149) and len(chr(c).lower()) == 1)
PLAIN = re.compile(rf"[\x20-\x7E\t\n\x0B\x0C\rÀ-ÖØ-Þ{_LETTERS}]*")
#: The tokenizer's split, over lower-cased texts of that alphabet.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+", re.A)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder(Recent):
    """Ids of a pre-token as little-endian 32-bit integers."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__(entries=CACHE_ENTRIES)
        self.tokenizer = Tokenizer.from_file(model_file(model))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def make(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))
        # other alphabets, and texts that may hold special strings, go through the tokenizer; it drops spaces and line feeds
        out = []
        for x in text.replace("\n", " ").split(" "):
            if "<|" not in x and PLAIN.fullmatch(x):
                out += map(self.__getitem__, SPLIT.findall(x.lower()))
            else:
                ids = self.tokenizer.encode(x, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
        return b"".join(out)


def write_ids(docs: DataFrame, path: str, model: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, in ascending order of the document id, as ORC files under ``path``."""
    end = struct.pack("<I", end_id)

    def encode(batches):
        from pyspark import TaskContext

        encoder = on_worker(("encoder", model), lambda: Encoder(model))
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):  # rows of one output batch hold a bounded number of bytes
                ids, size, first = [], 0, at
                while at < len(texts) and size < ROW_BYTES:
                    ids.append(encoder.encode(texts[at].as_py() or "") + end)
                    size += len(ids[-1])
                    at += 1
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate(([0], np.cumsum(n)))
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                ], names=["doc_id", "part", "place", "n_tokens", "ids"])
                start += int(offsets[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    # as many ranges as the session's shuffle partitions: each is one file, in the order of the ids
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "t")
    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>")
    encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.compress", "ZSTD").option("orc.stripe.size", str(64 << 20)).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids) as written; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.orc(path)


def with_starts(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before the document in the whole sequence, to rows with part and place."""
    totals = whole.groupBy("part").agg(F.sum("n_tokens").alias("total")).alias("t")
    other = totals.select(F.col("part").alias("later"), "total")
    # one row for each file: parts below a part add up to its start
    from pyspark.sql import Window

    before = Window.partitionBy(F.lit(0)).orderBy("later").rowsBetween(Window.unboundedPreceding, -1)
    starts = other.select(F.col("later").alias("part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    return rows.join(starts, "part").withColumn("start", F.col("part_start") + F.col("place")).drop("part_start")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids_crc32) from rows with ``ids``: CRC-32 of the ids as unsigned 32-bit little-endian integers."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(4)
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            n = offsets[1:] - offsets[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n.astype(np.int64)), pa.array(np.array(sums, np.int64))], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "part", "place", "n_tokens", "ids").mapInArrow(crc, f"doc_id {kind}, part int, place long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the ids under ``path`` (default: a new folder of the shared work folder), read the files back, and return (id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, id_col=id_col, **options)
    written = read_ids(spark, path)
    rows = with_starts(digest(written), written)
    return rows.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")

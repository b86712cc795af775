"""Token counts by a map-side two-tier lookup.

The encoder's merges never cross the start of a run of spaces or a line feed
(no piece holds either one behind another character), so the token count of a
text is the sum over its pre-tokens: a run of spaces with what follows it, or
a line feed with what follows it.

Tier one is a broadcast table of the lengths of frequent pre-tokens: the words
that are pieces of the model themselves, in the order of its merges, which is
their order of frequency; at most ``entries`` of them.  It takes no pass over the
corpus.  Tier two is a bounded cache in each Python worker;
what misses both is encoded there.  No pre-token is shuffled, and the tables
change only the speed, never a count.

Nulls count as empty texts (0 bytes, 0 tokens); a null id is passed on.
Repeated rows give repeated results; an empty table gives an empty one.  Very long
texts are counted whole; pre-tokens too long for the cache are encoded each time.
Extra columns are not read, so their names may be any.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import on_worker, small_batches

PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
#: Entries of each of a worker's two cache generations; longer pre-tokens are encoded without being kept.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64

def pre_tokens(text: str) -> list[str]:
    """The text with the dummy space that the encoder puts first; an escaped space in the text equals a space."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


class Recent(dict):
    """A bounded cache in two generations: when the new one is full it becomes the old one, from which what is used again comes back."""

    def __init__(self, first: dict | None = None, entries: int | None = None):
        super().__init__(first or {})
        self.first, self.old, self.entries = first or {}, {}, entries or CACHE_ENTRIES

    def make(self, piece: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        value = self.old.pop(piece, None)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.entries + len(self.first):
                self.old = dict(self)
                self.clear()
                self.update(self.first)
            self[piece] = value
        return value


class Lengths(Recent):
    """Token counts by pre-token; a miss is encoded."""

    def __init__(self, model_path: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def make(self, piece: str) -> int:
        if piece[0] == "\n":
            return len(self.model.encode(piece)) - 1  # without the dummy prefix, which stands alone before a line feed
        return 1 if piece == " " else len(self.model.encode(piece[1:]))

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def model_file(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_pre_tokens(model: str, entries: int) -> list[str]:
    """The first so many words among the model's pieces, as pre-tokens."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model_file(model))
    words = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size()))
    found = [" " + w[1:] for w in words if len(w) > 1 and w[0] == "▁" and "▁" not in w[1:]]
    return found[:entries]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text: str = "text", limit: int = 4096, entries: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``; other columns are not read."""
    spark = docs.sparkSession
    lengths = Lengths(model_file(model), {})
    table, key = spark.sparkContext.broadcast({p: lengths[p] for p in frequent_pre_tokens(model, entries)}), uuid.uuid4().hex

    def count(batches):
        worker = on_worker(("lengths", key), lambda: Lengths(model_file(model), table.value))
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [worker.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
